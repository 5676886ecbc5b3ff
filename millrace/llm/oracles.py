"""The corpus queries that SQL can express, in DuckDB's dialect, over the same tables."""

from __future__ import annotations

from . import media, mixing, ngram_join, phrases, quality, runs, secrets
from .licenses import LOWER, UPPER

WORD = r"[^\x20\x09-\x0D]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def jaccard_sql() -> str:
    k, percent = ngram_join.WORDS, ngram_join.PERCENT
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS shingle FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_have JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, steps.b FROM reach JOIN steps ON steps.a = reach.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)
"""


def secrets_sql() -> str:
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(secrets.KINDS.items()):
        pattern = quoted(pattern.removeprefix(secrets.NOT_INSIDE))
        more = f" AND regexp_matches(value, '{secrets.OPAQUE}') AND len(regexp_extract_all(value, '{secrets.DIGITS}')) >= {secrets.LEAST_DIGITS}" if kind == "opaque" else ""
        parts.append(f"""
SELECT doc_id, owner, {rank} AS rank, '{kind}' AS kind, ends[i] - length(m[i]) AS start, ends[i] AS finish, v[i] AS value
FROM (SELECT *, list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(range(1, i + 1), lambda j: length(p[j]) + length(m[j])))::BIGINT) AS ends
  FROM (SELECT doc_id, owner, regexp_extract_all(x, {pattern}) AS m, regexp_extract_all(x, {pattern}, {group}) AS v, string_split_regex(x, {pattern}) AS p FROM texts)),
  LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i) WHERE length(value) >= {least}{more}""")
    return f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS x FROM documents),
found AS ({" UNION ALL ".join(parts)}),
cands AS (SELECT * FROM found AS o WHERE kind <> 'opaque' OR NOT EXISTS (SELECT 1 FROM found AS b WHERE b.kind <> 'opaque' AND b.doc_id = o.doc_id AND b.start < o.finish AND o.start < b.finish)),
owned AS (SELECT value, count(DISTINCT owner) < {secrets.WIDE_OWNERS} AND count(DISTINCT doc_id) < {secrets.WIDE_REPOSITORIES} AND NOT regexp_matches(value, {quoted(secrets.PLACEHOLDER)}) AS live FROM cands GROUP BY value),
judged AS (SELECT *, kind || ':' || start || ':' || finish AS span FROM cands JOIN owned USING (value)),
by_doc AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'opaque') AS base, string_agg(span, ',' ORDER BY start, rank) FILTER (kind <> 'opaque' OR live) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live AND kind <> 'opaque') AS n_copied FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM documents LEFT JOIN by_doc USING (doc_id)
"""


def quality_sql() -> str:
    q = quality
    return f"""
WITH t AS (SELECT doc_id, coalesce('=' || lang, '') AS s, coalesce(text, '') AS x, regexp_extract_all(x, '{WORD}') AS w,
  list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS l FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + {q.WINDOW - 1}], ' ') AS g FROM t, LATERAL (SELECT unnest(range(1, len(w) - {q.WINDOW} + 2)) AS i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range({q.WINDOW})) AS k) GROUP BY 1),
counted AS (SELECT doc_id, s, x, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
  length(regexp_replace(x, '[^{q.SYMBOLS}]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM t LEFT JOIN repeated USING (doc_id)),
measured AS (SELECT *, least(100, floor(100 * greatest(n_symbols / greatest(1, n_words), (length(x) - length(replace(x, '!', ''))) / greatest(1, n_words),
  length(regexp_replace(x, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) / greatest(1, word_chars), n_repeat_words / greatest(1, n_words), n_dup_lines / greatest(1, n_lines))))::INT AS rule_score FROM counted),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1),
trials AS (SELECT s, x, any_value(rule_score) AS rule_score, min(quality) AS quality FROM measured JOIN known USING (doc_id) GROUP BY 1, 2),
histogram AS (SELECT s, rule_score, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS poor FROM trials GROUP BY 1, 2),
by_cutoff AS (SELECT s, c, coalesce(sum(good) FILTER (rule_score >= c), 0)::BIGINT AS k, coalesce(sum(poor) FILTER (rule_score >= c), 0)::BIGINT AS hits, sum(good)::BIGINT AS n
  FROM histogram, (SELECT unnest(range(1, 101)) AS c) GROUP BY 1, 2),
tested AS (SELECT *, n > 0 AND k < n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({q.RISK}) + (n - i) * ln(1 - {q.RISK}))))
  <= {q.DELTA} / (SELECT count(DISTINCT s) FROM t) AS good_enough FROM by_cutoff),
certified AS (SELECT s, c, hits - {q.WEIGHT} * k AS gain FROM (SELECT *, bool_and(good_enough) OVER (PARTITION BY s ORDER BY c DESC) AS sure FROM tested) WHERE sure),
chosen AS (SELECT s, c FROM (SELECT s, c, row_number() OVER (PARTITION BY s ORDER BY gain DESC, c DESC) AS place FROM certified WHERE gain > 0) WHERE place = 1),
judged AS (SELECT *, coalesce(c, 101)::INT AS cutoff, n_words < {q.LEAST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed FROM measured LEFT JOIN chosen USING (s))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rule_score < cutoff AS kept, rule_score, cutoff FROM judged
"""


def media_sql() -> str:
    """What op2 says of the payload and the stored form, but for checksums that SQL does not have and the feature."""

    def little(n: str, size: int) -> str:
        return "printf('" + "%02x" * size + "', " + ", ".join(f"(({n})::BIGINT >> {8 * i}) & 255" for i in range(size)) + ")"

    head = f"hex(encode('RIFF')) || {little('36 + payload_bytes', 4)} || hex(encode('WAVEfmt ')) || {little('16', 4)} || {little('1', 2)} || {little('1', 2)} || {little(str(media.RATE), 4)} || {little(str(media.RATE), 4)} || {little('1', 2)} || {little('8', 2)} || hex(encode('data')) || {little('payload_bytes', 4)}"
    return f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
p AS (SELECT doc_id, n_bytes, greatest({media.BLOCK}, (n_bytes + {media.BLOCK - 1}) // {media.BLOCK} * {media.BLOCK}) AS payload_bytes, b FROM t),
q AS (SELECT doc_id, n_bytes, payload_bytes, b || unhex(repeat('00', (payload_bytes - n_bytes)::INT)) AS payload FROM p)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, payload_bytes::BIGINT AS payload_bytes, sha256(payload) AS payload_sha256, payload_bytes::BIGINT + 44 AS media_bytes, sha256(unhex({head}) || payload) AS media_sha256 FROM q
"""


def mixing_sql() -> str:
    """Sizes and targets: the level at which the sources, in the order in which they reach their caps, hold what is poured."""
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, [{weights}][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS w FROM d GROUP BY source),
r AS (SELECT *, {mixing.MOST} * total AS cap, {mixing.SHARE} * sum(total) OVER () AS poured FROM s),
k AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, w, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held, sum(w) OVER (ORDER BY cap / w, w, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM r),
l AS (SELECT arg_min((poured - held) / free, cap / w) FILTER ((poured - held) / free <= cap / w) AS level FROM k)
SELECT doc_id, size, total AS source_size, round(least(cap, coalesce(level, cap) * CASE WHEN level IS NULL THEN 1 ELSE w END), 3) AS target
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source, l
"""


def crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def crc_sql(text: str) -> str:
    """crc32 of an ASCII text, unsigned."""
    table = ", ".join(map(str, crc_table()))
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor([{table}][(xor(c, b) & 255) + 1]::BIGINT, c >> 8)), 4294967295::BIGINT)"


def lm_sql() -> str:
    """The base columns of op8."""
    return f"""
WITH d AS (SELECT doc_id, {crc_sql("doc_id::VARCHAR")} % 5 = 1 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}'), '') AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
n AS (SELECT sum(c)::BIGINT AS total, count(*) AS distinct_words FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(total) AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (total + 0.5::DOUBLE * (distinct_words + 1)))), 3) AS base_score FROM t LEFT JOIN c USING (word), n GROUP BY doc_id
"""


def runs_sql() -> str:
    """Equal words of a document at each lag, numbered to find stretches without a gap."""
    return f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, len(w) AS n, {crc_sql("doc_id::VARCHAR")} AS h, h // 10 AS g FROM documents),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END AS a, 1 + (n - a) // (3 + g % 8) AS q FROM t),
words AS (SELECT doc_id, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % q ELSE i END] AS word FROM p, LATERAL (SELECT unnest(range(n)) AS i)),
pairs AS (SELECT x.doc_id, y.i - x.i AS period, x.i FROM words AS x JOIN words AS y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND {runs.PERIODS} * (y.i - x.i) <= x.n),
islands AS (SELECT doc_id, period, i, i - row_number() OVER (PARTITION BY doc_id, period ORDER BY i) AS island FROM pairs),
found AS (SELECT doc_id, min(i) AS start, count(*) + period AS length, period FROM islands GROUP BY doc_id, period, island HAVING count(*) >= {runs.PERIODS - 1} * period AND count(*) + period >= {runs.LEAST}),
runs AS (SELECT doc_id, start, length, min(period) AS period FROM found GROUP BY 1, 2, 3),
hidden AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS x FROM words ANTI JOIN hidden USING (doc_id, i) GROUP BY 1),
by_doc AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM runs GROUP BY 1),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(x, '')) AS collapsed_sha256
FROM documents LEFT JOIN by_doc USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def phrases_sql() -> str:
    p = phrases
    starts = " UNION ALL ".join(f"SELECT lang, w[i:i + {m - 1}] AS g FROM pieces, LATERAL (SELECT unnest(range(1, len(w) - {m} + 2)) AS i)" for m in range(1, p.LONGEST + 1))
    return f"""
WITH pieces AS (SELECT coalesce(lang, '{p.UNKNOWN}') AS lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM documents),
f AS (SELECT lang, g, len(g) AS m, count(*) AS a FROM ({starts}) GROUP BY 1, 2),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE m > 1 AND a >= {p.LEAST}),
inside AS (SELECT lang, g[i:i + k - 1] AS g, max(a) AS b FROM c, LATERAL (SELECT unnest(range(2, m)) AS k), LATERAL (SELECT unnest(range(1, m - k + 2)) AS i) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, g) WHERE b IS NULL OR 100 * b::HUGEINT < {p.ABSORB} * a::HUGEINT),
cuts AS (SELECT kept.lang, kept.g, k, kept.a, x.a AS l, y.a AS r, {p.SCALE} * kept.a::HUGEINT // (x.a + y.a) AS score FROM kept, LATERAL (SELECT unnest(range(1, m)) AS k)
  JOIN f AS x ON x.lang = kept.lang AND x.g = kept.g[:k] JOIN f AS y ON y.lang = kept.lang AND y.g = kept.g[k + 1:]),
best AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best) JOIN n USING (lang) WHERE rank <= {p.TOP}
"""
