"""Secrets, and whose they are.

Patterns give candidates with their places; all of that is done with SQL functions, places included:
the pieces between matches have known lengths, so sums of lengths are places. The candidates' hashes
are then counted over the whole corpus by distinct owners and repositories. A value that several
owners share is a widely copied example; one that few have, and that does not read like a
placeholder, looks live. Opaque strings, which no keyword announces, count as secrets only if the
corpus says that they look live.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_skewed, written

#: Spares the search the later places of a run; matches are the same without it.
NOT_INSIDE = r"(?<![A-Za-z0-9+/_-])"
#: The kinds in order, each with its pattern, the group that is the secret, and the least characters of that group.
KINDS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),  # as AKIA[A-Z0-9]+ of 20 and more: a shorter run has no longer one inside
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # likewise
    "opaque": (NOT_INSIDE + r"[A-Za-z0-9+/_-]{16,}", 0, 16),
}
BASE = ("assign", "access", "hex")
#: An opaque string must hold letters and four digits; a placeholder never looks live.
OPAQUE, DIGITS, LEAST_DIGITS = r"[A-Za-z]", r"[0-9]", 4
#: Also eight times the same letter or digit.
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|changeme|your_|xxxx|12345678|" + "|".join(f"{c}{{8}}" for c in string.digits + string.ascii_lowercase)
#: A value with so many owners, or in so many repositories, is a widely copied example.
WIDE_OWNERS, WIDE_REPOSITORIES = 4, 100
#: Running values are taken over blocks of BLOCK, blocks of such blocks and so on, LEVELS times.
BLOCK, LEVELS = 32, 3
MASK = "[SECRET]"
#: A character that is put before each piece of a text while it is bytes, so that no piece begins with a byte order mark.
GUARD = "x"
CANDIDATES = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, merge, zero: Column, levels: int = LEVELS) -> Column:
    """The values merged up to each element, itself included: block by block, so very many values cost little more than their number.

    merge: of two values, associative; zero: changes nothing.
    """
    fold = lambda x: F.aggregate(x, zero, merge)
    if not levels:
        return let(values, lambda v: F.transform(v, lambda _, i: fold(F.slice(v, F.lit(1), i + 1))))

    def of_blocks(blocks: Column) -> Column:
        upto = running(F.transform(blocks, fold), merge, zero, levels - 1)
        before = let(upto, lambda u: F.concat(F.array(zero), F.slice(u, F.lit(1), F.greatest(F.size(u) - 1, F.lit(0)))))
        return F.flatten(F.zip_with(blocks, before, lambda block, b: F.transform(block, lambda _, i: merge(b, fold(F.slice(block, F.lit(1), i + 1))))))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

    # What a lambda reads is bound first, else it would be computed again for each element.
    return let(let(values, cut), of_blocks)


def with_candidates(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with ``__cands``: (start, rank, kind, end, value) of every match of every kind, by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pattern = {k: F.lit(p) for k, (p, _, _) in KINDS.items()}
    # Each step is a projection of its own, so that no pattern runs twice.
    df = docs.withColumns({f"__m_{k}": F.regexp_extract_all(text, pattern[k], F.lit(0)) for k in KINDS})
    some = {k: F.size(f"__m_{k}") > 0 for k in KINDS}
    df = df.withColumns({f"__p_{k}": F.when(some[k], F.split(text, KINDS[k][0], -1)) for k in KINDS})
    df = df.withColumns({f"__v_{k}": F.when(some[k], F.regexp_extract_all(text, pattern[k], F.lit(g))) if g else F.col(f"__m_{k}") for k, (_, g, _) in KINDS.items()})
    df = df.withColumns({f"__e_{k}": F.when(some[k], running(F.zip_with(F.slice(f"__p_{k}", F.lit(1), F.size(f"__m_{k}")), f"__m_{k}", lambda p, m: F.length(p) + F.length(m)), lambda a, x: a + x, F.lit(0))) for k in KINDS})

    def found(rank: int, kind: str) -> Column:
        least = KINDS[kind][2]
        rows = F.zip_with(F.arrays_zip(F.col(f"__m_{kind}").alias("m"), F.col(f"__v_{kind}").alias("v")), f"__e_{kind}", lambda x, e: F.struct(
            (e - F.length(x["m"])).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end"), x["v"].alias("value")))
        rows = F.filter(rows, lambda x: F.length(x["value"]) >= least)
        if kind == "opaque":
            rows = F.filter(rows, lambda x: x["value"].rlike(OPAQUE) & (F.regexp_count(x["value"], F.lit(DIGITS)) >= LEAST_DIGITS))
        return F.when(some[kind], rows).otherwise(F.expr("array()").cast(CANDIDATES))

    df = df.withColumns({f"__c_{k}": found(i, k) for i, k in enumerate(KINDS)})
    base = F.concat(*(F.col(f"__c_{k}") for k in BASE))
    both = F.when((F.size("__c_opaque") > 0) & (F.size(base) > 0), F.sort_array(F.concat(base, "__c_opaque")))
    helpers = [f"__{x}_{k}" for x in "mpvec" for k in KINDS]
    df = df.withColumn("__both", both)
    return df.withColumn("__cands", F.coalesce(apart(F.col("__both")), F.sort_array(F.concat(base, "__c_opaque")))).drop(*helpers, "__both")


def apart(both: Column) -> Column:
    """Candidates by start without the opaque ones that overlap one of another kind: the base's last end so far and the next start tell."""
    opaque = lambda x: x["kind"] == "opaque"
    ends = running(F.transform(both, lambda x: F.when(opaque(x), F.lit(0)).otherwise(x["end"])), lambda a, x: F.greatest(a, x), F.lit(0))
    far = F.lit(2**31 - 1)
    starts = F.reverse(running(F.reverse(F.transform(both, lambda x: F.when(opaque(x), far).otherwise(x["start"]))), lambda a, x: F.least(a, x), far))
    placed = F.arrays_zip(both.alias("c"), ends.alias("upto"), starts.alias("following"))
    kept = F.filter(placed, lambda x: ~opaque(x["c"]) | ((x["upto"] <= x["c"]["start"]) & (x["following"] >= x["c"]["end"])))
    return F.when(both.isNotNull(), F.transform(kept, lambda x: x["c"]))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(scanned: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repositories, live) of each candidate's value: the distinct owners and repositories that have it.

    scanned: __row, __owner, __repo, __cands. Counted by value, owner and repository first, so copies collapse before they meet.
    """
    each = scanned.select("__owner", "__repo", F.explode("__cands").alias("c")).select("__owner", "__repo", F.sha2("c.value", 256).alias("hash"), F.col("c.value").rlike(PLACEHOLDER).alias("placeholder"))
    pairs = each.groupBy("hash", "__owner", "__repo").agg(F.first("placeholder").alias("placeholder"))
    counts = pairs.groupBy("hash").agg(F.count_distinct("__owner").alias("n_owners"), F.count_distinct("__repo").alias("n_repositories"), F.max("placeholder").alias("placeholder"))
    return counts.select("hash", "n_owners", "n_repositories", ((F.col("n_owners") < WIDE_OWNERS) & (F.col("n_repositories") < WIDE_REPOSITORIES) & ~F.col("placeholder")).alias("live"))


def verdicts(scanned: DataFrame) -> DataFrame:
    """(__row, secrets): each row's candidates with live, n_owners and n_repositories; rows without candidates are left out."""
    owned = written(ownership(scanned), "ownership")
    each = written(scanned.select("__row", F.explode("__cands").alias("c")).select("__row", "c", F.sha2("c.value", 256).alias("hash")), "candidates")
    joined = join_skewed(each, owned, "hash")
    return joined.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("c.start", "c.rank", "c.kind", "c.end", "c.value", "live", "n_owners", "n_repositories"))).alias("secrets"))


def scanned(docs: DataFrame, owner_col: str, repo_col: str, text_col: str, keep: list[str]) -> DataFrame:
    keyed = docs.withColumns({"__row": F.monotonically_increasing_id(), "__owner": F.coalesce(F.col(owner_col).cast("string"), F.lit("")), "__repo": F.coalesce(F.col(repo_col).cast("string"), F.lit(""))})
    wanted = [*dict.fromkeys([*keep, text_col]), "__row", "__owner", "__repo"]
    return written(with_candidates(keyed.select(wanted), text_col).select(*keep, "__row", "__owner", "__repo", "__cands"), "scanned")


def secrets(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, secrets): base spans as found, and all candidates with the corpus's verdict (live, owners, repositories).

    Null and empty texts have none. A null owner or repository is one owner or repository. Repeated rows
    are rows of their own, of one owner and repository. Other columns of docs play no part.
    """
    rows = scanned(docs, owner_col, repo_col, text_col, [id_col])
    base = F.filter("__cands", lambda c: c["kind"] != "opaque")
    return rows.join(verdicts(rows), "__row", "left").select(id_col, base.alias("base"), "secrets")


def spans(docs: DataFrame) -> DataFrame:
    """The digest of secrets(): spans are the base ones and opaque strings that look live."""
    found = secrets(docs)
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rows = F.coalesce(F.filter("secrets", lambda s: (s["kind"] != "opaque") | s["live"]), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,value:string,live:boolean,n_owners:bigint,n_repositories:bigint>>"))
    live = F.size(F.filter(rows, lambda s: s["live"])).cast("long")
    return found.select("doc_id", *map(count, BASE), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(rows).alias("spans"), live.alias("n_live"), (F.size(rows) - live).alias("n_copied"))


def without(text: Column, spans: Column) -> Column:
    """text with MASK for each run of overlapping spans (start, end), which are ascending. Pieces are cut from four bytes a character, so each costs its own length."""
    cut = lambda wide, first, length: F.substring(F.decode(F.concat(F.encode(F.lit(GUARD), "UTF-32"), F.substring(wide, first * 4 + 1, length * 4)), "UTF-32"), F.lit(2), length)

    def of(x: Column) -> Column:
        upto = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        before = let(upto, lambda u: F.concat(F.array(F.lit(0)), F.slice(u, F.lit(1), F.size(u) - 1)))
        pieces = F.zip_with(spans, before, lambda s, b: F.when(s["start"] >= b, F.concat(cut(x, b, s["start"] - b), F.lit(MASK))).otherwise(F.lit("")))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(pieces, ""), cut(x, last, F.length(text) - last))

    return let(F.encode(text, "UTF-32"), of)


def masked(docs: DataFrame, owner_col: str = "source", repo_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with every secret that looks live masked in its text, and the length column renewed; widely copied examples stay.

    Only the value of a match is masked, where it was found: the same characters elsewhere in the text
    stay. Null and empty texts stay as they are. A null owner or repository is one owner or repository.
    Repeated rows are rows of their own and treated alike. An empty table stays empty. Other columns
    stay, whatever their names. Only texts that hold candidates are joined with the verdicts.
    """
    inner = [f"c{i}" for i in range(len(docs.columns))]
    name = dict(zip(docs.columns, inner, strict=True))
    rows = scanned(docs.toDF(*inner), name[owner_col], name[repo_col], name[text_col], inner)
    live = F.transform(F.filter("secrets", lambda s: s["live"]), lambda s: F.struct((s["end"] - F.length(s["value"])).alias("start"), s["end"].alias("end")))
    known = verdicts(rows).select("__row", F.sort_array(live).alias("__live")).where(F.size("__live") > 0)
    text = F.col(name[text_col])
    some = rows.where(F.size("__cands") > 0).join(known, "__row", "left").withColumn(name[text_col], F.when(F.col("__live").isNull(), text).otherwise(without(text, F.col("__live"))))
    if length_col in name:
        length = F.col(name[length_col])
        some = some.withColumn(name[length_col], F.when(F.col("__live").isNull(), length).otherwise(F.length(text).cast(docs.schema[length_col].dataType)))
    return rows.where(F.size("__cands") == 0).select(inner).unionByName(some.select(inner)).toDF(*docs.columns)
