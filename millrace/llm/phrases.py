"""Phrases that occur together, mined by contiguous pattern growth.

Frequent words are counted first, then frequent pairs of neighbouring frequent words. Every occurrence
of a frequent pair is a pointer from which its prefix can grow to the right; pointers carry the codes of
the words that follow, cut where no frequent pair leads on. Pointers of one prefix are dealt to one task
in sorted order, so that each longer prefix is a stretch of neighbouring rows: the task grows prefixes
depth first as it reads, and holds one branch at a time, however often a prefix occurs. The few prefixes
that hold a thousandth of all pointers are dealt by all their words, and their sums are added up.

A word's code is a hash of its language and itself; all words of the corpus are checked to have codes of
their own, else another seed is taken, so counts are exact. What mapping tasks know of frequent words and
pairs is a bit table of fixed size: a wrong bit costs a needless pointer, never a result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, as_array, bounded, drop, join_skewed, trim, written

#: Least occurrences, words of the longest phrase, percent of occurrences at which a longer phrase absorbs, phrases of a language, the language of null.
LEAST, LONGEST, ABSORB, TOP, UNKNOWN = 30, 4, 80, 2000, "und"
#: The characters that end a piece; words are what spaces and tabs separate.
BREAKS = b".,;:!?\n\x0b\x0c\r"
SCALE = 2_000_000
#: Characters of text that are counted together; bits of a bit table; rows that a growing task takes at once.
CHUNK, BITS, ROWS = 8 << 20, 1 << 26, 1 << 17
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + BREAKS, b"abcdefghijklmnopqrstuvwxyz" + b"." * len(BREAKS))
#: A prefix that holds one part in so many of all pointers is hot.
SHARE = 1000


def chunks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[dict[str, list[str]]]:
    """Texts by language, of ``most`` characters or a batch more at a time."""
    found, size = {}, 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                found.setdefault(UNKNOWN if lang is None else lang, []).append(text)
                size += len(text)
        if size >= most:
            yield found
            found, size = {}, 0
    if size:
        yield found


def word_ids(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and all words of the texts as places among them; 0 is a break."""
    words = b" . ".join([t.encode() for t in texts]).translate(FOLD).replace(b".", b" . ").split()
    seen: dict[bytes, int] = {b".": 0}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    return list(seen), ids


def codes_of(lang: str, words: list[bytes], seed: int) -> np.ndarray:
    """Signed 64-bit codes; 0 for the break, which comes first."""
    mark = lang.encode() + b" "
    out = np.fromiter((xxhash.xxh3_64_intdigest(mark + w, seed) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)
    out[0] = 0
    return out


def slot_of(*codes: Column) -> Column:
    """The place of a word's or a pair's code in a bit table."""
    mixed = codes[0] if len(codes) == 1 else codes[0].bitwiseXOR(F.shiftrightunsigned(codes[1], 31))
    return mixed.bitwiseAND(F.lit(BITS - 1))


def bit_table(df: DataFrame, *codes: str):
    """A broadcast table of BITS bits, set where a row of df has its codes; made of one row for each 64 bits."""
    slot = slot_of(*map(F.col, codes))
    set_ = df.select(F.shiftrightunsigned(slot, 6).alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = set_.groupBy("at").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    table = np.zeros(BITS // 64, dtype=np.int64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return df.sparkSession.sparkContext.broadcast(table.tobytes())


def has(table: np.ndarray, *codes: np.ndarray) -> np.ndarray:
    """Whether the table, as bytes, has the bits of these words or pairs; slot_of() in numpy."""
    mixed = codes[0] if len(codes) == 1 else codes[0] ^ (codes[1].view(np.uint64) >> np.uint64(31)).view(np.int64)
    places = mixed & (8 * len(table) - 1)
    return (table[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def by_chunk(docs: DataFrame, make: Callable[[], Callable[[str, list[bytes], np.ndarray], dict]], schema: str) -> DataFrame:
    """The columns that make()(lang, distinct words, ids) gives for each language of each chunk of docs."""
    arrow = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for found in chunks(batches, CHUNK):
            for lang, texts in found.items():
                out = each(lang, *word_ids(texts))
                yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in arrow], schema=arrow)
        trim()

    return bounded(docs).mapInArrow(run, schema)


def vocabulary(docs: DataFrame, seed: int) -> DataFrame:
    """(code, lang, word, f, clash) of all words."""

    def make():
        def each(lang, words, ids):
            counts = np.bincount(ids, minlength=len(words))
            return {"code": codes_of(lang, words, seed)[1:], "lang": [lang] * (len(words) - 1), "word": words[1:], "f": counts[1:]}

        return each

    spelt = F.struct("lang", "word")
    own = by_chunk(docs, make, "code long, lang string, word binary, f long").groupBy("code")
    own = own.agg(F.sum("f").alias("f"), F.min(spelt).alias("least"), F.max(spelt).alias("most"))
    return own.select("code", "least.lang", "least.word", "f", ((F.col("least") != F.col("most")) | (F.col("code") == 0)).alias("clash"))


def frequent_ids(lang: str, words: list[bytes], ids: np.ndarray, seed: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by id, and the ids with 0 in place of words that are not frequent."""
    codes = codes_of(lang, words, seed)
    kept = has(known, codes)
    kept[0] = False
    return codes, np.where(kept[ids], ids, 0)


def pairs(docs: DataFrame, seed: int, frequent) -> DataFrame:
    """(c0, c1, a) of neighbouring frequent words."""

    def make():
        known = np.frombuffer(frequent.value, dtype=np.uint8)

        def each(lang, words, ids):
            codes, ids = frequent_ids(lang, words, ids, seed, known)
            both = (ids[:-1] > 0) & (ids[1:] > 0)
            found, n = np.unique(ids[:-1][both] * len(words) + ids[1:][both], return_counts=True)
            return {"c0": codes[found // len(words)], "c1": codes[found % len(words)], "a": n}

        return each

    return by_chunk(docs, make, "c0 long, c1 long, a long").groupBy("c0", "c1").agg(F.sum("a").alias("a"))


def pointers(docs: DataFrame, seed: int, frequent, frequent_pairs, longest: int) -> DataFrame:
    """(c0, c1, ..., n): where a frequent pair can grow, the codes of up to ``longest`` words from there, 0 after the last that a frequent pair leads to; n alike."""
    columns = [f"c{i}" for i in range(longest)]

    def make():
        known, known_pairs = (np.frombuffer(x.value, dtype=np.uint8) for x in (frequent, frequent_pairs))

        def each(lang, words, ids):
            codes, ids = frequent_ids(lang, words, ids, seed, known)
            own = codes[ids]
            leads = np.zeros(len(ids) + longest, dtype=bool)  # whether a place and the next hold a frequent pair
            leads[: len(ids) - 1] = (ids[:-1] > 0) & (ids[1:] > 0) & has(known_pairs, own[:-1], own[1:])
            at = np.flatnonzero(leads[:-1] & leads[1:])
            padded, key, open_ = np.concatenate([ids, np.zeros(longest, dtype=np.int64)]), ids[at], np.ones(len(at), dtype=bool)
            row = [key]
            for i in range(1, longest):
                open_ = open_ & leads[at + i - 1]
                row.append(np.where(open_, padded[at + i], 0))
                key = np.unique(key * len(words) + row[-1], return_inverse=True)[1]
            first, n = np.unique(key, return_index=True, return_counts=True)[1:]
            return {c: codes[r[first]] for c, r in zip(columns, row, strict=True)} | {"n": n}

        return each

    return by_chunk(docs, make, ", ".join(f"{c} long" for c in columns) + ", n long")


def grow(rows: np.ndarray, n: np.ndarray, least: int, hot: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Prefixes of three words and more in sorted rows, with their sums: those of ``least`` occurrences, which alone are extended; of hot rows all, as others hold a part of them."""
    out = []
    for depth in range(3, rows.shape[1] + 1):
        alive = rows[:, depth - 1] != 0
        rows, n, hot = rows[alive], n[alive], hot[alive]
        if not len(rows):
            break
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:, :depth] != rows[:-1, :depth]).any(axis=1)
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(n, starts)
        kept = (sums >= least) | hot[starts]
        found = rows[starts[kept]].copy()
        found[:, depth:] = 0
        out.append((found, sums[kept]))
        stays = np.repeat(kept, np.diff(np.append(starts, len(rows))))
        rows, n, hot = rows[stays], n[stays], hot[stays]
    return out


def grown(found: DataFrame, hot_pairs: DataFrame, least: int, longest: int) -> DataFrame:
    """(c0, c1, ..., a) of all phrases of three words and more: one task for a prefix, rows of hot prefixes by all their words."""
    columns = [f"c{i}" for i in range(longest)]
    schema = ", ".join(f"{c} long" for c in columns) + ", a long"
    arrow = arrow_schema(found.sparkSession, schema)
    marked = found.join(F.broadcast(hot_pairs.select("c0", "c1", F.lit(True).alias("hot"))), ["c0", "c1"], "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = marked.repartition("c0", "c1", *(F.when(F.col("hot"), F.col(c)).otherwise(F.lit(0)) for c in columns[2:])).sortWithinPartitions(*columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows, n, hot):
            for codes, sums in grow(rows, n, least, hot):
                yield pa.RecordBatch.from_arrays([pa.array(codes[:, i]) for i in range(longest)] + [pa.array(sums)], schema=arrow)

        held, size = [], 0
        for batch in batches:
            held.append((np.stack([batch.column(c).to_numpy() for c in columns], axis=1), batch.column("n").to_numpy(), batch.column("hot").to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size >= ROWS:
                rows, n, hot = (np.concatenate(x) for x in zip(*held, strict=True))
                end = int(np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1)).max(initial=-1)) + 1
                yield from made(rows[:end], n[:end], hot[:end])
                # The last branch may go on: it is kept, equal rows as one.
                tail, where = np.unique(rows[end:], axis=0, return_inverse=True)
                held, size = [(tail, np.bincount(where.ravel(), n[end:]).astype(np.int64), np.repeat(hot[-1:], len(tail)))], len(tail)
        if held:
            yield from made(*(np.concatenate(x) for x in zip(*held, strict=True)))
        trim()

    return bounded(dealt).mapInArrow(run, schema).groupBy(*columns).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Written tables: (g, a) of all phrases of 2 to ``longest`` (at least 3) words that occur ``least`` times, g their words' codes; (code, lang, word, f) of all words.

    Null and empty texts have no words; null is the language UNKNOWN; repeated rows count each.
    """
    docs, seed = docs.select("text", "lang"), 0
    while (words := written(vocabulary(docs, seed), "words")).where("clash").limit(1).count():
        drop(words)
        seed += 1
    common = bit_table(words.where(F.col("f") >= least), "code")
    two = written(pairs(docs, seed, common).where(F.col("a") >= least), "pairs")
    common_pairs = bit_table(two, "c0", "c1")
    total = two.agg(F.sum("a")).first()[0] or 0
    found = pointers(docs, seed, common, common_pairs, longest)
    more = grown(found, two.where(F.col("a") * SHARE >= total), least, longest)
    columns = [F.col(f"c{i}") for i in range(longest)]
    made = two.select(F.array("c0", "c1").alias("g"), "a").unionByName(more.select(F.filter(F.array(*columns), lambda c: c != 0).alias("g"), "a"))
    out = written(made, "phrases")
    drop(two)
    return out, words.drop("clash")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, absorb: int = ABSORB, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases by score.

    A phrase is dropped if a longer one holds its words and occurs ``absorb`` percent as often. Its score
    is that of the cut at which its parts are the most frequent. Rows of docs as phrases() has them; an
    empty table has no phrases; columns beyond text and lang play no part.
    """
    all_, words = phrases(docs, least, longest)
    exact = "decimal(38,0)"
    m = F.size("g")
    inner = F.explode(F.expr("flatten(transform(sequence(2, size(g) - 1), n -> transform(sequence(1, size(g) - n + 1), i -> slice(g, i, n))))"))
    longer = all_.where(m > 2).select(inner.alias("g"), F.col("a").alias("b")).groupBy("g").agg(F.max("b").alias("b"))
    kept = all_.join(longer, "g", "left").where(F.col("b").isNull() | (F.col("b").cast(exact) * 100 < F.col("a").cast(exact) * absorb)).drop("b")
    kept = written(kept, "kept-phrases")

    cuts = F.expr("flatten(transform(sequence(1, size(g) - 1), k -> array(struct(k, true as head, slice(g, 1, k) as part), struct(k, false as head, slice(g, k + 1, size(g) - k) as part))))")
    parts = written(kept.select("g", "a", F.explode(cuts).alias("cut")).select("g", "a", "cut.*"), "phrase-parts")
    counts = all_.select(F.col("g").alias("part"), F.col("a").alias("f")).unionByName(words.where(F.col("f") >= least).select(F.array("code").alias("part"), "f"))
    by_cut = join_skewed(parts, counts, "part").groupBy("g", "k").agg(F.first("a").alias("a"), *(F.max(F.when(F.col("head") == h, F.col("f"))).alias(c) for h, c in ((True, "l"), (False, "r"))))
    scored = by_cut.withColumn("score", F.expr(f"(cast(a as {exact}) * {SCALE}) div (cast(l as {exact}) + r)"))
    scored = scored.groupBy("g").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best")).select("g", "best.*")

    spelt = written(kept.select("g", F.posexplode("g").alias("i", "code")), "phrase-words")
    spelt = join_skewed(spelt, words.select("code", "lang", "word"), "code").groupBy("g").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("i", "word"))).alias("words"))
    spelt = spelt.select("g", "lang", F.array_join(F.transform("words", lambda w: w["word"].cast("string")), " ").alias("phrase"))
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.join(spelt, "g").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
