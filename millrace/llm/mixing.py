"""Mixing sources to target weights.

Targets: water is poured into the sources in proportion to their weights; a source that reaches its
cap, ``most`` times its size, is clamped and what it cannot hold goes to the others by weight, until
none is above its cap. Only sums by source and, on the driver, three numbers a round are gathered.

Repetitions: a source's target over its size gives whole repetitions of all its documents and a
fraction of them once more. Documents of that fraction are the first by a seeded hash, up to the
words that are wanted: hash bins of each source are summed, bins below the one where the sum passes
the want are taken whole, and only that one bin is looked at by document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_skewed, written

#: The weights of sources in order, their share of all words, the most repetitions.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = 20240
#: Documents of a source in one hash bin, about; and the most bins. The last bin is the only one that is ordered by document.
IN_BIN, MOST_BINS = 256, 65_536
#: Sources whose few numbers are broadcast; beyond this they are joined by shuffle.
FEW_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Words of a text: where a word character follows the start or a space."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (``__s`` unique, source, __total), with its weight and __target.

    Sources are ordered by code point, null last, and take the weights in turn. If share exceeds what
    the caps allow, every source ends at its cap. Sources of no words have target 0.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = written(sources.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")), "sources")
    total = ranked.agg(F.sum("__total")).first()[0] or 0
    level, cap = 0.0, most * F.col("__total")
    while total:
        # What is clamped at this level stays clamped: the level only rises.
        capped = cap <= F.lit(level) * F.col("__weight")
        held, free = ranked.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("__weight")))).first()
        if not free:
            break
        following = (share * total - (held or 0)) / free
        if following <= level:
            break
        level = following
    return ranked.withColumn("__target", F.when(cap <= F.lit(level) * F.col("__weight"), cap.cast("double")).otherwise(F.lit(level) * F.col("__weight")))


def attach(big: DataFrame, small: DataFrame, key: str, few: int = FEW_SOURCES) -> DataFrame:
    """big left join small on a key that small has once: by broadcast while small is known to be small."""
    if small.count() <= few:
        return big.join(F.broadcast(small), key, "left")
    return join_skewed(big, small, key)


def fill(pool: pd.DataFrame) -> pd.DataFrame:
    """Of a source's last bin, in hash order, each document that still fits; at last one more if that comes nearer."""
    pool = pool.sort_values(["__h", "doc_id", "__size", "__row"], kind="stable")
    gap, extra = int(pool["__gap"].iloc[0]), []
    for size in pool["__size"]:
        fits = 0 < size <= gap
        gap -= size if fits else 0
        extra.append(int(fits))
    over = [(size - gap, i) for i, (size, taken) in enumerate(zip(pool["__size"], extra, strict=True)) if size and not taken]
    if over and min(over)[0] < gap:
        extra[min(over)[1]] = 1
    return pd.DataFrame({"__row": pool["__row"], "__extra": extra})


def binned(rows: DataFrame, aimed: DataFrame) -> DataFrame:
    return attach(rows, aimed, "__s").withColumn("__bin", F.pmod(F.shiftrightunsigned("__h", 16), F.col("__bins")))


def plan(sizes: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """sizes: a written table of __row, __s, source, doc_id, __size and __h.

    Returns what each source gets (__s, __total, __target, __whole, __bins, __last) and, for the rows
    of its last bin, whether they are taken once more (__row, __extra). Rows of lower bins all are,
    those of higher bins are not.
    """
    sources = sizes.groupBy("__s").agg(F.min("source").alias("source"), F.sum("__size").alias("__total"), F.count(F.lit(1)).alias("__n"))
    aimed = targets(sources, **how).withColumns({
        "__whole": F.when(F.col("__total") > 0, F.floor(F.col("__target") / F.col("__total"))).otherwise(0).cast("long"),
        "__bins": F.least(F.greatest(F.ceil(F.col("__n") / IN_BIN), F.lit(1)), F.lit(MOST_BINS)).cast("long"),
    })
    aimed = aimed.withColumn("__want", F.round(F.col("__target") - F.col("__whole") * F.col("__total")).cast("long"))
    aimed = written(aimed.select("__s", "__total", "__target", "__whole", "__bins", "__want"), "targets")
    bins = binned(sizes, aimed).groupBy("__s", "__bin", "__want").agg(F.sum("__size").alias("__sum"))
    upto = bins.withColumn("__upto", F.sum("__sum").over(Window.partitionBy("__s").orderBy("__bin"))).where("__upto > __want")
    last = upto.groupBy("__s").agg(F.min_by(F.struct("__bin", (F.col("__want") - F.col("__upto") + F.col("__sum")).alias("__gap")), "__bin").alias("found"))
    last = last.select("__s", F.col("found.__bin").alias("__last"), F.col("found.__gap").alias("__gap"))
    # No last bin: all of the source is taken once more, or it has no words at all.
    aimed = written(aimed.join(last, "__s", "left").withColumn("__last", F.coalesce("__last", "__bins")).drop("__want"), "last-bins")
    pool = binned(sizes, aimed).where("__bin = __last").select("__row", "__s", "doc_id", "__size", "__h", "__gap")
    return aimed.drop("__gap"), written(pool.groupBy("__s").applyInPandas(fill, "__row bigint, __extra int"), "last-rows")


def repeated(rows: DataFrame, aimed: DataFrame, last_rows: DataFrame) -> DataFrame:
    """rows, with __total, __target and __times, which is 0 where there are no words. Only rows of last bins are joined by row; the others stay where they lie."""
    placed = binned(rows, aimed)
    others = placed.where("__bin <> __last").withColumn("__times", F.col("__whole") + (F.col("__bin") < F.col("__last")).cast("int"))
    pool = placed.where("__bin = __last").join(last_rows, "__row").withColumn("__times", F.col("__whole") + F.col("__extra")).drop("__extra")
    return others.unionByName(pool.select(others.columns)).withColumn("__times", F.when(F.col("__size") > 0, F.col("__times")).otherwise(0))


def keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns({"__row": F.monotonically_increasing_id(), "__s": source_key("source"), "__size": word_count("text"), "__h": F.xxhash64(F.lit(seed), "doc_id", "text")})


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken, repetitions) of each row of docs.

    Null and empty texts have size 0 and nothing taken. Null is a source like any other. Repeated rows
    are rows of their own. An empty table mixes to an empty one. Columns beyond doc_id, text and
    source play no part. The same rows and seed give the same mix.
    """
    sizes = written(keyed(docs.select("doc_id", "text", "source"), seed).drop("text"), "sizes")
    out = repeated(sizes, *plan(sizes))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__total").alias("source_size"), F.coalesce("__target", F.lit(0.0)).alias("target"), (F.col("__size") * F.col("__times")).alias("taken"), F.col("__times").alias("repetitions"))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The rows of docs, whole and with their own columns, as often as the mix repeats them; those it does not take are gone.

    Null and empty texts have no words, so they are never taken; null is a source like any other.
    Repeated rows are rows of their own. An empty table stays empty. Columns of docs stay, whatever their names.
    """
    inner = ["doc_id" if c == "doc_id" else "text" if c == "text" else "source" if c == "source" else f"c{i}" for i, c in enumerate(docs.columns)]
    full = written(keyed(docs.toDF(*inner), seed), "mix-documents")
    out = repeated(full, *plan(full.select("__row", "__s", "source", "doc_id", "__size", "__h")))
    return out.select(*inner, F.explode(F.array_repeat(F.lit(0), F.col("__times").cast("int")))).select(inner).toDF(*docs.columns)
