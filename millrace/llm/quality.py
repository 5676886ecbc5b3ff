"""Quality rules whose cutoffs come with a guarantee.

Each rule measures a share between 0 and 1 (symbols, shouting, capitals, repeated windows, repeated
lines), and a document's score is its worst share in hundredths, 0 to 100. A cutoff c rejects scores
of c and more. Labelled documents serve as a holdout, each different text of a stratum as one trial,
as copies prove nothing more: for each stratum the cutoffs 100, 99, ... are tested in that fixed order
against the hypothesis that more than ``risk`` of good texts would be rejected, with the exact
binomial tail (the Clopper-Pearson bound) at level delta / strata. What the base rules reject is not
part of the bound. Testing
stops at the first cutoff that cannot be certified, so with probability 1 - delta every certified
cutoff of every stratum keeps to the risk (fixed sequences within a stratum, Bonferroni across).
Among the certified cutoffs the one that rejects most poor documents, net of ``weight`` for each good
one, is used; where none helps, or the labels are too few, the method rejects nothing.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, drop, fresh, join_skewed, map_batches, texts, written

#: Fixed values of the base rules: symbols, window length, least words, most repeated words in hundredths.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED = "#*$%&|<>", 8, 20, 30
#: Most good documents of a stratum that may be rejected, the chance that any stratum breaks this, the cost of a good one in poor ones.
RISK, DELTA, WEIGHT = 0.02, 0.05, 10.0
#: Strata whose cutoffs are broadcast; beyond this they are joined by shuffle.
FEW_STRATA = 10_000
#: Runs of capitals, by the languages' letters up to U+00DE.
CAPITALS = re.compile("[A-Z\\u00c0-\\u00d6\\u00d8-\\u00de]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "rule_score")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    if len(seen) == len(words):
        return 0
    size, counts = 1, np.bincount(codes)
    while size < window:  # codes of runs of twice the length, until they have the window's
        step = min(size, window - size)
        pairs = codes[:-step] * np.int64(len(words) + 1) + codes[step:]
        _, codes, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(codes):
            return 0
        size += step
    again = counts[codes] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[:n] += again
    edges[window : window + n] -= again
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def measures(text: str) -> tuple[int, int, int, int, int, int]:
    """COUNTS of one text."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    capitals = sum(map(len, CAPITALS.findall(text)))
    n = max(1, len(words))
    worst = max(symbols / n, text.count("!") / n, capitals / max(1, chars), repeats / n, dup_lines / max(1, len(lines)))
    return len(words), chars, symbols, dup_lines, repeats, min(100, int(100 * worst))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly: the regularised incomplete beta function I(1-p; n-k, k+1) by its continued fraction."""
    if k >= n:
        return 1.0
    return beta_share(n - k, k + 1, 1 - p)


def beta_share(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 100_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + t / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h


def upper_bound(k: int, n: int, delta: float) -> float:
    """The Clopper-Pearson upper bound of a share of which k in n were seen."""
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > delta else (low, mid)
    return high


def best_cutoff(good: Iterable[int], poor: Iterable[int], level: float, risk: float = RISK, weight: float = WEIGHT) -> int:
    """good, poor: labelled documents by score, 0 to 100. The cutoff to use, 101 for none."""
    good, poor = list(good), list(poor)
    n, k, hits, best, most = sum(good), 0, 0, 101, 0.0
    for cutoff in range(100, 0, -1):
        k, hits = k + good[cutoff], hits + poor[cutoff]
        if not n or binomial_cdf(k, n, risk) > level:
            break
        if hits - weight * k > most:
            best, most = cutoff, hits - weight * k
    return best


def features(docs: DataFrame, keep: list[str], into: str = "q", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and a struct column ``into`` with COUNTS of each whole text."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in keep}

    def make():
        kind = pa.struct([(c, pa.int64()) for c in COUNTS])

        def each(batch: pa.RecordBatch) -> dict:
            return {c: batch.column(c) for c in keep} | {into: pa.array([dict(zip(COUNTS, measures(x), strict=True)) for x in texts(batch, text_col)], type=kind)}

        return each

    schema = ", ".join([*(f"`{c}` {k}" for c, k in kinds.items()), f"`{into}` struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>"])
    return map_batches(docs.select(*dict.fromkeys([*keep, text_col])), make, schema)


def stratum(column: str):
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def measured(docs: DataFrame, stratum_col: str) -> DataFrame:
    """Written: (id, s, same, q) of each row of docs: its stratum, a digest of its text and its counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").alias("id"), stratum(stratum_col).alias("s"), F.md5(text).alias("same"), text.alias("text"))
    return written(features(slim, ["id", "s", "same"]), "measured")


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, weight: float = WEIGHT) -> DataFrame:
    """Written: (s, cutoff) for each stratum of rows (id, s, same, q); 101 where nothing is rejected.

    labels: doc_id and quality, 1 good and 0 poor; of repeated labels the least counts, nulls do not.
    All labelled rows count, but those of a stratum with the same text are one trial, poor if one of
    them is. What is gathered is one count for each stratum, score and label.
    """
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    trials = rows.join(known, "id").groupBy("s", "same").agg(F.min("quality").alias("quality"), F.first("q.rule_score").alias("score"))
    by_score = trials.groupBy("s", "score").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("poor"))
    strata = rows.select("s").distinct().count()

    def choose(found: pd.DataFrame) -> pd.DataFrame:
        table = found.set_index("score").reindex(range(101), fill_value=0)
        return pd.DataFrame({"s": [found["s"].iloc[0]], "cutoff": [best_cutoff(table["good"], table["poor"], delta / strata, risk, weight)]})

    return written(by_score.groupBy("s").applyInPandas(choose, "s string, cutoff int"), "cutoffs")


def failed(q) -> Column:
    """Whether the base rules reject a document of these counts."""
    return (q.n_words < LEAST_WORDS) | (100 * q.n_repeat_words > MOST_REPEATED * q.n_words)


def rules(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """(doc_id, counts, base_failed, kept, rule_score, cutoff) of each row of docs.

    Null and empty texts have no words, so they fail the base rules. A null stratum is a stratum of
    its own; one without labels has no cutoff. Repeated rows are judged alike. Without documents or
    labels the result is empty or rests on the base rules alone. Columns of docs beyond doc_id, text
    and the stratum are not looked at.
    """
    rows = measured(docs, stratum_col)
    learned = cutoffs(rows, labels)
    joined = rows.join(F.broadcast(learned), "s", "left") if learned.count() <= FEW_STRATA else join_skewed(rows, learned, "s")
    q, cutoff = F.col("q"), F.coalesce("cutoff", F.lit(101))
    return joined.select(F.col("id").alias("doc_id"), *(F.col(f"q.{c}") for c in COUNTS[:5]), failed(q).alias("base_failed"), (~failed(q) & (q.rule_score < cutoff)).alias("kept"), q.rule_score.cast("int").alias("rule_score"), cutoff.alias("cutoff"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """The rows of docs, whole and with all their columns, that rules() keeps.

    Cutoffs are learned first, from counts; then texts are measured again where they lie, so no text is
    shuffled. Null and empty texts go, as they have no words. Repeated rows stay or go together, and a
    null stratum is one of its own. An empty table stays empty; without labels the base rules decide
    alone. Columns of docs stay as they are, whatever their names.
    """
    rows = measured(docs, stratum_col)
    learned = cutoffs(rows, labels)
    drop(rows)
    q_col, s_col, cutoff_col = fresh(docs, "q", "s", "cutoff")
    found = features(docs.withColumn(s_col, stratum(stratum_col)), [*docs.columns, s_col], q_col)
    learned = learned.toDF(s_col, cutoff_col)
    joined = found.join(F.broadcast(learned), s_col, "left") if learned.count() <= FEW_STRATA else join_skewed(written(found, "measured"), learned, s_col)
    q = F.col(q_col)
    return joined.where(~failed(q) & (q.rule_score < F.coalesce(cutoff_col, F.lit(101)))).select(docs.columns)
