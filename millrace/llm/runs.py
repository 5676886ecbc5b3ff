"""Periodic runs of words: stretches that repeat themselves with a period.

A document's words become ids, and the ids are compared with themselves shifted by every lag up to
half their number, many lags at once. Where at least a lag's number of neighbouring comparisons hold,
the stretch has that lag as a period and is at least two periods long. A stretch that is found at
several lags has the least of them as its smallest period; the others are its multiples.

Lags of a document are independent of each other, so long documents are dealt out as ranges of lags of
about ``WORK`` comparisons, which all machines share; what they find is brought together by document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts, written

#: Shortest run in words, and the fewest periods in one.
LEAST, PERIODS = 12, 2
#: Comparisons in one range of lags, and of those that are held at once (a byte each).
WORK, HELD = 1 << 26, 1 << 22
DIGEST = "start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def tampered(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, from a place on overwritten by their own repetition, in a tenth of all ids; a null id's words stay."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + period] * ((n - a) // period + 1))[: n - a]


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int32, count=len(words))


def most_lag(n: int) -> int:
    return n // PERIODS if n >= LEAST else 0


def stretches(ids: np.ndarray, first: int, last: int) -> np.ndarray:
    """(start, length, lag) of all stretches of at least LEAST words and PERIODS lags that have a lag from first to last as a period, rows by lag and start."""
    n, out = len(ids), []
    last = min(last, most_lag(n))
    if len(np.unique(ids)) == n:
        return np.zeros((0, 3), dtype=np.int64)
    while first <= last:
        many = max(1, min(last - first + 1, HELD // n))
        padded = np.concatenate([ids[first:], np.full(many, -1, dtype=np.int32)])
        same = np.lib.stride_tricks.sliding_window_view(padded, n - first)[:many] == ids[: n - first]
        lags = np.arange(first, first + many)
        need = np.maximum(lags * (PERIODS - 1), LEAST - lags)
        for i in np.flatnonzero(same.sum(axis=1) >= need).tolist():
            edges = np.flatnonzero(np.diff(np.concatenate([[False], same[i], [False]]).astype(np.int8)))
            begins, ends = edges[::2], edges[1::2]
            long = ends - begins >= need[i]
            found = begins[long]
            out.append(np.stack([found, ends[long] - found + lags[i], np.full(len(found), lags[i])], axis=1))
        first += many
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), dtype=np.int64)


def smallest(found: np.ndarray) -> np.ndarray:
    """Rows of (start, length, period), each stretch once with its least period, by start and period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), dtype=bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def digest(words: list[bytes], runs: np.ndarray) -> tuple:
    """(n_runs, and the columns of DIGEST) for a document's words and runs."""
    hidden = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(hidden, runs[:, 0] + runs[:, 2], 1)
    np.add.at(hidden, runs[:, 0] + runs[:, 1], -1)
    kept = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(hidden)[:-1] == 0).tolist()])
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    longest = (None,) * 4
    if len(runs):
        start, length, period = min(runs.tolist(), key=lambda r: (-r[1], r[0], r[2]))
        longest = (start, length, period, 1000 * length // period)
    return len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


NAMES = ("n_runs", *(x.split()[0] for x in DIGEST.split(", ")))


def long_text(text: str, work: int) -> Column:
    """Whether a text has more words than one range of lags can compare; only texts with so many bytes are counted, null texts have none."""
    most = int((work * PERIODS) ** 0.5)
    return F.coalesce(F.when(F.octet_length(text) > 2 * most, F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")) > most), F.lit(False))


def lag_ranges(n: int, work: int) -> list[tuple[int, int]]:
    """(first, last) lags of the ranges, of about ``work`` comparisons each."""
    each = max(1, work // max(1, n))
    return [(i, min(i + each - 1, most_lag(n))) for i in range(1, most_lag(n) + 1, each)]


def runs(docs: DataFrame, change=tampered, work: int = WORK) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row of docs.

    change: words and doc_id -> the words to search; None to search them as they are. Words that runs
    repeat after their first period are what collapsed_sha256 leaves out. Null and empty texts have no
    words, so no runs and the digests of nothing. Rows with a null id are searched unchanged; repeated rows are
    rows of their own; an empty table stays empty; columns beyond doc_id and text play no part.
    """
    own = docs.select("doc_id", "text")
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_runs long, {DIGEST}"
    change = change or (lambda words, doc_id: words)

    def make_whole():
        def each(batch: pa.RecordBatch) -> dict:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                words = change(text.encode().split(), doc_id)
                ids = word_ids(words)
                rows.append(digest(words, smallest(stretches(ids, 1, len(ids)))))
            return {"doc_id": batch.column("doc_id")} | dict(zip(NAMES, map(list, zip(*rows, strict=True)), strict=True))

        return each

    def make_ranges():
        def each(batch: pa.RecordBatch) -> dict:
            out = {"row": [], "part": [], "first": [], "last": [], "ids": []}
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                ids = word_ids(change(text.encode().split(), doc_id))
                for part, (first, last) in enumerate(lag_ranges(len(ids), work)):
                    for name, value in (("row", row), ("part", part), ("first", first), ("last", last), ("ids", ids.tobytes())):
                        out[name].append(value)
            return out

        return each

    def make_stretches():
        def each(batch: pa.RecordBatch) -> dict:
            rows = [batch.column(c).to_pylist() for c in ("row", "first", "last", "ids")]
            found = [(row, stretches(np.frombuffer(ids, dtype=np.int32), first, last)) for row, first, last, ids in zip(*rows, strict=True)]
            return {"row": [row for row, f in found for _ in range(len(f))]} | {name: np.concatenate([f[:, i] for _, f in found]) for i, name in enumerate(("start", "length", "period"))}

        return each

    def make_joined():
        def each(batch: pa.RecordBatch) -> dict:
            rows = []
            for doc_id, text, found in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("found").to_pylist(), strict=True):
                words = change(text.encode().split(), doc_id)
                got = np.array([(r["start"], r["length"], r["period"]) for r in found or []], dtype=np.int64).reshape(-1, 3)
                rows.append(digest(words, smallest(got)))
            return {"doc_id": batch.column("doc_id")} | dict(zip(NAMES, map(list, zip(*rows, strict=True)), strict=True))

        return each

    whole = map_batches(own.where(~long_text("text", work)), make_whole, schema)
    long = written(own.where(long_text("text", work)).withColumn("row", F.monotonically_increasing_id()), "long-documents")
    ranges = map_batches(long, make_ranges, "row long, part int, first long, last long, ids binary").repartition("row", "part")
    found = map_batches(ranges, make_stretches, "row long, start long, length long, period long")
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))  # fewer stretches by far than words
    return whole.unionByName(map_batches(long.join(by_row, "row", "left").select("doc_id", "text", "found"), make_joined, schema))
