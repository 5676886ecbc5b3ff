"""Records of CSV text that may hold line breaks, found by all tasks at once.

Spark cuts a file into blocks at line ends, wherever these lie. Whether a block begins inside a quoted
field is not known to the task that reads it, but what it makes of either beginning is: each block says
in which state it ends, if it began outside and if inside quotes. Composed in order these give every
block its beginning; then each task puts its lines together to records. A record that spans blocks
leaves one fragment in each, and only fragments are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a task hands on at once.
ROWS = 4096


def line_ends(separator: str = ","):
    """(line, inside) -> whether the line ends inside quotes, if it begins inside or outside them.

    A quote opens a field only at its start; within quotes two stand for one; what follows a closed field
    up to the separator is taken as it is.
    """
    sep = re.escape(separator)
    closes = re.compile('(?:[^"]|"")*+"')
    opens = re.compile(f'{sep}"')

    def ends(line: str, inside: bool) -> bool:
        at = 0
        if '"' not in line:
            return inside
        while True:
            if inside:
                found = closes.match(line, at)
                if not found:
                    return True
                at, inside = found.end(), False
            if at == 0 and line[:1] == '"':
                at, inside = 1, True
                continue
            found = opens.search(line, at)
            if not found:
                return False
            at, inside = found.end(), True

    return ends


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, block, line) of all lines in order within their block, which is where Spark began to read."""
    found = spark.read.option("lineSep", "\n").option("encoding", encoding).text(path)
    return found.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Runs of lines of one block. A task reads a block's lines one after the other; a block may come in several runs, of which all follow each other."""
    for batch in batches:
        files, blocks, texts = (batch.column(c).to_pylist() for c in ("file", "block", "line"))
        at = 0
        for i in range(1, len(texts) + 1):
            if i == len(texts) or (files[i], blocks[i]) != (files[at], blocks[at]):
                yield (files[at], blocks[at]), texts[at:i]
                at = i


def block_ends(found: DataFrame, separator: str) -> DataFrame:
    """(file, block, outside, inside): whether the block ends inside quotes, by how it begins."""

    def run(batches):
        ends, state = line_ends(separator), {}
        for key, texts in by_block(batches):
            outside, inside = state.get(key, (False, True))
            for line in texts:
                if '"' in line:
                    outside, inside = ends(line, outside), ends(line, inside)
            state[key] = (outside, inside)
        keys = list(state)
        yield pa.RecordBatch.from_pydict({"file": [k[0] for k in keys], "block": [k[1] for k in keys], "outside": [state[k][0] for k in keys], "inside": [state[k][1] for k in keys]}, schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())]))

    return found.mapInArrow(run, "file string, block long, outside boolean, inside boolean")


def beginnings(ends: DataFrame) -> dict[tuple[str, int], bool]:
    """Whether each block begins inside quotes. There is a row for each block, of some 128 MB, which the driver composes in order."""
    out, file, inside = {}, None, False
    for row in ends.orderBy("file", "block").toLocalIterator():
        if row["file"] != file:
            file, inside = row["file"], False
        out[file, row["block"]] = inside
        inside = row["inside"] if inside else row["outside"]
    return out


def records(spark: SparkSession, path: str, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """(file, first, record): every record of the files at path; first marks a file's first one. Empty lines outside quotes are none.

    Records end with \\n or \\r\\n; within quotes both stay as they are. An empty file has no records.
    """
    found = lines(spark, path, encoding)
    known = spark.sparkContext.broadcast(beginnings(block_ends(found, separator)))

    def run(batches):
        ends, began = line_ends(separator), known.value
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("first", pa.bool_()), ("place", pa.int8()), ("record", pa.string())])
        out = []

        def made():
            batch = pa.RecordBatch.from_pydict({f.name: [r[i] for r in out] for i, f in enumerate(schema)}, schema=schema)
            out.clear()
            return batch

        def close(key, held, whole, first, head):
            """place: 0 a record, 1 what goes on from earlier blocks, 2 what goes on in later ones, 3 both."""
            place = (0 if whole else 2) + (1 if head else 0)
            text = "\n".join(held)
            if place or text not in ("", "\r"):
                out.append((*key, first, place, text[:-1] if whole and text.endswith("\r") else text))

        key, held, inside, head, fresh = None, [], False, False, False
        for own, texts in by_block(batches):
            if own != key:
                if held:
                    close(key, held, False, fresh, head)
                if own not in began:
                    raise RuntimeError("files are cut into other blocks than before: the settings for reading have changed, read them again")
                key, held, inside = own, [], began[own]
                head, fresh = inside, own[1] == 0
            for line in texts:
                held.append(line)
                inside = ends(line, inside)
                if not inside:
                    close(key, held, True, fresh, head)
                    if fresh and any(x not in ("", "\r") for x in held):
                        fresh = False
                    held, head = [], False
            if len(out) >= ROWS:
                yield made()
        if held:
            close(key, held, False, fresh, head)
        yield made()

    cut = found.mapInArrow(run, "file string, block long, first boolean, place byte, record string")
    # A fragment belongs to the nearest earlier block that began a record it did not end.
    owner = F.last(F.when(F.col("place") == 2, F.col("block")), ignorenulls=True).over(Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, 0))
    parts = cut.where("place > 0").withColumn("owner", owner)
    joined = parts.groupBy("file", "owner").agg(F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("block", "record"))).alias("parts"))
    joined = joined.select("file", "first", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return cut.where("place = 0").select("file", "first", "record").unionByName(joined)
