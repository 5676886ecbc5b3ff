"""Parquet tables: directories that are replaced as a whole, and facts about them."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import numbered

#: Bytes from which a file is large, rows of an ingest batch and of a run batch.
LARGE_FILE_BYTES, INGEST_ROWS, RUN_ROWS = 104_857_600, 100_000, 100_000
PLACE, AT = "__place", "__at"
#: Shared folders of our own by application: the setting itself is fixed once a session runs.
OWN: dict[str, str] = {}


def swap_in(staged: Path, target: Path) -> None:
    """Puts a finished directory in another's place; the other goes only when the new one stands."""
    target.parent.mkdir(parents=True, exist_ok=True)
    settled(target)
    old = target.with_name(f"{target.name}.old-{uuid.uuid4().hex}")
    if target.exists():
        os.replace(target, old)
    os.replace(staged, target)
    if old.is_dir():
        shutil.rmtree(old)
    elif old.exists():
        old.unlink()


def settled(target: Path) -> Path:
    """target, put back if a replacement was cut off between its two renames; the table that was there before stands again."""
    target = Path(target)
    if not target.exists() and (left := sorted(target.parent.glob(f"{target.name}.old-*"), key=lambda p: p.stat().st_mtime)):
        os.replace(left[-1], target)
    return target


def staging_for(target: Path) -> Path:
    return target.with_name(f"{target.name}.staging-{uuid.uuid4().hex}")


def publish(df: DataFrame, target: Path, block_bytes: int | None = None) -> int:
    """Writes df where target is, even if df reads target; returns the rows, counted during the write.

    On failure target is as before. DataFrames that were built on the old files must be built anew.
    """
    target, staged, seen = Path(target), staging_for(Path(target)), Observation()
    staged.parent.mkdir(parents=True, exist_ok=True)
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    try:
        writer.parquet(str(staged))
        swap_in(staged, target)
    except BaseException:
        shutil.rmtree(staged, ignore_errors=True)
        raise
    return int(seen.get.get("rows", 0))


class TableWriter:
    """Appends frames to a table that appears only when it is closed; nothing remains of an aborted one."""

    def __init__(self, target: Path):
        self.target, self.staged = Path(target), staging_for(Path(target))
        self.rows, self.columns = 0, 0

    def append(self, df: DataFrame) -> None:
        seen = Observation()
        self.staged.parent.mkdir(parents=True, exist_ok=True)
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("append").parquet(str(self.staged))
        self.rows, self.columns = self.rows + int(seen.get.get("rows", 0)), len(df.columns)

    def close(self) -> tuple[int, int]:
        if self.staged.exists():
            swap_in(self.staged, self.target)
        return self.rows, self.columns

    def abort(self) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)

    def __enter__(self) -> TableWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        self.abort() if kind else self.close()


def parts(path: Path) -> list[Path]:
    path = Path(path)
    return [path] if path.is_file() else sorted(p for p in path.rglob("*.parquet") if p.is_file())


def row_count(path: Path) -> int:
    """Rows by the files' footers; 0 where there is nothing."""
    return sum(pq.read_metadata(p).num_rows for p in parts(path))


def has_rows(path: Path) -> bool:
    return any(pq.read_metadata(p).num_rows for p in parts(path))


def row_count_many(paths) -> int:
    return sum(map(row_count, paths))


def byte_size(path: Path) -> int:
    return sum(p.stat().st_size for p in parts(path))


def is_large(path: Path, threshold: int = LARGE_FILE_BYTES) -> bool:
    path = Path(path)
    return path.exists() and (path.stat().st_size if path.is_file() else byte_size(path)) >= threshold


#: Types of frames that hold nulls without becoming floats or objects.
NULLABLE = {
    pa.int8(): pd.Int8Dtype(), pa.int16(): pd.Int16Dtype(), pa.int32(): pd.Int32Dtype(), pa.int64(): pd.Int64Dtype(),
    pa.bool_(): pd.BooleanDtype(), pa.string(): pd.StringDtype(), pa.date32(): pd.ArrowDtype(pa.date32()),
}


def batches(path: Path, size: int | None = None) -> Iterator[pd.DataFrame]:
    """The rows in typed frames of so many, the last of fewer, file by file on the driver: for sinks that are there. 0 and None: the default.

    Columns keep their types, with nulls in them too; at most a frame and a row group are held.
    """
    size, held, rows = size or RUN_ROWS, [], 0
    as_frame = lambda parts: pa.Table.from_batches(parts).to_pandas(types_mapper=NULLABLE.get)
    for part in parts(path):
        for batch in pq.ParquetFile(part).iter_batches(batch_size=size):
            while rows + batch.num_rows >= size:
                yield as_frame([*held, batch.slice(0, size - rows)])
                batch, held, rows = batch.slice(size - rows), [], 0
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
    if held:
        yield as_frame(held)


def in_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], size: int | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """fn of every batch of so many rows, in the order of df, the last of fewer, on the executors; 0 and None: the default size.

    df is written once to the folder in spark.checkpoint.dir, beside each row its place in its partition;
    counts by partition make these row numbers. A batch whose rows lie in two partitions is brought
    together like any other: a task gets whole batches, and holds one at a time. schema: that of what fn
    returns, df's own if it is not given.
    """
    spark, size, schema = df.sparkSession, size or RUN_ROWS, schema or df.schema
    folder = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    df.withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(folder)
    rows = numbered(spark.read.parquet(folder), PLACE, AT).withColumn(PLACE, F.floor(F.col(AT) / size).cast("long"))
    dealt, names = rows.repartition(PLACE).sortWithinPartitions(PLACE, AT).select(*(f"`{c}`" for c in df.columns), PLACE), df.columns
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = None

        def made():
            frame = pa.Table.from_batches(held).select(names).to_pandas(types_mapper=NULLABLE.get)
            yield from pa.Table.from_pandas(fn(frame), schema=out, preserve_index=False).to_batches()

        for batch in found:
            numbers = batch.column(PLACE).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if held and numbers[a] != number:
                        yield from made()
                        held = []
                    held, number = [*held, batch.slice(a, b - a)], numbers[a]
        if held:
            yield from made()

    return dealt.mapInArrow(run, schema)


def shared_folder(spark) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = OWN.get(spark.sparkContext.applicationId) or f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def snapshot(source: Path, target: Path) -> bool:
    """Keeps a table as it is, once: hard links where the file system has them, as files never change in place. False if there is one."""
    source, target = Path(source), Path(target)
    if target.exists():
        return False
    staged = staging_for(target)
    staged.parent.mkdir(parents=True, exist_ok=True)

    def link(a, b):
        try:
            os.link(a, b)
        except OSError:
            shutil.copy2(a, b)

    if source.is_dir():
        shutil.copytree(source, staged, copy_function=link)
    else:
        link(source, staged)
    os.replace(staged, target)
    return True
