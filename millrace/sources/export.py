"""Exports in files of a fixed number of rows, in order, written by all executors.

Rows get their number from their partition's offset, so no single task holds them all; the rows of
one file are brought to one task, which writes it.
"""

from __future__ import annotations

import json
import shutil
import tempfile
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass
from datetime import date, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import numbered, union_wide, wider
from .tables import publish

MANIFEST = "manifest.json"
BATCH, PLACE, DOCUMENT = "__batch", "__place", "__document"


@dataclass(frozen=True)
class ExportedFile:
    filename: str
    bytes: int
    rows: int | None = None
    documents: int | None = None

    def as_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}


def _chunks(df: DataFrame, chunk_size: int, folder: Path, prefix: str, suffix: str, write, counted: str, placed: bool = False) -> list[ExportedFile]:
    """placed: df is read from written tables and has BATCH and PLACE, by which its rows are numbered as they lie."""
    if chunk_size < 1:
        raise ValueError("a chunk has one row at least")
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    staged = Path(tempfile.mkdtemp(prefix=".export-", dir=folder))
    try:
        columns = [c for c in df.columns if not placed or c not in (BATCH, PLACE)]
        if not placed:
            kept = staged / "rows"
            df.withColumns({PLACE: F.monotonically_increasing_id(), BATCH: F.lit(0)}).write.parquet(str(kept))
            df = df.sparkSession.read.parquet(str(kept))
        rows = numbered(df, PLACE, "__at", BATCH).withColumn("__chunk", F.floor(F.col("__at") / chunk_size).cast("long"))
        sizes = {r["__chunk"]: r["n"] for r in rows.groupBy("__chunk").agg(F.count(F.lit(1)).alias("n")).collect()}
        dealt = rows.repartition(max(1, len(sizes)), "__chunk").sortWithinPartitions("__chunk", "__at")
        write(dealt.select("__chunk", *(f"`{c}`" for c in columns)).write.partitionBy("__chunk"), str(staged / "out"))
        out = []
        for chunk in sorted(sizes):
            (part,) = (staged / "out" / f"__chunk={chunk}").glob("part-*")
            target = folder / f"{prefix}-{chunk + 1:05d}{suffix}"
            part.replace(target)
            out.append(ExportedFile(target.name, target.stat().st_size, **{counted: sizes[chunk]}))
        return out
    finally:
        shutil.rmtree(staged, ignore_errors=True)


def as_csv(writer, path: str) -> None:
    writer.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def kind_of(values: list) -> T.DataType | None:
    """The Spark type that holds all of these values, None for nulls alone; values of unlike kinds become strings."""
    kinds: dict[type, T.DataType] = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), datetime: T.TimestampNTZType(), date: T.DateType()}
    found = [kinds.get(type(v), T.StringType()) for v in values if v is not None]
    return reduce(wider, found) if found else None


def framed(spark: SparkSession, rows: list[dict], columns: Sequence[str]) -> DataFrame:
    """Dictionaries of any keys as a table of these columns. What a row lacks is null; a column of nulls is left out, so that its type is another batch's."""
    types = {c: kind_of([r.get(c) for r in rows]) for c in columns}
    kept = {c: t for c, t in types.items() if t}
    as_type = lambda v, t: v if v is None or not isinstance(t, (T.StringType, T.DoubleType)) else float(v) if isinstance(t, T.DoubleType) else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (dict, list)) else str(v)
    made = [(*(as_type(r.get(c), t) for c, t in kept.items()), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, T.StructType([T.StructField(c, t) for c, t in kept.items()] + [T.StructField("__row", T.LongType())])).drop("__row")


def export_csv(df: DataFrame, folder: Path, prefix: str, columns: Sequence[str], chunk_size: int) -> list[ExportedFile]:
    """The columns, in this order, with a header in each file. A column that is not there raises; no rows make no file."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return _chunks(df.select(*(f"`{c}`" for c in columns)), chunk_size, folder, prefix, ".csv", as_csv, "rows")


def documents(df: DataFrame) -> Column:
    """Each row as a compact JSON document, nulls kept."""
    return F.to_json(F.struct(*(f"`{c}`" for c in df.columns)), {"ignoreNullFields": "false"})


def export_jsonl(df: DataFrame, folder: Path, prefix: str, chunk_size: int) -> list[ExportedFile]:
    return _chunks(df.select(documents(df).alias("value")), chunk_size, folder, prefix, ".jsonl", lambda writer, path: writer.text(path), "documents")


class ChunkWriter:
    """Gathers tables, or rows as dictionaries, and writes them as files of a fixed number of rows when it is closed; nothing remains of an aborted one.

    columns: those of CSV files, in order; without them rows become JSON documents. Tables of unlike
    types meet in the wider type, and columns that one lacks are null there; so are keys that a dictionary
    lacks, while keys beyond ``columns`` are left out. What is appended first
    comes first. rows, files and last_file tell what has been appended and written.
    """

    def __init__(self, spark: SparkSession, folder: Path, prefix: str, chunk_size: int, columns: Sequence[str] | None = None):
        if chunk_size < 1:
            raise ValueError("a chunk has one row at least")
        self.spark, self.folder, self.prefix, self.chunk_size, self.columns = spark, Path(folder), prefix, chunk_size, columns
        self.rows, self.files, self.staged = 0, [], []

    @property
    def last_file(self) -> ExportedFile | None:
        return self.files[-1] if self.files else None

    def append(self, rows: DataFrame | Iterable[dict]) -> None:
        if not isinstance(rows, DataFrame):
            rows = list(rows)
            if not rows:
                return
            if self.columns is None:  # documents are kept as they are, whatever they hold
                rows = self.spark.createDataFrame([(json.dumps(r, ensure_ascii=False, separators=(",", ":"), default=str),) for r in rows], f"`{DOCUMENT}` string")
            else:
                rows = framed(self.spark, rows, self.columns)
        elif self.columns is None:
            rows = rows.select(documents(rows).alias(DOCUMENT))
        elif missing := [c for c in self.columns if c not in rows.columns]:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        self.folder.mkdir(parents=True, exist_ok=True)
        part = Path(tempfile.mkdtemp(prefix=".append-", dir=self.folder)) / "rows"
        self.staged.append(part)
        self.rows += publish(rows.withColumn(PLACE, F.monotonically_increasing_id()), part)

    def close(self) -> list[ExportedFile]:
        try:
            if self.staged:
                read = [self.spark.read.parquet(str(p)).withColumn(BATCH, F.lit(i)) for i, p in enumerate(self.staged)]
                df = union_wide(*read)
                if self.columns is None:
                    self.files = _chunks(df.select(F.col(DOCUMENT).alias("value"), BATCH, PLACE), self.chunk_size, self.folder, self.prefix, ".jsonl", lambda writer, path: writer.text(path), "documents", placed=True)
                else:
                    self.files = _chunks(df.select(*(F.col(f"`{c}`") if c in df.columns and df.schema[c].dataType != T.NullType() else F.lit(None).cast("string").alias(c) for c in self.columns), BATCH, PLACE), self.chunk_size, self.folder, self.prefix, ".csv", as_csv, "rows", placed=True)
        finally:
            self.abort()
        return self.files

    def abort(self) -> None:
        for part in self.staged:
            shutil.rmtree(part.parent, ignore_errors=True)
        self.staged = []

    def __enter__(self) -> ChunkWriter:
        return self

    def __exit__(self, kind, *_) -> None:
        self.abort() if kind else self.close()


def write_manifest(folder: Path, manifest: dict) -> Path:
    path = Path(folder) / MANIFEST
    path.write_text(json.dumps(manifest, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return path


def as_dicts(files: Sequence[ExportedFile]) -> list[dict]:
    return [f.as_dict() for f in files]
