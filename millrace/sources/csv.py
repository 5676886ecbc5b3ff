"""CSV sources, read by declared schema: as strings first, then typed by column name."""

from __future__ import annotations

import codecs
import shutil
from collections.abc import Callable, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import with_row_ids
from .records import records
from .schema import TableSchema, cast_declared, check_rows, conform
from .tables import publish, staging_for, swap_in

#: Lines that a row estimate looks at.
SAMPLE_LINES = 1000
#: Stands for an empty field, so that a quoted empty string stays one.
NOTHING = "\x00none\x00"
#: Charsets that Spark reads without its legacy setting, by Python's names.
NATIVE = {"utf-8": "UTF-8", "ascii": "US-ASCII", "iso8859-1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16-be": "UTF-16BE", "utf-16-le": "UTF-16LE", "utf-32": "UTF-32"}


def charset(encoding: str) -> tuple[str, bool]:
    """Spark's name of an encoding, and whether it needs the legacy charsets."""
    name = encoding.lower().replace("_", "-")
    if name in ("utf8-lossy", "utf-8-lossy", "utf-8-sig", "utf8"):
        return "UTF-8", False
    found = codecs.lookup(name).name
    return (NATIVE[found], False) if found in NATIVE else ({"cp1252": "windows-1252"}.get(found, found), True)


def read_csv(spark: SparkSession, path: Path | str, types: dict[str, T.DataType] | None = None, encoding: str = "utf-8", has_header: bool = True, column_names: Sequence[str] | None = None, multi_line: bool = True) -> DataFrame:
    """The rows of a CSV file (or a directory of them): declared columns typed, the others as strings.

    Quoted fields may hold separators, quotes and, with multi_line, line breaks. Large files are split
    among tasks either way, those in UTF-8 with line breaks by records(), which reads them twice; in
    other encodings line breaks take one task for a file. A quoted empty field is the empty
    string, an unquoted one null. Ragged rows and bad values raise. A file without bytes is refused;
    a header alone gives no rows.
    """
    if not has_header and not column_names:
        raise ValueError("a file without a header needs column names")
    name, legacy = charset(encoding)
    if legacy:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    options = {"header": has_header, "escape": '"', "multiLine": multi_line, "mode": "FAILFAST", "encoding": name, "inferSchema": False, "nullValue": NOTHING, "emptyValue": "", "enforceSchema": True}
    reader = spark.read.options(**options)
    if not has_header:
        df = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in column_names])).csv(str(path))
    else:
        df = reader.csv(str(path))
        if column_names:
            if len(column_names) != len(df.columns):
                raise ValueError(f"{len(column_names)} column names for {len(df.columns)} columns")
            df = df.toDF(*column_names)
    if not df.columns:
        raise ValueError(f"no data in {path}")
    if multi_line and name == "UTF-8":
        df = parsed(records(spark, str(path)), df.columns, has_header)
    return cast_declared(df, types or {})


def parsed(found: DataFrame, names: Sequence[str], has_header: bool) -> DataFrame:
    """Records as rows of strings, without each file's header; a ragged record raises."""
    inner = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"escape": '"', "multiLine": "true", "mode": "FAILFAST", "nullValue": NOTHING, "emptyValue": ""}
    if has_header:
        found = found.where(~F.col("first"))
    fields = F.from_csv(F.col("record"), F.lit(inner.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")), options)
    return found.select(fields.alias("r")).select("r.*").toDF(*names)


def estimate_rows(path: Path, has_header: bool = True, sample: int = SAMPLE_LINES) -> int | None:
    """Rows of a file by the mean length of its first lines; 0 for an empty file, None if only a header is there to go by."""
    path = Path(path)
    size = path.stat().st_size
    if not size:
        return 0
    with path.open("rb") as f:
        head = len(f.readline()) if has_header else 0
        lines = [line for _, line in zip(range(sample), f, strict=False)]
    if not lines:
        return None
    return max(1, round((size - head) / (sum(map(len, lines)) / len(lines))))


def load(spark: SparkSession, path: Path, schema: TableSchema, encoding: str = "utf-8", has_header: bool = True, column_names: Sequence[str] | None = None, preprocess: Callable | None = None, multi_line: bool = True) -> DataFrame:
    """A source file as a DataFrame of its declared schema, unvalidated.

    preprocess(spark, path) replaces reading; it may return a DataFrame or a pandas frame.
    """
    if preprocess is None:
        return read_csv(spark, path, schema.types(), encoding, has_header, column_names, multi_line)
    made = preprocess(spark, path)
    return spark.createDataFrame(made) if isinstance(made, pd.DataFrame) else made


def materialize(spark: SparkSession, path: Path, target: Path, schema: TableSchema, row_ids: bool = False, **how) -> tuple[int, int]:
    """Loads, validates as a whole and publishes a source file; (rows, columns). Nothing is left of one that fails.

    The file is parsed once: its rows are staged as Parquet, checked there and put in place.
    row_ids: each row gets a number, in a column more.
    """
    df, staged = conform(load(spark, path, schema, **how), schema), staging_for(Path(target))
    df = with_row_ids(df) if row_ids else df
    try:
        rows = publish(df, staged)
        check_rows(spark.read.schema(df.schema).parquet(str(staged)), schema)
        swap_in(staged, Path(target))
    except BaseException:
        shutil.rmtree(staged, ignore_errors=True)
        raise
    return rows, len(df.columns)
