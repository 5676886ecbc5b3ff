"""Ingest of files as they arrive: each file of a folder is read once, however often the query is started."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from ..sources.csv import charset
from ..sources.schema import SchemaError, TableSchema, cast_declared, rules, typed

DUPLICATE = "a row breaks the schema: duplicate"
#: Groups into which a column's keys are dealt by their hash: a group holds its keys as one text, and is called once a batch.
#: Rows without a key are dealt likewise; they are never refused.
GROUPS = 4096


class DuplicateKey(SchemaError):
    """A key of a unique column that an earlier row of the stream has."""


def seen_once(df: DataFrame, columns: dict[str, T.DataType]) -> DataFrame:
    """df, rows of strings, if no value of one of the columns stands twice in it, in this batch or an earlier one; else the query stops.

    The keys are the query's keyed state, which is committed with the batch: a batch that is run again
    finds it as it was before. Each row goes with its first key; its others go alone. Values are compared
    as the declared types, so 1 and 01 are one key. A group is called for many keys, as a call costs more
    than a key does.
    """
    names, schema, unique = df.columns, df.schema, list(columns)
    values = [typed(F.col(f"`{c}`"), kind).cast("string") for c, kind in columns.items()]
    keys = F.array(*(F.struct(F.lit(i).alias("column"), value.alias("value"), F.lit(i == 0).alias("row")) for i, value in enumerate(values)))
    keyed = df.withColumn("__key", F.explode(keys)).where("__key.value is not null or __key.row")
    dealt = F.pmod(F.coalesce(F.xxhash64("__key.value"), F.xxhash64(*(f"`{c}`" for c in names))), F.lit(GROUPS))
    rows = (F.when(F.col("__key.row"), F.col(f"`{c}`")).alias(c) for c in names)
    keyed = keyed.select(*rows, F.col("__key.row").alias("__row"), F.col("__key.value").alias("__value"), F.col("__key.column").alias("__column"), dealt.alias("__group"))

    def check(key: tuple[int, int], frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = set(json.loads(state.get[0])) if state.exists else set()
        before = len(known)
        for frame in frames:
            for value in frame["__value"][frame["__value"].notna()].tolist():
                if value in known:
                    raise ValueError(f"{DUPLICATE} {f'{unique[key[0]]}={value}'!r}")
                known.add(value)
            if key[0] == 0:  # elsewhere keys go without their rows
                yield frame[names]
        if len(known) > before:
            state.update((json.dumps(sorted(known)),))

    return keyed.groupBy("__column", "__group").applyInPandasWithState(check, schema, "seen string", "append", "NoTimeout")


def ingest_available(spark: SparkSession, folder: Path, target: Path, checkpoint: Path, schema: TableSchema, pattern: str = "*.csv", encoding: str = "utf-8", files_per_batch: int = 1000) -> int:
    """Appends the rows of all files that have not been read yet to a Parquet table; returns the batches that it took.

    A stream's files must have exactly the declared columns, in their order, with a header. A row that
    breaks the schema stops the query before its batch is committed, one that repeats the key of a unique
    column with DuplicateKey, also if an earlier file had it. The keys are kept in the checkpoint, by groups;
    one whose keys were kept singly must be started anew.
    """
    name, legacy = charset(encoding)
    if legacy:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    strings = T.StructType([T.StructField(c, T.StringType()) for c in schema.columns])
    reader = spark.readStream.schema(strings).options(header=True, escape='"', multiLine=True, mode="FAILFAST", encoding=name, pathGlobFilter=pattern, maxFilesPerTrigger=files_per_batch, enforceSchema=False)
    df = reader.csv(str(folder))
    if unique := {c: schema.types()[c] for c, declared in schema.columns.items() if declared.unique}:
        df = seen_once(df, unique)
    df = cast_declared(df, schema.types())
    for rule, broken in rules(schema, df.columns).items():
        df = df.where(F.when(broken, F.raise_error(F.lit(f"a row breaks the schema: {rule}")).cast("boolean")).otherwise(F.lit(True)))
    query = df.writeStream.format("parquet").option("path", str(target)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except PySparkException as error:
        if found := re.search(f"{DUPLICATE} .*", str(error)):
            raise DuplicateKey(found[0]) from error
        raise
    return len([p for p in query.recentProgress if p["numInputRows"]])
