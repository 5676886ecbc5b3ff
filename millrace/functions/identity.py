"""Numbers that rows get when they are ingested and keep through the steps, so that filters and retries know them again.

A step may change a row's other columns. It may also copy a row with its number, or add rows without one:
what shares a number, or has none, is told apart by all columns, and nothing is lost by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_ID = "_row_id"


def with_row_ids(df: DataFrame) -> DataFrame:
    """df with a number for each row, which is stable once df is written."""
    if ROW_ID in df.columns:
        raise ValueError(f"a table has a column {ROW_ID} of its own")
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def have_row_ids(*tables: DataFrame) -> bool:
    return all(ROW_ID in df.columns for df in tables)


def split_by_ids(df: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose number is not among those of ``rows``, those where it is); no number is one of its own.

    The numbers are broadcast where Spark knows them to be few; else df is shuffled by them, once, as both
    results share that exchange in a plan that reads both.
    """
    gone = next(c for c in ("gone", *(f"gone{i}" for i in range(len(df.columns) + 1))) if c not in df.columns)
    ids = rows.select(F.col(ROW_ID).alias(gone))
    same = df[ROW_ID].eqNullSafe(ids[gone])
    return df.join(ids, same, "left_anti"), df.join(ids, same, "left_semi")


def shared_ids(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Numbers that rows of ``found`` have more often than rows of ``wanted``, and null."""
    sides = found.select(ROW_ID, F.lit(1).alias("n")).unionByName(wanted.select(ROW_ID, F.lit(-1).alias("n")))
    return sides.groupBy(ROW_ID).agg(F.sum("n").alias("n")).where((F.col("n") > 0) | F.col(ROW_ID).isNull()).select(ROW_ID)
