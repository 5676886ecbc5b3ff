"""Order where it matters: row numbers without a global sort, the last of equal keys, unions of unlike columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of monotonically_increasing_id below the partition's number.
PLACE_BITS = 33


def numbered(df: DataFrame, order: str, into: str, first: str | None = None) -> DataFrame:
    """Adds the row number, from 0, in the order of a stored monotonically_increasing_id, or of such ids within the numbers of a column ``first``.

    Only one count for each partition is gathered, and broadcast: as many rows as the table once had partitions.
    """
    keys = {"__first": F.col(first) if first else F.lit(0), "__part": F.shiftright(order, PLACE_BITS)}
    placed = df.withColumns(keys)
    counts = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), list(keys)).withColumn(into, F.col("__before") + F.col(order).bitwiseAND((1 << PLACE_BITS) - 1)).drop(*keys, "__before")


def last_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """For each key the last row in the order. A maximum by key, so that equal keys collapse before they meet; nulls are a key."""
    rank = F.struct(*order)
    rows = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), rank).alias("__row"))
    return rows.select("__row.*")


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: a string if one is, else a double, else a long, else the later of date and time."""
    if a == b:
        return a
    whole, fractional = (T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType, T.DecimalType)
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return b if isinstance(a, T.NullType) else a
    kinds = (a, b)
    if all(isinstance(x, whole) for x in kinds):
        return T.LongType()
    if all(isinstance(x, whole + fractional) for x in kinds):
        return T.DoubleType()
    if all(isinstance(x, (T.DateType, T.TimestampNTZType)) for x in kinds):
        return T.TimestampNTZType()
    return T.StringType()


def union_wide(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, columns matched by name, missing ones null, unlike types widened."""
    frames = [first, *others]
    types: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            types[f.name] = wider(types[f.name], f.dataType) if f.name in types else f.dataType
    cast = lambda df: df.select(*(F.col(f"`{f.name}`").cast(types[f.name]).alias(f.name) for f in df.schema))
    out = cast(frames[0])
    for df in frames[1:]:
        out = out.unionByName(cast(df), allowMissingColumns=True)
    return out.select(*(f"`{c}`" for c in types))
