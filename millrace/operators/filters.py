"""Filters that split a table into kept and removed rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import have_row_ids, split_by_ids
from ..sources.tables import in_batches

#: A filter: a predicate for rows to remove, or a function from a table to the rows it removes.
FilterFn = Callable[[DataFrame], DataFrame]
#: Removed rows up to which they are looked up by their numbers first; more of them are compared in one shuffle with all rows.
FEW = 1_000_000


class FilterError(ValueError):
    """A filter that returns what is no part of its table."""


def split_by_predicate(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows that match go; where the predicate is null a row stays, so both add up to df."""
    match = F.coalesce(predicate, F.lit(False))
    return df.where(~match), df.where(match)


def as_in(removed: DataFrame, df: DataFrame) -> DataFrame:
    if not isinstance(removed, DataFrame):
        raise FilterError(f"a filter function returns a DataFrame, not {type(removed).__name__}")
    if sorted(removed.columns) != sorted(df.columns):
        raise FilterError(f"removed rows have the columns {removed.columns}, the table has {df.columns}")
    return removed.select(*(f"`{c}`" for c in df.columns))


def foreign_rows(df: DataFrame, removed: DataFrame) -> DataFrame:
    """Removed rows that df does not have, or not so often."""
    return as_in(removed, df).exceptAll(df)


FOREIGN = "a filter removed rows that its table does not have"


def less(df: DataFrame, inside: DataFrame) -> DataFrame:
    """df without the rows of ``inside``, each as often as it is there, by one shuffle of both; fails with FOREIGN, when it is computed, on rows that df does not have."""
    count = next(c for c in ("n", *(f"n{i}" for i in range(len(df.columns) + 1))) if c not in df.columns)
    both = df.withColumn(count, F.lit(1)).unionByName(inside.withColumn(count, F.lit(-1)))
    left = both.groupBy(*(f"`{c}`" for c in df.columns)).agg(F.sum(count).alias(count))
    times = F.when(F.col(count) < 0, F.raise_error(F.lit(FOREIGN)).cast("int")).otherwise(F.col(count).cast("int"))
    return left.withColumn(count, F.explode(F.array_repeat(F.lit(1), times))).select(*(f"`{c}`" for c in df.columns))


def split_by_removed(df: DataFrame, removed: DataFrame, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): df without the removed rows, each as often as it was removed; nulls equal nulls.

    Counts by row are compared, so twins and nulls are told apart without a join on nullable columns.
    One shuffle gives the kept rows. Where rows carry their number, other rows than those with a removed
    number stay where they are, unless the removed are too many to be broadcast, and only the rest is
    compared. More than FEW removed rows, which are counted first, are compared with all rows by that one
    shuffle, as joins by number would come on top of it. Rows that df does not have raise at once with
    ``check``, which takes a shuffle of its own; without it, kept fails with FOREIGN when it is computed.
    ``removed`` is computed several times, so a costly one should be a written table.
    """
    inside = as_in(removed, df)
    others, met = split_by_ids(df, inside) if have_row_ids(df) and inside.count() <= FEW else (None, df)
    if check and not foreign_rows(met, removed).isEmpty():
        raise FilterError(FOREIGN)
    left = less(met, inside)
    return left if others is None else others.unionByName(left), removed


def batched(how: Callable[[pd.DataFrame], pd.DataFrame], size: int | None = None) -> FilterFn:
    """A filter function of a function from a batch of so many rows, as a pandas frame, to those that it removes; batches are made and judged on the executors."""
    return lambda df: in_batches(df, how, size)


def apply_filter(df: DataFrame, how: Column | FilterFn, check: bool = True) -> tuple[DataFrame, DataFrame]:
    return split_by_predicate(df, how) if isinstance(how, Column) else split_by_removed(df, how(df), check)
