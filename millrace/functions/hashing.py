"""Hashes of groups of fields, to see which have changed."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands between fields, and the group of all columns.
SEPARATOR, ALL = "\x1f", "*all"
Groups = Mapping[str, Sequence[str] | str]


def hash_name(group: str) -> str:
    return f"{group}_hash"


def changed_name(group: str) -> str:
    return f"{group}_changed"


def hash_fields(fields: Sequence[str]) -> Column:
    """SHA-256 of the fields as strings, in this order, nulls as the empty string; values are not trimmed."""
    if not fields:
        return F.sha2(F.lit(""), 256)
    return F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields)), 256)


def all_fields(columns: Iterable[str], exclude: Iterable[str]) -> list[str]:
    left_out = set(exclude)
    return sorted(c for c in columns if c not in left_out)


def with_hashes(df: DataFrame, groups: Groups, key: str, exclude: Iterable[str] = ()) -> DataFrame:
    """df with a hash column for each group; the group of all columns leaves out the key and the excluded ones."""
    rest = all_fields(df.columns, [*exclude, key])
    return df.withColumns({hash_name(g): hash_fields(rest if fields == ALL else fields) for g, fields in groups.items()})


def namespaced(namespace: str, key: Column | str) -> Column:
    """namespace:key; null for a null key."""
    key = F.col(f"`{key}`") if isinstance(key, str) else key
    return F.concat(F.lit(f"{namespace}:"), key.cast("string"))
