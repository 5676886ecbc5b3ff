"""Stable ids for source keys, and which groups of fields have changed since the last load.

compared() and resolved() are the pure operator: a table and a store in, the table with ids and flags
out. Resolver keeps the store in hash buckets by key: a load is shuffled to the buckets, the store is
not; buckets without a new or changed key stay as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import ALL, Groups, changed_name, hash_name, namespaced, with_hashes
from ..functions.identity import ROW_ID
from ..functions.ordering import last_of_each
from ..sources.versions import BucketedTable, Conflict

SAFE_NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9._-]*$")
FOLDER = ".persistent"
KEY, ORDER, ID = "__resolver_key", "__resolver_order", "__resolver_id"
#: How long the result of a load stays readable; loads that are tried again as another one came first.
KEPT_DAYS, TRIES = 7, 5


def check_groups(groups: Groups) -> None:
    if not groups:
        raise ValueError("a resolver needs a hash group")
    for name, fields in groups.items():
        if not name:
            raise ValueError("a hash group needs a name")
        if not fields:
            raise ValueError(f"hash group {name!r} has no fields")


def check_input(df: DataFrame, groups: Groups, key: str, namespace: str) -> None:
    if not namespace:
        raise ValueError("a namespace is needed")
    if key not in df.columns:
        raise ValueError(f"no key column {key!r}")
    if missing := sorted({f for fields in groups.values() if fields != ALL for f in fields} - set(df.columns)):
        raise ValueError(f"hash groups name columns that are missing: {', '.join(missing)}")


def store_schema(groups: Groups) -> T.StructType:
    fields = [("source_key", T.StringType()), ("canonical_id", T.StringType()), ("last_changed_date", T.DateType()), ("update_dates", T.ArrayType(T.DateType()))]
    return T.StructType([T.StructField(n, t) for n, t in [*fields, *((hash_name(g), T.StringType()) for g in groups)]])


def compared(df: DataFrame, store: DataFrame, groups: Groups, key: str, namespace: str, exclude: Iterable[str] = ()) -> DataFrame:
    """df with its namespaced key, hashes, what the store has (``stored``), a flag for each group and the status.

    Every row is compared with the stored state, also if its key stands in the table twice. The store
    has each key once, so the join keeps the rows; null keys match nothing and are new.
    """
    stored = store.select(F.col("source_key").alias(KEY), F.struct(*store.columns).alias("stored"))
    joined = with_hashes(df, groups, key, exclude).withColumn(KEY, namespaced(namespace, key)).join(stored, KEY, "left")
    new = F.col("stored.canonical_id").isNull()
    flags: dict[str, Column] = {g: new | ~F.col(f"`{hash_name(g)}`").eqNullSafe(F.col(f"stored.`{hash_name(g)}`")) for g in groups}
    status = F.when(new, "NEW").when(reduce(or_, flags.values()), "CHANGED").otherwise("UNCHANGED")
    return joined.withColumns({changed_name(g): f for g, f in flags.items()} | {"status": status})


def new_keys(found: DataFrame) -> DataFrame:
    return found.where((F.col("status") == "NEW") & F.col(KEY).isNotNull()).select(KEY).distinct()


def dated(found: DataFrame, run_date: date) -> DataFrame:
    """Adds the date of the last change and the list of all, which grow with new and changed rows only."""
    today, none = F.lit(run_date).cast("date"), F.array().cast("array<date>")
    moved = F.col("status") != "UNCHANGED"
    history = F.when(moved, F.array_append(F.coalesce("stored.update_dates", none), today)).otherwise(F.col("stored.update_dates"))
    return found.withColumns({"last_changed_date": F.when(moved, today).otherwise(F.col("stored.last_changed_date")), "update_dates": history})


def changes(found: DataFrame, groups: Groups, run_date: date) -> DataFrame:
    """The store's rows of new and changed keys; of equal keys in the table the last, by ORDER, counts. A new key's id is drawn here."""
    columns = ["canonical_id", "last_changed_date", "update_dates", *(hash_name(g) for g in groups)]
    rows = dated(found.where(F.col(KEY).isNotNull()), run_date).withColumn("canonical_id", F.col("stored.canonical_id"))
    latest = last_of_each(rows.select(KEY, "status", *columns, ORDER), [KEY], [ORDER]).where("status <> 'UNCHANGED'")
    return latest.select(F.col(KEY).alias("source_key"), F.coalesce("canonical_id", F.expr("uuid()")).alias("canonical_id"), *columns[1:])


def resolved(found: DataFrame, ids: DataFrame) -> DataFrame:
    """What compared() has found, with canonical_id from ids (source_key, canonical_id)."""
    return found.join(ids.select(F.col("source_key").alias(KEY), F.col("canonical_id").alias(ID)), KEY, "left").withColumn("canonical_id", F.col(ID))


@dataclass
class Resolver:
    """hash_groups: group name -> list of fields, or "*all". pipeline_dir may be on any file system that Spark writes to.

    buckets: of a new store; as many as the session has shuffle partitions if not given.
    """

    spark: SparkSession
    pipeline_dir: Path | str
    name: str
    hash_groups: Groups
    buckets: int | None = None

    def __post_init__(self):
        if not SAFE_NAME.match(self.name or ""):
            raise ValueError("a resolver's name starts with a letter or digit and holds those, '.', '_' and '-'")
        check_groups(self.hash_groups)
        self.path = f"{str(self.pipeline_dir).rstrip('/')}/{FOLDER}/{self.name}.store"

    def table(self) -> BucketedTable:
        schema = store_schema(self.hash_groups)
        made = BucketedTable(self.spark, self.path, schema, "source_key", self.buckets)
        entry = made.log.latest()
        if entry and (missing := sorted(set(schema.fieldNames()) - set(entry["columns"]))):
            raise ValueError(f"the store {self.path} has no columns {', '.join(missing)}")
        return made

    def load(self) -> DataFrame:
        """The store as it is now."""
        return self.table().load()

    def resolve(self, df: DataFrame, *, source_key_column: str, namespace: str, run_date: date, exclude_columns: Iterable[str] = ()) -> DataFrame:
        """df with canonical_id, status (NEW, UNCHANGED, CHANGED) and a changed flag for each group; the store is brought up to date.

        An empty table changes nothing. A null key is new each time, with a null id, and is not stored.
        df is compared with the version that the store had before, and takes ids from the one that the
        load commits; both are pinned, so the result stays the same whatever is loaded later, and df is
        read again with it. Versions older than KEPT_DAYS go with a later load. Of two loads at the same
        time the one that commits second starts again from the other's version.
        """
        check_input(df, self.hash_groups, source_key_column, namespace)
        store = self.table()
        for _ in range(TRIES):
            before = store.log.latest()
            old = store.load(before) if before else self.spark.createDataFrame([], store.schema)
            ordered = df.withColumn(ORDER, F.monotonically_increasing_id())
            found = compared(ordered, old, self.hash_groups, source_key_column, namespace, [*exclude_columns, ORDER, ROW_ID])
            try:
                after = self.load_changes(store, changes(found, self.hash_groups, run_date), before)
                break
            except Conflict:
                continue
        else:
            raise Conflict(f"{TRIES} loads have met others of the store {self.path}")
        store.vacuum(KEPT_DAYS)
        done = resolved(found, store.load(after) if after else self.spark.createDataFrame([], store.schema))
        return done.select(*(f"`{c}`" for c in [*df.columns, "canonical_id", "status", *(changed_name(g) for g in self.hash_groups)]))

    def load_changes(self, store: BucketedTable, rows: DataFrame, before: dict | None) -> dict | None:
        """The entry of the version that holds these rows; ``before`` itself if there are none."""
        if not before:  # all of the store is new
            made = store.replace(rows, list(range(store.buckets)), None)
            return made
        staged = f"{self.path}/changes-{before['version']}-{uuid.uuid4().hex}"
        try:
            rows.write.parquet(staged)
            new = self.spark.read.schema(store.schema).parquet(staged)
            touched = [r[0] for r in new.select(store.bucket()).distinct().collect()]  # one number for each bucket at most
            if not touched:
                return before
            kept = store.load(before).where(store.bucket().isin(touched))
            names = [f.name for f in store.schema if f.name != "source_key"]
            both = kept.alias("old").join(new.withColumn("__new", F.lit(True)).alias("new"), "source_key", "full")
            return store.replace(both.select("source_key", *(F.when(F.col("__new"), F.col(f"new.`{c}`")).otherwise(F.col(f"old.`{c}`")).alias(c) for c in names)), touched, before)
        finally:
            store.log.fs.delete(store.log.Path(staged), True)
