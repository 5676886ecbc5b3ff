"""Rows set aside with a reason, what a step's tables were before, and their merge for a retry."""

from __future__ import annotations

import json
import shutil
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import have_row_ids, shared_ids, split_by_ids
from ..functions.ordering import union_wide
from ..sources import tables
from ..sources.versions import VersionedTable

REASON = "_quarantine_reason"


def with_reason(rows: DataFrame, reason: str) -> DataFrame:
    if not reason:
        raise ValueError("a quarantine needs a reason")
    return rows.withColumn(REASON, F.lit(reason))


def merged(snapshot: DataFrame, quarantined: DataFrame) -> DataFrame:
    """The snapshot and the quarantined rows, their reasons dropped."""
    return union_wide(snapshot, quarantined.drop(REASON))


def restored(snapshot: DataFrame, quarantined: DataFrame) -> DataFrame:
    """merged(), but with each input row once: the snapshot, taken before the step, holds the quarantined rows too.

    Rows are compared on the snapshot's columns, as a step may have added some. Rows with a number are
    found by it: a row that the step has changed before it set it aside stands in its first form's place.
    """
    rows = quarantined.drop(REASON)
    if have_row_ids(snapshot, rows):
        others, met = split_by_ids(snapshot, rows)
        unsure = split_by_ids(met, shared_ids(met, rows))[1]
        return union_wide(others.unionByName(unsaid(unsure, rows)), rows)
    return union_wide(unsaid(snapshot, rows), rows)


def unsaid(snapshot: DataFrame, rows: DataFrame) -> DataFrame:
    """The snapshot without these rows, by all its columns; all of it where they lack one."""
    shared = [c for c in snapshot.columns if c in rows.columns]
    types = dict(snapshot.dtypes)
    if len(shared) < len(snapshot.columns):
        return snapshot
    again = rows.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) for c in snapshot.columns))
    return snapshot.exceptAll(again)


class QuarantineStore:
    """Below a run's directory: quarantine/<step>/<source>.parquet in numbered parts, and snapshots/<step>/<source>.parquet."""

    def __init__(self, spark: SparkSession, run_directory: Path):
        self.spark, self.root = spark, Path(run_directory)

    def path(self, step: str, source: str) -> Path:
        return self.root / "quarantine" / step / f"{source}.parquet"

    def snapshot_path(self, step: str, source: str) -> Path:
        return self.root / "snapshots" / step / f"{source}.parquet"

    def parts(self, step: str, source: str) -> list[Path]:
        base = self.path(step, source)
        return [p for p in (base, *sorted(base.parent.glob(f"{base.name}.part-*.parquet"))) if p.exists()]

    def add(self, step: str, source: str, rows: DataFrame, reason: str) -> int:
        """Writes the rows as the next part, without reading the others."""
        rows = with_reason(rows, reason)
        base = self.path(step, source)
        taken = [int(p.name.rpartition("part-")[2].removesuffix(".parquet")) for p in self.parts(step, source) if ".part-" in p.name]
        part = base.with_name(f"{base.name}.part-{max(taken, default=0) + 1:05d}.parquet")
        n = tables.publish(rows, part)
        if not n:
            shutil.rmtree(part)
            raise ValueError("there are no rows to quarantine")
        return n

    def read(self, step: str, source: str) -> DataFrame | None:
        frames = [self.spark.read.parquet(str(p)) for p in self.parts(step, source)]
        return union_wide(*frames) if frames else None

    def count(self, step: str, source: str) -> int:
        return tables.row_count_many(self.parts(step, source))

    def clear(self, step: str, source: str) -> None:
        for part in self.parts(step, source):
            shutil.rmtree(part) if part.is_dir() else part.unlink()

    def keep_snapshot(self, step: str, source: str, active: Path | str) -> bool:
        """Keeps the table as the step finds it, once; of a versioned table its version is noted."""
        if not isinstance(active, str):
            return tables.snapshot(active, self.snapshot_path(step, source))
        pin = self.pin_path(step, source)
        if pin.exists():
            return False
        pin.parent.mkdir(parents=True, exist_ok=True)
        staged = pin.with_suffix(".tmp")
        staged.write_text(json.dumps({"table": active, "version": VersionedTable(self.spark, active).entry(None)["version"]}), encoding="utf-8")
        staged.replace(pin)
        return True

    def pin_path(self, step: str, source: str) -> Path:
        return self.snapshot_path(step, source).with_suffix(".json")

    def snapshot(self, step: str, source: str) -> DataFrame:
        pin = self.pin_path(step, source)
        if not pin.exists():
            return self.spark.read.parquet(str(self.snapshot_path(step, source)))
        noted = json.loads(pin.read_text(encoding="utf-8"))
        table = VersionedTable(self.spark, noted["table"])
        return table.load(table.version(noted["version"]))

    def merge(self, step: str, source: str, target: Path | str, each_once: bool = True) -> None:
        """Publishes what a retry of the step starts from; the quarantine is cleared only then."""
        kept, rows = self.snapshot(step, source), self.read(step, source)
        out = kept if rows is None else (restored if each_once else merged)(kept, rows)
        VersionedTable(self.spark, target).publish(out) if isinstance(target, str) else tables.publish(out, target)
        self.clear(step, source)


class StepQuarantine:
    """What a step uses to set rows aside."""

    def __init__(self, store: QuarantineStore, step: str):
        self.store, self.step = store, step
        self.any = False

    def rows(self, source: str, rows: DataFrame, reason: str) -> int:
        n = self.store.add(self.step, source, rows, reason)
        self.any = True
        return n

    def row(self, source: str, values: Mapping[str, object], reason: str, schema=None) -> None:
        """One row from a mapping; its types are inferred unless a schema is given."""
        frame = self.store.spark.createDataFrame([tuple(values.values())], schema or list(values)) if schema is None else self.store.spark.createDataFrame([dict(values)], schema)
        self.rows(source, frame, reason)
