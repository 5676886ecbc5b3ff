"""Versions of a table: a log of small files that only grows, on any Hadoop file system.

A version is a JSON file in the folder ``_log``, named by its number. Its data are written first, under
names of their own; then the log's next file is put in place by a rename that fails if it is there, so a
version appears at once or not at all. Readers take the highest number, or one that they have pinned.
A writer that is killed between any two steps leaves the last version as it was.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG, DATA, BOUNDS = "_log", "data", "bounds"
#: Files that a scan names one by one at most; where more of them may hold its rows, it takes their folders.
MOST_FILES = 10_000


class Conflict(RuntimeError):
    """Another writer has put this version in place first."""


class Versions:
    def __init__(self, spark: SparkSession, root: object):
        self.spark, self.root = spark, str(root).rstrip("/")
        jvm = spark._jvm
        self.Path, self.conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self.conf)

    def path(self, *parts: str):
        return self.Path("/".join([self.root, *parts]))

    def numbers(self) -> list[int]:
        folder = self.path(LOG)
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:1].isdigit())

    def read(self, number: int) -> dict:
        stream = self.fs.open(self.path(LOG, f"{number:020d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> dict | None:
        """The entry of the highest version, with its ``version``; None where there is none."""
        found = self.numbers()
        return self.read(found[-1]) | {"version": found[-1]} if found else None

    def commit(self, number: int, entry: dict) -> None:
        """Makes the entry the version of that number; Conflict if there is one."""
        jvm = self.spark._jvm
        staged, target = self.path(LOG, f".{uuid.uuid4().hex}"), self.path(LOG, f"{number:020d}.json")
        self.fs.mkdirs(self.path(LOG))
        stream = self.fs.create(staged, False)
        try:
            stream.write(json.dumps(entry, ensure_ascii=False).encode())
        finally:
            stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        whole = self.fs.makeQualified
        try:
            files.rename(whole(staged), whole(target), self.spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as error:
            self.fs.delete(staged, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"version {number} of {self.root} is there already") from error
            raise

    def forget(self, before: float, keep: int) -> list[int]:
        """Deletes the log files that are older than that time, but for the last ``keep``; returns what is left."""
        left = self.numbers()
        for number in left[:-keep] if keep else left:
            path = self.path(LOG, f"{number:020d}.json")
            if self.fs.getFileStatus(path).getModificationTime() / 1000 < before:
                self.fs.delete(path, False)
                left = [n for n in left if n != number]
        return left


class BucketedTable:
    """Rows with a unique key in hash buckets; a new version replaces the buckets that it touches.

    All versions are partitions of one bucketed Spark table, so joins by key do not shuffle it. A
    version's entry says for each bucket which partition holds it. Old partitions stay readable for
    those who have pinned them, until vacuum().
    """

    def __init__(self, spark: SparkSession, root: object, schema: T.StructType, key: str, buckets: int | None = None):
        self.spark, self.schema, self.key, self.log = spark, schema, key, Versions(spark, root)
        found = self.log.latest()
        self.buckets = found["buckets"] if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = "millrace_" + uuid.uuid5(uuid.NAMESPACE_URL, str(self.log.fs.makeQualified(self.log.path()))).hex

    def bucket(self):
        """The number by which Spark itself names the bucket of a row."""
        return F.expr(f"pmod(hash(`{self.key}`), {self.buckets})")

    def declared(self, parts: list[str]) -> str:
        """The name of the session's table, with these partitions."""
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        location = str(self.log.fs.makeQualified(self.log.path("data")))
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, `__part` string) USING parquet PARTITIONED BY (`__part`) CLUSTERED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{location}'")
        for part in parts:
            self.spark.sql(f"ALTER TABLE {self.name} ADD IF NOT EXISTS PARTITION (`__part`='{part}') LOCATION '{location}/__part={part}'")
        return self.name

    def load(self, entry: dict | None = None) -> DataFrame:
        """The rows of a version, of the latest if none is given; none where there is no version."""
        entry = entry or self.log.latest()
        if not entry:
            return self.spark.createDataFrame([], self.schema)
        owners = entry["owners"]
        parts = sorted({p for p in owners if p})
        rows = self.spark.table(self.declared(parts)).where(F.col("__part").isin(parts))
        if len(parts) > 1:
            rows = rows.where(F.col("__part") == F.element_at(F.array(*(F.lit(p or "") for p in owners)), self.bucket() + 1))
        return rows.select(*(f"`{f.name}`" for f in self.schema))

    def replace(self, rows: DataFrame, touched: list[int], onto: dict | None) -> dict | None:
        """Commits a version after ``onto`` in which the touched buckets hold these rows, and no others; returns its entry, None for a first version of no rows."""
        number = onto["version"] + 1 if onto else 0
        part = f"{number:08d}-{uuid.uuid4().hex[:12]}"
        name = self.declared([])
        seen = Observation()
        rows.select(*(f"`{f.name}`" for f in self.schema), F.lit(part).alias("__part")).observe(seen, F.count(F.lit(1)).alias("rows")).write.format("parquet").mode("append").partitionBy("__part").bucketBy(self.buckets, self.key).saveAsTable(name)
        if not onto and not seen.get.get("rows"):
            return None
        owners = list(onto["owners"]) if onto else [None] * self.buckets
        for b in touched:
            owners[b] = part
        entry = {"buckets": self.buckets, "columns": self.schema.fieldNames(), "owners": owners}
        self.log.commit(number, entry)
        return entry | {"version": number}

    def vacuum(self, days: float, keep: int = 2) -> None:
        """Forgets versions that are older than so many days, and deletes what no version holds and is as old."""
        before = time.time() - days * 86_400
        held = {p for n in self.log.forget(before, keep) for p in self.log.read(n)["owners"]}
        data = self.log.path("data")
        for status in self.log.fs.listStatus(data) if self.log.fs.exists(data) else ():
            part = status.getPath().getName().partition("=")[2]
            if part and part not in held and status.getModificationTime() / 1000 < before:
                self.spark.sql(f"ALTER TABLE {self.declared([])} DROP IF EXISTS PARTITION (`__part`='{part}')")
                self.log.fs.delete(status.getPath(), True)


class VersionedTable:
    """A table that is replaced or extended as a whole, on any Hadoop file system.

    A version's entry names the folders of its files, and is what appears: readers of the version before
    keep its files until vacuum(). Rows, bytes and schema stand in the entry, so that nothing is opened
    to know them. For columns that are named at a publish, least and greatest values by file are kept in
    a small table, and scan() opens only files that may hold what is asked for.
    """

    def __init__(self, spark: SparkSession, root: object):
        self.spark, self.log = spark, Versions(spark, root)

    def latest(self) -> dict | None:
        return self.log.latest()

    def version(self, number: int) -> dict:
        return self.log.read(number) | {"version": number}

    def entry(self, entry: dict | None) -> dict:
        found = entry or self.latest()
        if not found:
            raise FileNotFoundError(f"there is no table at {self.log.root}")
        return found

    def load(self, entry: dict | None = None) -> DataFrame:
        """The rows of a version, of the latest if none is given."""
        return self.read(self.entry(entry))

    def read(self, entry: dict, paths: Sequence[str] | None = None) -> DataFrame:
        paths, schema = [str(self.log.path(p)) for p in (entry["folders"] if paths is None else paths)], T.StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def scan(self, ranges: Mapping[str, tuple[object, object]], entry: dict | None = None) -> DataFrame:
        """The rows with each of these columns in its closed range; None as a bound leaves that side open.

        Files whose values lie apart from a range are not opened, where bounds of that column are kept.
        Null is in no range.
        """
        entry = self.entry(entry)
        rows = self.read(entry, self.candidates(entry, ranges))
        for name, (low, high) in ranges.items():
            rows = rows.where(F.col(f"`{name}`").isNotNull())
            if low is not None:
                rows = rows.where(F.col(f"`{name}`") >= F.lit(low))
            if high is not None:
                rows = rows.where(F.col(f"`{name}`") <= F.lit(high))
        return rows

    def candidates(self, entry: dict, ranges: Mapping[str, tuple[object, object]]) -> list[str] | None:
        """Files that may hold rows in these ranges, by the kept bounds; None: all."""
        places = {c: i for i, c in enumerate(entry["bounded"])}
        if not places.keys() & ranges.keys():
            return None
        bounds = self.spark.read.parquet(*(str(self.log.path(p)) for p in entry["bounds"]))
        for name in places.keys() & ranges.keys():
            (low, high), i = ranges[name], places[name]
            bounds = bounds.where(F.col(f"high{i}").isNotNull())
            if low is not None:
                bounds = bounds.where(F.col(f"high{i}") >= F.lit(low))
            if high is not None:
                bounds = bounds.where(F.col(f"low{i}") <= F.lit(high))
        found = [r[0] for r in bounds.select("file").limit(MOST_FILES + 1).collect()]
        return None if len(found) > MOST_FILES else found

    def publish(self, df: DataFrame, bounds: Sequence[str] = (), block_bytes: int | None = None, onto: dict | None = None) -> int:
        """Replaces the table, which df may read, and returns the rows, counted during the write.

        bounds: columns whose least and greatest values by file are kept. onto: the version that df was
        made from; Conflict if another has been put in place since. Without it the later writer's stands.
        On failure the table is as it was.
        """
        return self.write(df, list(bounds), block_bytes, lambda before, made: made, onto)

    def append(self, df: DataFrame, block_bytes: int | None = None) -> int:
        """Adds rows of the table's columns and types; of two appends at a time both stand. A first append makes the table."""
        before = self.latest()
        if before:
            types = T.StructType.fromJson(before["schema"])
            if sorted(df.columns) != sorted(types.fieldNames()):
                raise ValueError(f"the table has the columns {types.fieldNames()}, not {df.columns}")
            df = df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in types))

        def joined(before: dict | None, made: dict) -> dict:
            if not before:
                return made
            if before["schema"] != made["schema"] or before["bounded"] != made["bounded"]:
                raise Conflict(f"{self.log.root} has been replaced by a table of other columns")
            return made | {k: before[k] + made[k] for k in ("folders", "bounds", "rows", "bytes")}

        return self.write(df, before["bounded"] if before else [], block_bytes, joined, None)

    def write(self, df: DataFrame, bounded: list[str], block_bytes: int | None, change: Callable[[dict | None, dict], dict], onto: dict | None) -> int:
        name, seen = uuid.uuid4().hex, Observation()
        folder, bounds = f"{DATA}/{name}", f"{BOUNDS}/{name}"
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
        if block_bytes:
            writer = writer.option("parquet.block.size", block_bytes)
        try:
            writer.parquet(str(self.log.path(folder)))
            # What Spark writes is nullable, whatever df was.
            schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema])
            made = {"folders": [folder], "schema": schema.jsonValue(), "rows": int(seen.get.get("rows", 0)), "bytes": self.log.fs.getContentSummary(self.log.path(folder)).getLength(), "bounded": bounded, "bounds": [bounds] if bounded else []}
            if bounded:
                file = F.concat(F.lit(f"{folder}/"), F.element_at(F.split(F.input_file_name(), "/"), -1))
                sides = [side(f"`{c}`").alias(f"{to}{i}") for i, c in enumerate(bounded) for side, to in ((F.min, "low"), (F.max, "high"))]
                self.read(made).groupBy(file.alias("file")).agg(*sides).write.parquet(str(self.log.path(bounds)))
            while True:
                before = self.latest()
                if onto is not None and (before or {}).get("version") != onto["version"]:
                    raise Conflict(f"version {onto['version']} of {self.log.root} is not the latest any more")
                try:
                    self.log.commit(before["version"] + 1 if before else 0, change(before, made))
                    return made["rows"]
                except Conflict:
                    if onto is not None:
                        raise
        except BaseException:
            for path in (folder, bounds):
                self.log.fs.delete(self.log.path(path), True)
            raise

    def vacuum(self, days: float, keep: int = 2) -> None:
        """Forgets versions that are older than so many days but for the last ``keep``, and deletes what no version holds and is as old."""
        before = time.time() - days * 86_400
        entries = [self.log.read(n) for n in self.log.forget(before, keep)]
        held = {p for e in entries for p in (*e["folders"], *e["bounds"])}
        for parent in (DATA, BOUNDS):
            path = self.log.path(parent)
            for status in self.log.fs.listStatus(path) if self.log.fs.exists(path) else ():
                if f"{parent}/{status.getPath().getName()}" not in held and status.getModificationTime() / 1000 < before:
                    self.log.fs.delete(status.getPath(), True)
