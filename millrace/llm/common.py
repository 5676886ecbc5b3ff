"""What the corpus operators share: the scratch folder, Arrow mapping and joins on skewed keys."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words in every contract: space and \x09 to \x0D. ``bytes.split()`` splits at these.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Rows and bytes of one Arrow batch. Texts can be long, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
#: Shared folders of our own by application: the setting itself is fixed once a session runs.
OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where none is set and all runs on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = OWN.get(spark.sparkContext.applicationId) or f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def written_apart(df: DataFrame, name: str, by: str, values: tuple[str, ...]) -> dict[str, DataFrame]:
    """df, written once: a table for each value of the column ``by``, which can be dropped one by one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(by).parquet(path)
    kept, out = df.drop(by).schema, {}
    for value in values:
        own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
        own.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(own)  # one may have no rows
        out[value] = spark.read.schema(kept).parquet(f"{path}/{by}={value}")
        out[value].scratch_path = f"{path}/{by}={value}"
    return out


def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """df, written once in as many buckets of the column ``by`` as there are shuffle partitions: groups and joins by it do not shuffle it."""
    spark, unique = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{unique}"
    df.write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(unique)
    out = spark.table(unique)
    out.scratch_path, out.scratch_table = path, unique
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that no later result reads."""
    for table in tables:
        spark = table.sparkSession
        if hasattr(table, "scratch_table"):
            spark.sql(f"DROP TABLE IF EXISTS {table.scratch_table}")
        path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df does not have, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are short: at most ARROW_ROWS rows and about ARROW_BYTES bytes.

    The settings are read when a plan runs, which may be after the operator has returned, so they stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < in_bytes(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df


def in_bytes(size: str) -> int:
    """The number of a setting, with or without a unit."""
    text = size.strip().lower().removesuffix("b")
    return int(text[:-1]) << 10 * ("kmgt".index(text[-1]) + 1) if text[-1] in "kmgt" else int(text)


def trim() -> None:
    """Gives back what a worker no longer uses; idle workers otherwise keep it beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Applies make()(batch) -> {column: values} to Arrow batches; make runs once in each task, and an attribute ``done`` of what it makes at its end."""
    arrow = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                out = each(batch)
                yield pa.RecordBatch.from_arrays([as_array(out[f.name], f.type) for f in arrow], schema=arrow)
        getattr(each, "done", lambda: None)()
        del each
        trim()

    return bounded(df).mapInArrow(run, schema)


def as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null counts as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod n; -1 for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % n, F.lit(-1))


def join_skewed(big: DataFrame, small: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """big left join small, where small has each key once and big may hold one key in a third of its rows.

    Keys with at least 1/share of big's rows, of which there are at most ``share``, go by broadcast,
    so their rows stay where they are; the others are joined by shuffle. big is read three times, so
    it should be a written table. Rows of big with a null key keep nulls.
    """
    total, (n,) = big.count(), fresh(big, "n")
    hot = big.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) * share >= total).select(key)
    hot = written(hot, "hot")
    hot_small = F.broadcast(hot.join(small, key, "left"))
    cold = big.join(F.broadcast(hot), key, "left_anti")
    order = [*big.columns, *(c for c in small.columns if c != key)]
    return cold.join(small, key, "left").select(order).unionByName(big.join(hot_small, key, "inner").select(order))
