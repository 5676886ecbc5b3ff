"""Queries over the driver's tables, one for each operator of the import engine, with their SQL."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from datetime import date
from pathlib import Path

import pandas as pd
from pyspark.sql import Column as Expr
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, identity, ordering
from ..operators import filters, quarantine, resolver
from ..sources import csv, export, schema, tables, versions
from ..sources.match import match_sources
from ..streaming import incremental
from . import cleanup, discovery, model, stats
from .engine import run_steps
from .ingest import ingest
from .state import IngestBlocked, Manifest, NoRun, Runs

Query = Callable[[SparkSession, str], DataFrame]
DAY_1, DAY_2, OPENED = date(2024, 1, 1), date(2024, 1, 2), "1999-01-01"
GROUPS = {"row": hashing.ALL, "money": ["o_totalprice"], "state": ["o_orderstatus", "o_orderpriority"]}

ORDERS = schema.TableSchema({
    "o_orderkey": schema.Column("int", unique=True, checks=(lambda c: c >= 0,)),
    "o_custkey": schema.Column("int"),
    "o_orderstatus": schema.Column("str", checks=(schema.matches("^[A-Z]$"),)),
    "o_totalprice": schema.Column("float"),
    "o_orderdate": schema.Column("datetime"),
    "o_orderpriority": schema.Column("str"),
}, strict="filter")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work(spark: SparkSession) -> Path:
    """A folder of these queries' own in the shared folder, which must be a path of the driver too: manifests and CSV files lie there beside tables."""
    shared = tables.shared_folder(spark)
    if not shared.startswith(("file:", "/")):
        raise ValueError(f"spark.checkpoint.dir must be a folder that the driver can open, not {shared}")
    parent = Path("/" + shared.removeprefix("file:").lstrip("/"))
    parent.mkdir(parents=True, exist_ok=True)
    return Path(tempfile.mkdtemp(prefix="millrace-", dir=parent))


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def as_csv(df: DataFrame, folder: Path, header: bool = True) -> Path:
    """df as CSV in a folder, as a source would deliver it."""
    out = folder / "source"
    df.write.option("header", header).option("escape", '"').option("emptyValue", '""').option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(str(out))
    return out


# --- scans, sources, sinks ---


def scan_parquet(spark, sf_dir):
    return table(spark, sf_dir, "nation")


def scan_pushed_down(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where((F.col("l_quantity") > 45) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_quantity")


def csv_roundtrip(spark, sf_dir):
    source = as_csv(ntz(table(spark, sf_dir, "orders"), "o_orderdate"), work(spark))
    return csv.read_csv(spark, source, ORDERS.types())


def csv_headerless(spark, sf_dir):
    names = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
    source = as_csv(table(spark, sf_dir, "supplier").select(names), work(spark), header=False)
    return csv.read_csv(spark, source, {c: schema.spark_type(t) for c, t in zip(names, ("int", "str", "int", "float"), strict=True)}, has_header=False, column_names=names)


def csv_quoted_text(spark, sf_dir):
    """Texts with line breaks, quotes and accents."""
    source = as_csv(table(spark, sf_dir, "documents").select("doc_id", "text"), work(spark))
    return csv.read_csv(spark, source, {"doc_id": schema.spark_type("int")})


def publish_over_itself(spark, sf_dir):
    target = work(spark) / "part.parquet"
    tables.publish(table(spark, sf_dir, "part"), target)
    tables.publish(spark.read.parquet(str(target)).where("p_size > 10"), target)
    return spark.read.parquet(str(target))


def parquet_parts(spark, sf_dir):
    folder = work(spark)
    with tables.TableWriter(folder / "customer.parquet") as writer:
        for low in (True, False):
            writer.append(table(spark, sf_dir, "customer").where((F.col("c_acctbal") < 0) == F.lit(low)))
    return spark.read.parquet(str(folder / "customer.parquet"))


def version_log(spark, sf_dir):
    """A table that is published, extended and replaced: the versions before stay readable."""
    made, customers = versions.VersionedTable(spark, work(spark) / "customer"), table(spark, sf_dir, "customer")
    made.publish(customers.where("c_acctbal < 0"))
    made.append(customers.where("c_acctbal >= 0"))
    made.publish(made.load().where("c_nationkey < 5"), onto=made.latest())
    out = [made.load(made.version(n)).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("version", F.lit(n)) for n in range(3)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def scan_by_bounds(spark, sf_dir):
    """Line items of a range of orders and ship dates, from the files that may hold them."""
    made, items = versions.VersionedTable(spark, work(spark) / "lineitem"), table(spark, sf_dir, "lineitem")
    first, last = items.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    made.publish(items.repartitionByRange(64, "l_orderkey"), ["l_orderkey", "l_quantity"])
    return made.scan({"l_orderkey": (first + (last - first) // 2, first + (last - first) // 2 + (last - first) // 50), "l_quantity": (None, 40)})


def row_counts(spark, sf_dir):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    frames = [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in names]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def snapshot_roundtrip(spark, sf_dir):
    folder = work(spark)
    tables.publish(table(spark, sf_dir, "nation"), folder / "nation.parquet")
    tables.snapshot(folder / "nation.parquet", folder / "kept.parquet")
    tables.publish(spark.read.parquet(str(folder / "nation.parquet")).limit(0), folder / "nation.parquet")
    return spark.read.parquet(str(folder / "kept.parquet"))


def chunk_export(spark, sf_dir):
    """Files of 300 rows, read again with their names."""
    folder = work(spark)
    export.export_csv(table(spark, sf_dir, "part").orderBy("p_partkey"), folder, "part", ["p_partkey", "p_name", "p_size"], 300)
    rows = spark.read.option("header", True).option("escape", '"').csv(str(folder / "part-*.csv"))
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))


def chunk_assignment(spark, sf_dir):
    folder = work(spark) / "ordered.parquet"
    tables.publish(table(spark, sf_dir, "part").orderBy("p_partkey").withColumn("ord", F.monotonically_increasing_id()), folder)
    return ordering.numbered(spark.read.parquet(str(folder)), "ord", "at").select("p_partkey", F.floor(F.col("at") / 300).cast("long").alias("chunk"))


def jsonl_documents(spark, sf_dir):
    """Texts with line breaks, quotes and accents, and a null."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(None).cast("string").alias("note"))
    return df.select("doc_id", export.documents(df).alias("document"))


def csv_encoded(spark, sf_dir):
    """The same rows from files in three encodings, two of which Spark does not take by itself."""
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.concat("n_name", F.lit(" – é")).alias("n_name"))
    out = []
    for encoding in ("windows-1252", "UTF-16LE", "UTF-8"):
        target = work(spark) / "source"
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        names.write.option("header", True).option("encoding", encoding).csv(str(target))
        out.append(csv.read_csv(spark, target, {"n_nationkey": schema.spark_type("int")}, encoding=encoding.replace("windows-", "cp")).withColumn("encoding", F.lit(encoding)))
    return out[0].unionByName(out[1]).unionByName(out[2])


def csv_preprocessed(spark, sf_dir):
    """A source in a form of its own, made a table by its hook, then checked and published."""
    folder = work(spark)
    table(spark, sf_dir, "region").select(F.concat_ws("|", "r_regionkey", "r_name").alias("value")).write.text(str(folder / "lines"))
    split = lambda spark, path: spark.read.text(str(path)).select(F.split("value", "[|]")[0].alias("r_regionkey"), F.split("value", "[|]")[1].alias("r_name"))
    csv.materialize(spark, folder / "lines", folder / "region.parquet", schema.TableSchema({"r_regionkey": schema.Column("int", coerce=True), "r_name": schema.Column("str")}), preprocess=split)
    return spark.read.parquet(str(folder / "region.parquet"))


def footer_counts(spark, sf_dir):
    """Rows by the footers alone, one by one and together, and whether there are any and many."""
    folder, out = work(spark), []
    frames = {"customer": table(spark, sf_dir, "customer"), "nation": table(spark, sf_dir, "nation"), "none": table(spark, sf_dir, "part").where("p_size < 0")}
    for name, df in frames.items():
        tables.publish(df, folder / name)
        out.append((name, tables.row_count(folder / name), tables.has_rows(folder / name), tables.is_large(folder / name, 4096)))
    out.append(("all", tables.row_count_many(folder / name for name in frames), True, True))
    return spark.createDataFrame(out, "name string, n_rows long, has_rows boolean, large boolean")


def batch_sizes(spark, sf_dir):
    """How many batches of line items have how many rows, counted batch by batch on the executors."""
    sizes = tables.in_batches(table(spark, sf_dir, "lineitem").select("l_orderkey"), lambda frame: pd.DataFrame({"n_rows": [len(frame)]}), 700, "n_rows long")
    return sizes.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_batches"))


def filter_in_batches(spark, sf_dir):
    """A filter function that sees a batch of rows at a time."""
    return filters.apply_filter(table(spark, sf_dir, "lineitem"), filters.batched(lambda frame: frame[frame["l_quantity"] > 40], 1000), check=False)[0]


def stream_unique_keys(spark, sf_dir):
    """Orders as two files that arrive one after the other, the second with a key of the first again: it stops before its commit."""
    folder, orders = work(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    early = orders.where(F.col("o_orderstatus") != "F")
    unique = schema.TableSchema({"o_orderkey": schema.Column("int", unique=True), "o_orderstatus": schema.Column("str")})
    how = {"folder": folder / "in", "target": folder / "out", "checkpoint": folder / "checkpoint", "schema": unique}
    early.write.option("header", True).csv(str(folder / "in"))
    incremental.ingest_available(spark, **how)
    orders.where(F.col("o_orderstatus") == "F").unionByName(early.orderBy("o_orderkey").limit(1)).write.mode("append").option("header", True).csv(str(folder / "in"))
    try:
        incremental.ingest_available(spark, **how)
    except incremental.DuplicateKey:
        return spark.read.parquet(str(folder / "out"))
    raise AssertionError("a key that was there already has been taken")


def export_manifest(spark, sf_dir):
    """A manifest of an export in two batches, read again."""
    folder, parts_ = work(spark), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    with export.ChunkWriter(spark, folder, "part", 400, ["p_name", "p_partkey"]) as writer:
        writer.append(parts_.where("p_size > 25").drop("p_size"))
        writer.append(parts_.where("p_size <= 25").select("p_name", F.col("p_partkey").cast("int").alias("p_partkey")))
    path = export.write_manifest(folder, {"files": export.as_dicts(writer.files)})
    return spark.read.option("multiLine", True).json(str(path)).select(F.explode("files").alias("f")).select(F.col("f.filename").alias("filename"), F.col("f.rows").alias("n_rows"))


def source_match(spark, sf_dir):
    """A directory with a file for each region's nations, matched to sources that expect them; the rows of each file."""
    folder, names = work(spark), table(spark, sf_dir, "nation")
    names.repartition("n_regionkey").write.partitionBy("n_regionkey").option("header", True).csv(str(folder / "by"))
    (folder / "in").mkdir()
    for part in (folder / "by").glob("n_regionkey=*/part-*.csv"):
        part.replace(folder / "in" / f"nations-{part.parent.name.rpartition('=')[2]}.csv")
    nations = schema.TableSchema({"n_nationkey": schema.Column("int"), "n_name": schema.Column("str")}, strict="filter")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()
    specs = [model.SourceSpec(model.slug(r["r_name"]), f"nations-{r['r_regionkey']}*.csv", nations) for r in regions]
    found = match_sources(folder / "in", [*specs, model.SourceSpec("extras", "*.json", nations, optional=True)])
    out = [csv.read_csv(spark, m.path, nations.types()).select(F.lit(m.spec.name).alias("name"), F.lit(m.path.name).alias("file"), "n_nationkey") for m in found]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


# --- schemas, projections, predicates ---


def schema_strict_filter(spark, sf_dir):
    declared = schema.TableSchema({"p_partkey": schema.Column("int"), "p_name": schema.Column("str"), "p_retailprice": schema.Column("float")}, strict="filter")
    return schema.conform(table(spark, sf_dir, "part"), declared)


def schema_violation_counts(spark, sf_dir):
    declared = schema.TableSchema({
        "c_custkey": schema.Column("int", checks=(lambda c: c % 7 != 0,)),
        "c_acctbal": schema.Column("float", checks=(lambda c: c >= 0, schema.between(-500.0, 9000.0))),
        "c_mktsegment": schema.Column("str", checks=(schema.one_of("BUILDING", "MACHINERY"),)),
    })
    counts = schema.violation_counts(table(spark, sf_dir, "customer"), declared)
    return counts.select(*(F.col(f"`{old}`").alias(new) for old, new in (("c_custkey: null", "key_null"), ("c_custkey: check 1", "key_check"), ("c_acctbal: check 1", "negative"), ("c_acctbal: check 2", "out_of_range"), ("c_mktsegment: check 1", "segment"))))


def schema_duplicate_keys(spark, sf_dir):
    return schema.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey")


def expressions(spark, sf_dir):
    """Casts, nulls, conditions, arrays and text as steps use them."""
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("cust"), F.when(price > 200000, "large").when(price > 100000, "middle").otherwise("small").alias("size"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("open")).alias("status"), ((F.col("o_orderstatus") == "F") | (price < 50000)).alias("any_of"),
        F.col("o_orderpriority").rlike("^[12]").alias("urgent"), F.size(F.array_append(F.array(F.to_date("o_orderdate")), F.lit(DAY_1))).alias("n_dates"))


# --- filters ---


def pricey() -> Expr:
    return F.col("o_totalprice") > 250000


def filter_predicate_kept(spark, sf_dir):
    return filters.split_by_predicate(table(spark, sf_dir, "orders"), pricey())[0]


def filter_predicate_removed(spark, sf_dir):
    return filters.split_by_predicate(table(spark, sf_dir, "orders"), pricey())[1]


def filter_null_predicate(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return filters.split_by_predicate(df, F.col("quality") == 0)[0]


def slim_items(spark, sf_dir):
    """Line items without what tells them apart, so that there are many twins."""
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")


def filter_fn_kept(spark, sf_dir):
    return filters.apply_filter(table(spark, sf_dir, "lineitem"), lambda df: df.where("l_quantity > 40"))[0]


def filter_fn_removed(spark, sf_dir):
    """The function returns the columns in another order."""
    return filters.apply_filter(table(spark, sf_dir, "lineitem"), lambda df: df.where("l_quantity > 40").select(*reversed(df.columns)))[1]


def filter_once_of_twins(spark, sf_dir):
    """One of each set of twins is removed."""
    df = slim_items(spark, sf_dir)
    return filters.split_by_removed(df, df.distinct())[0]


def filter_twins_by_id(spark, sf_dir):
    """The same by the rows' numbers: of the twins, the one with the least stays."""
    folder = work(spark)
    target, audit = folder / "items.parquet", folder / "removed.parquet"
    tables.publish(identity.with_row_ids(slim_items(spark, sf_dir)), target)
    df = spark.read.parquet(str(target))
    first = df.groupBy(*(c for c in df.columns if c != identity.ROW_ID)).agg(F.min(identity.ROW_ID).alias(identity.ROW_ID))
    tables.publish(df.join(first.select(identity.ROW_ID), identity.ROW_ID, "left_anti"), audit)  # once, as a run does
    return filters.split_by_removed(df, spark.read.parquet(str(audit)))[0].drop(identity.ROW_ID)


def filter_foreign_rows(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return filters.foreign_rows(df, df.withColumn("n_regionkey", F.when(F.col("n_nationkey") < 5, 99).otherwise(F.col("n_regionkey"))))


# --- quarantine and retry ---


def overdrawn() -> Expr:
    return F.col("c_acctbal") < 0


def quarantine_rows(spark, sf_dir):
    folder = work(spark)
    store = quarantine.QuarantineStore(spark, folder)
    bad = table(spark, sf_dir, "customer").where(overdrawn())
    for nation in (True, False):
        store.add("check", "customer", bad.where((F.col("c_nationkey") < 10) == F.lit(nation)), "negative balance")
    return store.read("check", "customer")


def quarantine_kept(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(~overdrawn())


def retry_merge(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    bad = quarantine.with_reason(df.where(overdrawn()), "negative balance").withColumn("checked", F.lit(True))
    return quarantine.merged(df.where(~overdrawn()), bad)


def retry_each_once(spark, sf_dir):
    """The snapshot holds the bad rows too; each input row comes back once."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return quarantine.restored(df, quarantine.with_reason(df.where(overdrawn()), "negative balance"))


def retry_by_row_id(spark, sf_dir):
    """Rows were changed before they were set aside; by their numbers each comes back once, as it is now."""
    target = work(spark) / "customer.parquet"
    tables.publish(identity.with_row_ids(table(spark, sf_dir, "customer").select("c_name", "c_acctbal", "c_mktsegment")), target)
    df = spark.read.parquet(str(target))
    bad = df.where(overdrawn()).withColumn("c_name", F.lower("c_name"))
    return quarantine.restored(df, quarantine.with_reason(bad, "negative balance")).drop(identity.ROW_ID)


def union_wide(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("key"), F.col("c_mktsegment").alias("segment")).where("key < 0")
    return ordering.union_wide(nations, customers)


# --- hashing and identity ---


def hash_group(spark, sf_dir):
    return hashing.with_hashes(table(spark, sf_dir, "customer"), {"who": ["c_name", "c_mktsegment", "c_nationkey"]}, "c_custkey").select("c_custkey", "who_hash")


def hash_all(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return hashing.with_hashes(df, {"row": hashing.ALL}, "p_partkey", ["p_type"]).select("p_partkey", "row_hash")


def hash_all_empty(spark, sf_dir):
    return hashing.with_hashes(table(spark, sf_dir, "region"), {"row": hashing.ALL}, "r_regionkey", ["r_name"]).select("r_regionkey", "row_hash")


def namespaced_key(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", hashing.namespaced("erp", "s_suppkey").alias("source_key"))


def two_days(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Day 1 has the orders from before OPENED; day 2 has all, urgent ones at another price and pending ones closed, and the later ones are new."""
    orders = ntz(table(spark, sf_dir, "orders"), "o_orderdate")
    price = F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus"))
    return orders.where(F.col("o_orderdate") < F.lit(OPENED).cast("timestamp_ntz")), orders.withColumns({"o_totalprice": price, "o_orderstatus": status})


def day_2(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Day 2 after day 1, and the store that it leaves."""
    first, second = two_days(spark, sf_dir)
    made = resolver.Resolver(spark, work(spark), "orders", GROUPS)
    made.resolve(first, source_key_column="o_orderkey", namespace="shop", run_date=DAY_1)
    out = made.resolve(second, source_key_column="o_orderkey", namespace="shop", run_date=DAY_2)
    return out, made.load()


def resolve_status(spark, sf_dir):
    return day_2(spark, sf_dir)[0].select("o_orderkey", "status")


def resolve_flags(spark, sf_dir):
    return day_2(spark, sf_dir)[0].select("o_orderkey", "row_changed", "money_changed", "state_changed")


def resolve_history(spark, sf_dir):
    dates = F.array_join(F.transform("update_dates", lambda d: d.cast("string")), ",")
    return day_2(spark, sf_dir)[1].select("source_key", F.col("last_changed_date").cast("string").alias("last_changed"), dates.alias("dates"))


def resolve_ids(spark, sf_dir):
    """Ids are random; that each key has one of its own is not."""
    store = day_2(spark, sf_dir)[1]
    return store.agg(F.count(F.lit(1)).alias("n_keys"), F.count_distinct("canonical_id").alias("n_ids"), F.count_if(F.col("canonical_id").isNull()).alias("n_null"))


def resolve_upsert_last(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return ordering.last_of_each(items, ["l_orderkey", "l_linenumber"], items.columns).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def resolve_new_keys(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id")
    store = spark.createDataFrame([], resolver.store_schema({"row": hashing.ALL}))
    found = resolver.compared(users, store, {"row": hashing.ALL}, "user_id", "web")
    return resolver.new_keys(found).select(F.col(resolver.KEY).alias("source_key"))


def resolve_compound_key(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    found = hashing.with_hashes(turns, {"said": ["role", "text"]}, "key")
    return found.select(hashing.namespaced("chat", "key").alias("source_key"), "said_hash")


# --- statistics and runs ---


class Orders(model.TableSpec):
    source = "orders"


class Nations(model.TableSpec):
    source = "nations"


class Extras(model.TableSpec):
    source = "extras"


def set_aside(context, handles) -> None:
    (orders,) = handles
    df = orders.load()
    bad = F.col("o_totalprice") < 2000
    if not df.where(bad).isEmpty():
        context.quarantine.rows("orders", df.where(bad), "price under 2000")
        orders.save_to("checked", "orders.parquet", df.where(~bad))


def resolve_orders(context, handles) -> None:
    (orders,) = handles
    made = resolver.Resolver(context.spark, context.run_directory, "orders", GROUPS)
    out = made.resolve(orders.load(), source_key_column="o_orderkey", namespace="shop", run_date=DAY_1)
    orders.save_to("resolved", "orders.parquet", out)


class ImportOrders(model.Pipeline):
    name = "import-orders"
    sources = [model.SourceSpec("orders", "orders*.csv", ORDERS)]

    def configure(self):
        self.add_filter("Drop large orders", pricey(), [Orders()])
        self.add_step("Set aside small orders", set_aside, [Orders()])
        self.add_step("Resolve", resolve_orders, [Orders()], depends_on=["drop-large-orders"])


def one_file(df: DataFrame, folder: Path, name: str) -> None:
    """df as one CSV file below folder/in."""
    source = as_csv(df.coalesce(1), folder / name)
    (folder / "in").mkdir(parents=True, exist_ok=True)
    next(source.glob("part-*")).replace(folder / "in" / f"{name}.csv")


def processed(spark: SparkSession, folder: Path, pipeline: model.Pipeline) -> tuple[Path, Manifest]:
    done = ingest(spark, folder, pipeline, folder / "in")
    run = Runs(folder)
    run_steps(spark, folder, pipeline, done.run_directory, run.manifest(done.run_directory))
    return done.run_directory, run.manifest(done.run_directory)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders from a CSV file through ingest, filter, quarantine and identity resolution: rows by status and order status."""
    folder = work(spark)
    one_file(ntz(table(spark, sf_dir, "orders"), "o_orderdate"), folder, "orders")
    directory, _ = processed(spark, folder, ImportOrders())
    out = spark.read.parquet(str(directory / "resolved" / "orders.parquet"))
    return out.groupBy("status", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("canonical_id").alias("n_ids"))


class Branching(model.Pipeline):
    """Two branches side by side, and a step for a source that is absent."""

    name = "branching"
    step_execution_mode = model.ExecutionMode.PARALLEL
    sources = [
        model.SourceSpec("orders", "orders.csv", ORDERS),
        model.SourceSpec("nations", "nations.csv", schema.TableSchema({"n_nationkey": schema.Column("int"), "n_name": schema.Column("str"), "n_regionkey": schema.Column("int")})),
        model.SourceSpec("extras", "extras*.csv", schema.TableSchema({"id": schema.Column("str")}), optional=True),
    ]

    def configure(self):
        self.add_filter("Drop large orders", pricey(), [Orders()])
        self.add_filter("Drop region 0", lambda df: df.where("n_regionkey = 0"), [Nations()])
        self.add_step("Extras", lambda context, handles: None, [Extras()])
        self.add_step("Join", lambda context, handles: context.stats.run("joined", sum(h.row_count() for h in handles)), [Orders(), Nations()], depends_on=["drop-large-orders", "drop-region-0", "extras"])


class Nations_(model.Pipeline):
    """One source and one step, one run at a time."""

    name = "nations"
    sources = [Branching.sources[1]]

    def configure(self):
        self.add_step("Count", lambda context, handles: context.stats.run("counted", handles[0].row_count()), [Nations()])


def branching(spark, sf_dir) -> tuple[Path, Manifest]:
    folder = work(spark)
    one_file(ntz(table(spark, sf_dir, "orders"), "o_orderdate"), folder, "orders")
    one_file(table(spark, sf_dir, "nation"), folder, "nations")
    directory, manifest = processed(spark, folder, Branching())
    return folder, manifest


def parallel_dag(spark, sf_dir):
    """What steps of a parallel run have counted."""
    folder, manifest = branching(spark, sf_dir)
    rows = stats.as_table(spark, stats.StatsStore.of(folder).stats(manifest.run_id)).where("action not like '%_ms'")
    return stats.listed(rows).select("scope", "subject", "action", "value")


def stats_list(spark, sf_dir):
    """The statistics of one step and of one file of a run, each with a value that was recorded twice, of which the later stands."""
    folder, manifest = branching(spark, sf_dir)
    store = stats.StatsStore.of(folder)
    recorder = stats.Recorder(store, manifest.run_id)
    for n in (1, table(spark, sf_dir, "customer").count()):
        recorder.file("orders", "customers_seen", n)
        recorder.step("customers_seen", n, step_id="join")
    rows = stats.as_table(spark, store.stats(manifest.run_id)).where("action not like '%_ms'")
    shown = stats.listed(rows, "file", "orders").unionByName(stats.listed(rows, "step", action="customers_seen"))
    return shown.select("scope", "subject", "action", "value")


class Accounted(model.Pipeline):
    """A step that writes a table anew, and one that groups it."""

    name = "accounted"
    account_jobs = True
    sources = [model.SourceSpec("orders", "orders.csv", ORDERS)]

    def configure(self):
        self.add_step("Even customers", lambda context, handles: handles[0].sink(handles[0].load().where("pmod(o_custkey, 2) = 0")), [Orders()])
        self.add_step("By status", lambda context, handles: handles[0].save_to("grouped", "orders.parquet", handles[0].load().groupBy("o_orderstatus").count()), [Orders()], depends_on=["even-customers"])


def step_accounts(spark, sf_dir):
    """The steps of a run with the rows that their Spark jobs have read and written."""
    folder = work(spark)
    one_file(ntz(table(spark, sf_dir, "orders"), "o_orderdate"), folder, "orders")
    _, manifest = processed(spark, folder, Accounted())
    rows = stats.as_table(spark, stats.StatsStore.of(folder).stats(manifest.run_id))
    return stats.listed(rows, "step").where("action IN ('rows_read', 'rows_written')").select("subject", "action", "value")


def optional_skip(spark, sf_dir):
    _, manifest = branching(spark, sf_dir)
    return spark.createDataFrame([(s.step_id, str(s.status)) for s in manifest.step_states], "step_id string, status string")


def filtered_rows(spark, sf_dir):
    """What a filter step has set aside, and nothing of a step that has not run."""
    folder, _ = branching(spark, sf_dir)
    (directory,) = Runs(folder).directories()
    some = model.read_filtered(spark, directory, "drop-region-0", "nations")
    return some.unionByName(model.read_filtered(spark, directory, "no-such-step", "nations", some.schema))


def run_cycle(spark, sf_dir):
    """A run that waits blocks the next ingest, is found by the run service, and goes with a cleanup once it is over."""
    folder, out = work(spark), []
    one_file(table(spark, sf_dir, "nation"), folder, "nations")
    pipeline, runs = Nations_(), Runs(folder)
    done = ingest(spark, folder, pipeline, folder / "in")
    try:
        ingest(spark, folder, pipeline, folder / "in")
    except IngestBlocked as error:
        out.append(("blocked by", len(error.run_ids)))
    directory, manifest = runs.resolve()
    out.append(("found", int(directory == done.run_directory)))
    out.append(("over before", len(cleanup.plan_cleanup(folder).run_ids)))
    run_steps(spark, folder, pipeline, directory, manifest)
    plan = cleanup.plan_cleanup(folder)
    out.append(("over after", len(plan.run_ids)))
    out.append(("lines", len(cleanup.clean_up(folder, plan))))
    out.append(("left", len(runs.directories())))
    try:
        runs.resolve()
    except NoRun:
        out.append(("runnable", 0))
    return spark.createDataFrame(out, "what string, n long")


def discovered(spark, sf_dir):
    """A pipeline from its directory's file, run over orders: the rows that its filter has set aside."""
    folder = work(spark)
    (folder / "pipeline.py").write_text("from millrace.plans.catalogue import Branching\n\npipeline = Branching()\n")
    one_file(ntz(table(spark, sf_dir, "orders"), "o_orderdate"), folder, "orders")
    one_file(table(spark, sf_dir, "nation"), folder, "nations")
    directory, _ = processed(spark, folder, discovery.load_pipeline(folder))
    return model.read_filtered(spark, directory, "drop-large-orders", "orders")


def text_forms(spark, sf_dir):
    """Step ids and lines of statistics, made of part names on the executors."""

    def forms(batches):
        for f in batches:
            lines = [stats.shown(stats.Scope.FILE, brand, "rows_kept", int(key)) for brand, key in zip(f["p_brand"], f["p_partkey"], strict=True)]
            yield pd.DataFrame({"p_partkey": f["p_partkey"], "slug": f["p_type"].map(model.slug), "line": lines})

    return table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand").mapInPandas(forms, "p_partkey long, slug string, line string")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    flagship, scan_parquet, scan_pushed_down, csv_roundtrip, csv_headerless, csv_quoted_text, publish_over_itself, version_log, scan_by_bounds, parquet_parts, row_counts, snapshot_roundtrip,
    chunk_export, chunk_assignment, jsonl_documents, schema_strict_filter, schema_violation_counts, schema_duplicate_keys, expressions,
    filter_predicate_kept, filter_predicate_removed, filter_null_predicate, filter_fn_kept, filter_fn_removed, filter_once_of_twins, filter_twins_by_id, filter_foreign_rows,
    quarantine_rows, quarantine_kept, retry_merge, retry_each_once, retry_by_row_id, union_wide, hash_group, hash_all, hash_all_empty, namespaced_key,
    resolve_status, resolve_flags, resolve_history, resolve_ids, resolve_upsert_last, resolve_new_keys, resolve_compound_key, stats_list, parallel_dag, step_accounts, optional_skip,
    csv_encoded, csv_preprocessed, footer_counts, batch_sizes, filter_in_batches, stream_unique_keys, export_manifest, source_match, filtered_rows, run_cycle, discovered, text_forms,
)}

#: Day 1 and day 2 as two_days() makes them, for the resolver's queries.
DAYS = f"""
WITH d1 AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{OPENED}'),
d2 AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders),
both_days AS (SELECT d2.o_orderkey, d1.o_orderkey IS NULL AS is_new,
  d1.o_orderkey IS NULL OR d1.o_totalprice <> d2.o_totalprice AS money, d1.o_orderkey IS NULL OR d1.o_orderstatus <> d2.o_orderstatus AS state
  FROM d2 LEFT JOIN d1 ON d1.o_orderkey = d2.o_orderkey)
"""
SLIM = "SELECT l_returnflag, l_linestatus, l_linenumber, l_quantity FROM lineitem"

SQL: dict[str, str] = {
    "flagship": "SELECT 'NEW' AS status, o_orderstatus, count(*) AS n_rows, count(*) AS n_ids FROM orders WHERE o_totalprice <= 250000 AND o_totalprice >= 2000 GROUP BY 2",
    "scan_parquet": "SELECT * FROM nation",
    "scan_pushed_down": "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'",
    "csv_roundtrip": "SELECT * FROM orders",
    "csv_headerless": "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier",
    "csv_quoted_text": "SELECT doc_id, text FROM documents",
    "publish_over_itself": "SELECT * FROM part WHERE p_size > 10",
    "parquet_parts": "SELECT * FROM customer",
    "version_log": "SELECT c_nationkey, count(*) AS n_rows, version::INTEGER AS version FROM customer, range(3) AS v(version) WHERE CASE version WHEN 0 THEN c_acctbal < 0 WHEN 1 THEN true ELSE c_nationkey < 5 END GROUP BY c_nationkey, version",
    "scan_by_bounds": "SELECT l.* FROM lineitem AS l, (SELECT min(l_orderkey) AS a, max(l_orderkey) AS z FROM lineitem) WHERE l_orderkey BETWEEN a + (z - a) // 2 AND a + (z - a) // 2 + (z - a) // 50 AND l_quantity <= 40",
    "row_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n_rows FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "snapshot_roundtrip": "SELECT * FROM nation",
    "chunk_export": "SELECT p_partkey, p_name, p_size, 'part-' || lpad(((row_number() OVER (ORDER BY p_partkey) - 1) // 300 + 1)::VARCHAR, 5, '0') || '.csv' AS file FROM part",
    "chunk_assignment": "SELECT p_partkey, (row_number() OVER (ORDER BY p_partkey) - 1) // 300 AS chunk FROM part",
    "jsonl_documents": """SELECT doc_id, '{"doc_id":' || doc_id || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"note":null}' AS document FROM documents""",
    "schema_strict_filter": "SELECT p_partkey, p_name, p_retailprice FROM part",
    "schema_violation_counts": "SELECT count(*) FILTER (c_custkey IS NULL) AS key_null, count(*) FILTER (c_custkey % 7 = 0) AS key_check, count(*) FILTER (c_acctbal < 0) AS negative, count(*) FILTER (c_acctbal NOT BETWEEN -500 AND 9000) AS out_of_range, count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS segment FROM customer",
    "schema_duplicate_keys": "SELECT l_orderkey AS value, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "expressions": "SELECT o_orderkey, o_custkey::VARCHAR AS cust, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status, o_orderstatus = 'F' OR o_totalprice < 50000 AS any_of, regexp_matches(o_orderpriority, '^[12]') AS urgent, 2 AS n_dates FROM orders",
    "filter_predicate_kept": "SELECT * FROM orders WHERE NOT o_totalprice > 250000",
    "filter_predicate_removed": "SELECT * FROM orders WHERE o_totalprice > 250000",
    "filter_null_predicate": "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 0, false)",
    "filter_fn_kept": "SELECT * FROM lineitem EXCEPT ALL SELECT * FROM lineitem WHERE l_quantity > 40",
    "filter_fn_removed": "SELECT * FROM lineitem WHERE l_quantity > 40",
    "filter_once_of_twins": f"{SLIM} EXCEPT ALL SELECT DISTINCT * FROM ({SLIM})",
    "filter_twins_by_id": f"SELECT DISTINCT * FROM ({SLIM})",
    "filter_foreign_rows": "SELECT n_nationkey, n_name, 99 AS n_regionkey FROM nation WHERE n_nationkey < 5",
    "quarantine_rows": "SELECT *, 'negative balance' AS _quarantine_reason FROM customer WHERE c_acctbal < 0",
    "quarantine_kept": "SELECT * FROM customer WHERE NOT c_acctbal < 0",
    "retry_merge": "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_acctbal < 0 THEN true END AS checked FROM customer",
    "retry_each_once": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "retry_by_row_id": "SELECT CASE WHEN c_acctbal < 0 THEN lower(c_name) ELSE c_name END AS c_name, c_acctbal, c_mktsegment FROM customer",
    "union_wide": "SELECT n_nationkey::DOUBLE AS key, n_name AS name, NULL::VARCHAR AS segment FROM nation UNION ALL SELECT c_acctbal, NULL, c_mktsegment FROM customer WHERE c_acctbal < 0",
    "hash_group": "SELECT c_custkey, sha256(concat_ws(chr(31), c_name, c_mktsegment, c_nationkey::VARCHAR)) AS who_hash FROM customer",
    "hash_all": "SELECT p_partkey, sha256(concat_ws(chr(31), p_brand, p_name, p_retailprice::VARCHAR, p_size::VARCHAR)) AS row_hash FROM part",
    "hash_all_empty": "SELECT r_regionkey, sha256('') AS row_hash FROM region",
    "namespaced_key": "SELECT s_suppkey, 'erp:' || s_suppkey AS source_key FROM supplier",
    "resolve_status": DAYS + "SELECT o_orderkey, CASE WHEN is_new THEN 'NEW' WHEN money OR state THEN 'CHANGED' ELSE 'UNCHANGED' END AS status FROM both_days",
    "resolve_flags": DAYS + "SELECT o_orderkey, money OR state AS row_changed, money AS money_changed, state AS state_changed FROM both_days",
    "resolve_history": DAYS + "SELECT 'shop:' || coalesce(d1.o_orderkey, b.o_orderkey) AS source_key, CASE WHEN b.o_orderkey IS NOT NULL AND (b.is_new OR b.money OR b.state) THEN '2024-01-02' ELSE '2024-01-01' END AS last_changed, CASE WHEN b.is_new THEN '2024-01-02' WHEN b.money OR b.state THEN '2024-01-01,2024-01-02' ELSE '2024-01-01' END AS dates FROM d1 FULL JOIN both_days AS b ON b.o_orderkey = d1.o_orderkey",
    "resolve_ids": "SELECT count(*) AS n_keys, count(*) AS n_ids, 0 AS n_null FROM orders",
    "resolve_upsert_last": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC, l_shipdate DESC) AS place FROM lineitem) WHERE place = 1",
    "resolve_new_keys": "SELECT DISTINCT 'web:' || user_id AS source_key FROM events",
    "resolve_compound_key": "SELECT 'chat:' || conv_id || '/' || turn AS source_key, sha256(concat_ws(chr(31), role, text)) AS said_hash FROM conversations",
    "stats_list": """WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_totalprice > 250000) AS gone FROM orders), c AS (SELECT count(*) AS n FROM customer)
SELECT scope, subject, action, value::DOUBLE AS value FROM o, c, LATERAL (VALUES ('file', 'orders', 'rows_ingested', o.n), ('file', 'orders', 'rows_kept', o.n - o.gone), ('file', 'orders', 'rows_removed', o.gone), ('file', 'orders', 'customers_seen', c.n), ('step', 'join', 'customers_seen', c.n)) AS t(scope, subject, action, value)""",
    "parallel_dag": """WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_totalprice > 250000) AS gone FROM orders), n AS (SELECT count(*) AS n, count(*) FILTER (n_regionkey = 0) AS gone FROM nation)
SELECT scope, subject, action, value::DOUBLE AS value FROM o, n, LATERAL (VALUES ('file', 'orders', 'rows_ingested', o.n), ('file', 'nations', 'rows_ingested', n.n), ('file', 'orders', 'rows_kept', o.n - o.gone), ('file', 'orders', 'rows_removed', o.gone),
('file', 'nations', 'rows_kept', n.n - n.gone), ('file', 'nations', 'rows_removed', n.gone), ('step', 'drop-large-orders', 'rows_removed', o.gone), ('step', 'drop-region-0', 'rows_removed', n.gone),
('run', NULL, 'files_ingested', 2), ('run', NULL, 'rows_ingested', o.n + n.n), ('run', NULL, 'joined', o.n - o.gone + n.n - n.gone), ('run', NULL, 'steps_completed', 3)) AS t(scope, subject, action, value)""",
    "step_accounts": """WITH even AS (SELECT * FROM orders WHERE o_custkey % 2 = 0), n AS (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM even) AS e, (SELECT count(DISTINCT o_orderstatus) FROM even) AS s)
SELECT subject, action, value::DOUBLE AS value FROM n, LATERAL (VALUES ('even-customers', 'rows_read', n.a), ('even-customers', 'rows_written', n.e), ('by-status', 'rows_read', n.e), ('by-status', 'rows_written', n.s)) AS t(subject, action, value)""",
    "csv_encoded": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name || ' – é' AS n_name, encoding FROM nation, (VALUES ('windows-1252'), ('UTF-16LE'), ('UTF-8')) AS e(encoding)",
    "csv_preprocessed": "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region",
    "footer_counts": "SELECT 'customer' AS name, count(*) AS n_rows, true AS has_rows, true AS large FROM customer UNION ALL SELECT 'nation', count(*), true, false FROM nation UNION ALL SELECT 'none', 0, false, false UNION ALL SELECT 'all', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation), true, true",
    "batch_sizes": "SELECT n_rows, count(*) AS n_batches FROM (SELECT count(*) AS n_rows FROM (SELECT row_number() OVER () AS n FROM lineitem) GROUP BY (n - 1) // 700) GROUP BY 1",
    "filter_in_batches": "SELECT * FROM lineitem WHERE l_quantity <= 40",
    "stream_unique_keys": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
    "export_manifest": "SELECT 'part-' || lpad(((n - 1) // 400 + 1)::VARCHAR, 5, '0') || '.csv' AS filename, count(*) AS n_rows FROM (SELECT row_number() OVER () AS n FROM part) GROUP BY 1",
    "source_match": "SELECT replace(lower(r_name), ' ', '-') AS name, 'nations-' || r_regionkey || '.csv' AS file, n_nationkey::BIGINT AS n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey",
    "filtered_rows": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_regionkey = 0",
    "run_cycle": "SELECT * FROM (VALUES ('blocked by', 1::BIGINT), ('found', 1), ('over before', 0), ('over after', 1), ('lines', 1), ('left', 0), ('runnable', 0)) AS t(what, n)",
    "discovered": "SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice > 250000",
    "text_forms": "SELECT p_partkey, regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') AS slug, 'Stat · ' || p_brand || ' · rows kept · ' || format('{:,}', p_partkey) AS line FROM part",
    "optional_skip": "SELECT * FROM (VALUES ('drop-large-orders', 'complete'), ('drop-region-0', 'complete'), ('extras', 'skipped'), ('join', 'complete')) AS t(step_id, status)",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
