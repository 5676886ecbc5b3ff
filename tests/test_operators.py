from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import hashing, identity, ordering
from millrace.operators import filters, quarantine, resolver
from millrace.sources import tables, versions

ROWS = "id long, name string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_null_predicates_keep(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], ROWS)
    kept, removed = filters.split_by_predicate(df, F.col("name") == "a")
    assert rows(kept) == [(2, None), (3, "b")] and rows(removed) == [(1, "a")]


def test_twins_and_nulls_in_function_filters(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x"), (2, "x")], ROWS)
    kept, _ = filters.split_by_removed(df, spark.createDataFrame([(1, None), (2, "x")], ROWS))
    assert rows(kept) == [(1, None), (2, "x")]


def test_filters_must_return_rows_of_the_table(spark):
    df = spark.createDataFrame([(1, "a")], ROWS)
    for bad, text in ((spark.createDataFrame([(9, "z")], ROWS), "does not have"), (df.select("id"), "columns"), ([1], "DataFrame")):
        with pytest.raises(filters.FilterError, match=text):
            filters.split_by_removed(df, bad)
    twice = df.union(df)
    with pytest.raises(filters.FilterError):
        filters.split_by_removed(df, twice)


@pytest.mark.parametrize("predicate", ["id > 0", "id > 99"])
def test_one_side_empty(spark, predicate):
    df = spark.createDataFrame([(1, "a"), (2, "b")], ROWS)
    kept, removed = filters.apply_filter(df, lambda d: d.where(predicate))
    assert kept.count() + removed.count() == 2


def test_quarantine_parts(spark, tmp_path):
    store = quarantine.QuarantineStore(spark, tmp_path)
    df = spark.createDataFrame([(1, "a")], ROWS)
    assert store.add("s", "t", df, "bad") == 1
    store.add("s", "t", df.select("id"), "worse")
    assert [p.name for p in store.parts("s", "t")] == ["t.parquet.part-00001.parquet", "t.parquet.part-00002.parquet"]
    assert rows(store.read("s", "t")) == [(1, "a", "bad"), (1, None, "worse")] and store.count("s", "t") == 2
    for bad_rows, reason in ((df, ""), (df.limit(0), "x")):
        with pytest.raises(ValueError):
            store.add("s", "t", bad_rows, reason)
    store.clear("s", "t")
    assert store.read("s", "t") is None and store.count("s", "t") == 0


def test_one_row_from_a_mapping(spark, tmp_path):
    step = quarantine.StepQuarantine(quarantine.QuarantineStore(spark, tmp_path), "s")
    assert not step.any
    step.row("t", {"id": 1, "name": "a"}, "bad")
    assert step.any and rows(step.store.read("s", "t")) == [(1, "a", "bad")]


def test_merge_gives_each_row_once(spark, tmp_path):
    store = quarantine.QuarantineStore(spark, tmp_path)
    table = tmp_path / "t.parquet"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], ROWS)
    tables.publish(df, table)
    assert store.keep_snapshot("s", "t", table) and not store.keep_snapshot("s", "t", table)
    bad = spark.createDataFrame([(2, "b")], ROWS)
    for _ in range(2):
        store.add("s", "t", bad.withColumn("why", F.lit(1)), "bad")
        tables.publish(df.where("id = 1"), table)
        store.merge("s", "t", table)
        assert rows(spark.read.parquet(str(table)).select("id", "name")) == rows(df)
    store.add("s", "t", bad, "bad")
    store.merge("s", "t", table, each_once=False)
    assert tables.row_count(table) == 4


def test_union_wide_widens(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("q", 2.5)], "x string, y double")
    assert rows(ordering.union_wide(a, b)) == [("1", None), ("q", 2.5)]


def test_numbers_follow_the_stored_order(spark, tmp_path):
    spark.range(0, 100, 1, 5).withColumn("ord", F.monotonically_increasing_id()).write.parquet(str(tmp_path / "t"))
    out = ordering.numbered(spark.read.parquet(str(tmp_path / "t")), "ord", "at")
    assert out.where("id <> at").count() == 0 and out.count() == 100


GROUPS = {"row": hashing.ALL, "address": ["address1", "postcode"]}


def batch(spark, *changes):
    base = {"source_key": "k1", "address1": "1 High St", "postcode": "LS1", "owner": "Ann"}
    return spark.createDataFrame([tuple((base | c).values()) for c in changes], "source_key string, address1 string, postcode string, owner string")


def resolve(made, df, day):
    out = made.resolve(df, source_key_column="source_key", namespace="ns", run_date=date(2024, 1, day))
    return [r.asDict() for r in out.orderBy("source_key", "owner").collect()]


def test_days_of_one_key(spark, tmp_path):
    made = resolver.Resolver(spark, tmp_path, "places", GROUPS)
    (new,) = resolve(made, batch(spark, {}), 1)
    (same,) = resolve(made, batch(spark, {}), 2)
    (moved,) = resolve(made, batch(spark, {"owner": "Bob"}), 3)
    assert (new["status"], same["status"], moved["status"]) == ("NEW", "UNCHANGED", "CHANGED")
    assert (moved["row_changed"], moved["address_changed"]) == (True, False) and new["address_changed"]
    assert new["canonical_id"] == same["canonical_id"] == moved["canonical_id"]
    row = made.load().first()
    assert row["update_dates"] == [date(2024, 1, 1), date(2024, 1, 3)] and row["last_changed_date"] == date(2024, 1, 3) and row["source_key"] == "ns:k1"


def test_duplicate_null_and_absent_keys(spark, tmp_path):
    made = resolver.Resolver(spark, tmp_path, "places", GROUPS)
    resolve(made, batch(spark, {"source_key": "gone"}), 1)
    out = resolve(made, batch(spark, {"owner": "A"}, {"owner": "B"}, {"source_key": None}).coalesce(1), 2)
    assert [r["status"] for r in out] == ["NEW"] * 3 and out[0]["canonical_id"] is None
    assert out[1]["canonical_id"] == out[2]["canonical_id"] is not None
    store = {r["source_key"]: r for r in made.load().collect()}
    assert set(store) == {"ns:gone", "ns:k1"}
    assert resolve(made, batch(spark, {"owner": "B"}), 3)[0]["status"] == "UNCHANGED"  # the last of twins is stored
    before = made.load().count()
    assert made.resolve(batch(spark, {}).limit(0), source_key_column="source_key", namespace="ns", run_date=date(2024, 1, 4)).count() == 0
    assert made.load().count() == before


def test_excluded_columns_do_not_count(spark, tmp_path):
    made = resolver.Resolver(spark, tmp_path, "places", {"row": hashing.ALL})
    for owner, day in (("A", 1), ("B", 2)):
        out = made.resolve(batch(spark, {"owner": owner}), source_key_column="source_key", namespace="ns", run_date=date(2024, 1, day), exclude_columns={"owner"})
    assert out.first()["status"] == "UNCHANGED"


def test_resolver_errors(spark, tmp_path):
    for name, groups in (("../x", GROUPS), ("", GROUPS), ("x", {}), ("x", {"g": []}), ("x", {"": ["a"]})):
        with pytest.raises(ValueError):
            resolver.Resolver(spark, tmp_path, name, groups)
    made = resolver.Resolver(spark, tmp_path, "x", {"g": ["nope", "also"]})
    for key, namespace, text in (("source_key", "", "namespace"), ("z", "ns", "key column"), ("source_key", "ns", "also, nope")):
        with pytest.raises(ValueError, match=text):
            made.resolve(batch(spark, {}), source_key_column=key, namespace=namespace, run_date=date(2024, 1, 1))
    resolve(resolver.Resolver(spark, tmp_path, "y", {"g": ["owner"]}), batch(spark, {}), 1)
    with pytest.raises(ValueError, match="h_hash"):
        resolver.Resolver(spark, tmp_path, "y", {"g": ["owner"], "h": ["owner"]}).load()


def test_hashes_match_the_library(spark):
    import hashlib

    df = spark.createDataFrame([("a", None, 5)], "x string, y string, z int")
    row = hashing.with_hashes(df, {"g": ["x", "y", "z"], "entry_changed": ["x"]}, "z").first()
    assert row["g_hash"] == hashlib.sha256(b"a\x1f\x1f5").hexdigest()
    assert hashing.changed_name("entry_changed") == "entry_changed_changed"


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcdef"), st.sampled_from("xyz"), min_size=1, max_size=5))
def test_ids_are_stable(spark, tmp_path_factory, data):
    made = resolver.Resolver(spark, tmp_path_factory.mktemp("store"), "s", {"row": hashing.ALL})
    df = spark.createDataFrame(list(data.items()), "source_key string, name string")
    ids = [{r["source_key"]: r["canonical_id"] for r in made.resolve(df, source_key_column="source_key", namespace="n", run_date=date(2024, 1, d)).collect()} for d in (1, 2)]
    assert ids[0] == ids[1] and len(set(ids[0].values())) == len(data)


def test_results_of_earlier_loads_stay_readable(spark, tmp_path):
    made = resolver.Resolver(spark, tmp_path, "places", GROUPS)
    how = {"source_key_column": "source_key", "namespace": "ns"}
    first = made.resolve(batch(spark, {}), **how, run_date=date(2024, 1, 1))
    second = made.resolve(batch(spark, {}, {"source_key": "k2"}), **how, run_date=date(2024, 1, 2))
    assert [r["status"] for r in first.collect()] == ["NEW"] and sorted(r["status"] for r in second.collect()) == ["NEW", "UNCHANGED"]
    assert first.first()["canonical_id"] == first.first()["canonical_id"] == second.where("status = 'UNCHANGED'").first()["canonical_id"]


def data_files(tmp_path):
    return {p: p.stat().st_mtime_ns for p in (tmp_path / resolver.FOLDER / "places.store" / "data").rglob("*.parquet")}


def test_old_loads_are_forgotten(spark, tmp_path, monkeypatch):
    made = resolver.Resolver(spark, tmp_path, "places", GROUPS, buckets=1)
    monkeypatch.setattr(resolver, "KEPT_DAYS", -1)
    for day, owner in enumerate("abcd", 1):
        resolve(made, batch(spark, {"owner": owner}), day)
    store = tmp_path / resolver.FOLDER / "places.store"
    assert len(list((store / "_log").glob("0*.json"))) == 2 and len(list((store / "data").glob("__part=*"))) == 2
    assert made.load().count() == 1


def test_a_load_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    made = resolver.Resolver(spark, tmp_path, "places", {"row": hashing.ALL}, buckets=64)
    how = {"source_key_column": "k", "namespace": "n"}
    table = lambda lo, hi, v: spark.range(lo, hi).select(F.col("id").cast("string").alias("k"), F.lit(v).alias("v"))
    made.resolve(table(0, 1000, 1), **how, run_date=date(2024, 1, 1)).count()
    before, ids = data_files(tmp_path), {r["source_key"]: r["canonical_id"] for r in made.load().collect()}
    out = made.resolve(table(0, 10, 2).unionByName(table(10, 20, 1)), **how, run_date=date(2024, 1, 2))
    assert sorted(r["status"] for r in out.collect()) == ["CHANGED"] * 10 + ["UNCHANGED"] * 10
    after = data_files(tmp_path)
    store = made.table()
    touched = {r[0] for r in spark.range(10).select(F.concat(F.lit("n:"), "id").alias("source_key")).select(store.bucket()).collect()}
    new = set(after) - set(before)
    assert all(after[p] == t for p, t in before.items()) and 0 < len(new) <= len(touched) <= 10
    held = store.log.latest()["owners"]
    assert {i for i, p in enumerate(held) if p.startswith("00000001")} == touched
    got = {r["source_key"]: (r["canonical_id"], len(r["update_dates"])) for r in made.load().collect()}
    assert {k: i for k, (i, _) in got.items()} == ids and sum(n == 2 for _, n in got.values()) == 10
    made.resolve(table(0, 1000, 1).where("k > '10'"), **how, run_date=date(2024, 1, 3))
    assert made.load().count() == 1000


def test_a_load_does_not_shuffle_the_store(spark, tmp_path):
    made = resolver.Resolver(spark, tmp_path, "places", {"row": hashing.ALL}, buckets=8)
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    made.resolve(df, source_key_column="k", namespace="n", run_date=date(2024, 1, 1))
    found = resolver.compared(df, made.load().hint("merge"), {"row": hashing.ALL}, "k", "n")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_of_two_loads_the_second_starts_again(spark, tmp_path, monkeypatch):
    made, other = (resolver.Resolver(spark, tmp_path, "places", GROUPS) for _ in range(2))
    plainly, met = resolver.Resolver.load_changes, []

    def late(self, store, rows, before):
        if not met:
            met.append("")
            met[0] = resolve(other, batch(spark, {}), 1)[0]["canonical_id"]
        return plainly(self, store, rows, before)

    monkeypatch.setattr(resolver.Resolver, "load_changes", late)
    (row,) = resolve(made, batch(spark, {}), 2)
    assert (row["status"], row["canonical_id"]) == ("UNCHANGED", met[0]) and made.load().count() == 1


def test_a_store_on_another_file_system(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.own.link./in", f"file://{tmp_path}")
    made = resolver.Resolver(spark, "viewfs://own/in", "places", GROUPS)
    for day, status in ((1, "NEW"), (2, "UNCHANGED")):
        assert [r["status"] for r in resolve(made, batch(spark, {}), day)] == [status]
    resolve(made, batch(spark, {"owner": "Z"}), 3)
    assert made.load().first()["update_dates"] == [date(2024, 1, 1), date(2024, 1, 3)]


def test_a_version_appears_at_once_or_not_at_all(spark, tmp_path):
    log = versions.Versions(spark, tmp_path / "t")
    assert log.latest() is None
    log.commit(0, {"a": "é"})
    with pytest.raises(versions.Conflict):
        log.commit(0, {"a": 2})
    (tmp_path / "t" / "_log" / ".cut-off").write_text('{"a"')  # a writer killed before its rename
    assert log.latest() == {"a": "é", "version": 0} and log.numbers() == [0]
    log.commit(1, {"a": 3})
    assert log.latest()["a"] == 3 and log.read(0) == {"a": "é"}


def test_foreign_rows_fail_the_kept_side_without_a_check(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], ROWS)
    kept, _ = filters.apply_filter(df, lambda t: t.where("id = 2").distinct(), check=False)
    assert rows(kept) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match=filters.FOREIGN):
        filters.split_by_removed(df, spark.createDataFrame([(9, "z")], ROWS), check=False)[0].collect()


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_batches_on_the_executors_are_exact(spark, size):
    df = spark.range(0, 230, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    out = tables.in_batches(df, lambda f: f.assign(first=f["id"].min(), n=len(f)), size, "id long, s string, first long, n long").collect()
    assert sorted((r["id"], r["s"], r["first"], r["n"]) for r in out) == [(i, str(i) if i % 3 else None, i - i % size, min(size, 230 - (i - i % size))) for i in range(230)]
    assert tables.in_batches(df.limit(0), lambda f: f, size).count() == 0


def test_a_filter_by_batches(spark):
    df = spark.range(0, 100, 1, 3)
    kept, removed = filters.apply_filter(df, filters.batched(lambda f: f.head(1), 10))
    assert sorted(r["id"] for r in removed.collect()) == list(range(0, 100, 10)) and kept.count() == 90


IDS = "_row_id long, n int, gone string"


def test_filters_by_row_number(spark):
    """Twins are told apart, copies that share a number and rows without one are compared whole, and clashing names do not matter."""
    df = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 2, None), (3, 2, None), (3, 2, "y"), (None, 5, "z"), (None, 5, "z"), (None, 6, None)], IDS)
    removed = spark.createDataFrame([(2, 1, "x"), (3, 2, None), (None, 5, "z")], IDS)
    kept, _ = filters.split_by_removed(df, removed)
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, 1, "x"), (3, 2, None), (3, 2, "y"), (None, 5, "z"), (None, 6, None)]))
    for odd in ((9, 1, "x"), (1, 1, "changed"), (None, 7, "z")):
        with pytest.raises(filters.FilterError):
            filters.split_by_removed(df, spark.createDataFrame([odd], IDS))
        with pytest.raises(Exception, match=filters.FOREIGN):
            filters.split_by_removed(df, spark.createDataFrame([odd], IDS), check=False)[0].collect()
    nothing = spark.createDataFrame([], IDS)
    assert filters.split_by_removed(df, nothing)[0].count() == 8
    assert filters.split_by_removed(nothing, nothing)[0].count() == 0


@pytest.mark.parametrize("limit", ["-1", "10485760"])
def test_a_filter_by_row_number_leaves_other_rows_where_they_are(spark, tmp_path, limit):
    """Few removed numbers are broadcast and only their rows are shuffled; many cost one shuffle of the table, which both sides of it share."""
    df = identity.with_row_ids(spark.range(2000).select((F.col("id") % 7).alias("n")))
    df.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        kept = filters.split_by_removed(df, df.where("n = 3"), check=False)[0]
        assert kept.count() == 2000 - 286
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan) == (limit == "-1") == ("BroadcastHashJoin" not in plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_removed_rows_are_compared_without_joins_by_number(spark, monkeypatch):
    """Where most rows go, joins by number came on top of the shuffle that compares them."""
    monkeypatch.setattr(filters, "FEW", 3, raising=False)
    df = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 2, None), (3, 2, None), (None, 5, "z"), (None, 5, "z")], IDS)
    removed = spark.createDataFrame([(2, 1, "x"), (3, 2, None), (None, 5, "z"), (None, 5, "z")], IDS)
    kept, _ = filters.split_by_removed(df, removed)
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, kept.collect())) == [(1, 1, "x"), (3, 2, None)]
    with pytest.raises(filters.FilterError):
        filters.split_by_removed(df, removed.unionByName(removed.where("n = 5")))


def test_retry_by_row_number(spark):
    """Changed rows take their first form's place; copies, rows without a number and rows that are new come back beside what is there."""
    reason = quarantine.REASON
    before = spark.createDataFrame([(1, 1, "x"), (2, 1, "x"), (3, 2, None), (3, 2, "y"), (None, 5, "z"), (None, 5, "z")], IDS)
    aside = spark.createDataFrame([(2, 9, "X", "r"), (3, 2, "y", "r"), (None, 5, "z", "r"), (None, 8, "new", "r"), (7, 7, "new", "r")], f"{IDS}, {reason} string")
    found = sorted(map(str, map(tuple, quarantine.restored(before, aside).collect())))
    assert found == sorted(map(str, [(1, 1, "x"), (2, 9, "X"), (3, 2, None), (3, 2, "y"), (None, 5, "z"), (None, 5, "z"), (None, 8, "new"), (7, 7, "new")]))
    assert quarantine.restored(before, aside.limit(0)).count() == 6
    narrow = aside.where("_row_id = 2").drop("gone").withColumn("more", F.lit(1))
    out = quarantine.restored(before, narrow)
    assert out.columns == [*before.columns, "more"] and out.count() == 6 and out.where("_row_id = 2").first()["n"] == 9


def test_row_numbers_are_no_field(spark, tmp_path):
    """A row's number is not part of its hash: the same rows with other numbers are unchanged."""
    made = resolver.Resolver(spark, tmp_path, "r", {"row": hashing.ALL})
    how = {"source_key_column": "n", "namespace": "a"}
    rows = lambda first: spark.createDataFrame([(first, 1, "x"), (first + 1, 2, None)], IDS)
    assert {r.status for r in made.resolve(rows(0), run_date=date(2024, 1, 1), **how).collect()} == {"NEW"}
    assert {r.status for r in made.resolve(rows(5), run_date=date(2024, 1, 2), **how).collect()} == {"UNCHANGED"}
    with pytest.raises(ValueError, match="of its own"):
        identity.with_row_ids(rows(0))
