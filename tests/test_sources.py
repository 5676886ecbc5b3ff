import json
from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans.model import SourceSpec
from millrace.sources import csv, export, match, records, schema, tables
from millrace.sources.schema import Column, SchemaError, TableSchema


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return path


@pytest.mark.parametrize(("dtype", "kind"), [(str, T.StringType), ("int64", T.LongType), ("uint8", T.LongType), (float, T.DoubleType), ("double", T.DoubleType), (bool, T.BooleanType), ("date", T.DateType), ("datetime64[ns]", T.TimestampNTZType), ("timestamp", T.TimestampNTZType), ("object", T.StringType), ("decimal", T.StringType)])
def test_types_by_name(dtype, kind):
    assert isinstance(schema.spark_type(dtype), kind)


def test_headers_map_by_name(spark, tmp_path):
    path = put(tmp_path / "a.csv", "value,id,extra\n1.5,7,x\n")
    row = csv.read_csv(spark, path, {"id": T.LongType(), "value": T.DoubleType()}).first()
    assert (row["id"], row["value"], row["extra"]) == (7, 1.5, "x")


def test_headerless(spark, tmp_path):
    path = put(tmp_path / "a.csv", "LS1 1AA,Leeds\n")
    assert csv.read_csv(spark, path, has_header=False, column_names=["code", "town"]).first().asDict() == {"code": "LS1 1AA", "town": "Leeds"}
    with pytest.raises(ValueError, match="column names"):
        csv.read_csv(spark, path, has_header=False)


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "utf-8", "utf-8-sig"])
def test_encodings(spark, tmp_path, encoding):
    path = put(tmp_path / "a.csv", "id,name\n1,Café é\n", encoding)
    assert csv.read_csv(spark, path, encoding=encoding).first()["name"] == "Café é"


def test_curly_apostrophe(spark, tmp_path):
    path = put(tmp_path / "a.csv", "id,name\n1,St Mary’s\n", "cp1252")
    assert csv.read_csv(spark, path, encoding="windows-1252").first()["name"] == "St Mary’s"


def test_quotes_breaks_and_empty_fields(spark, tmp_path):
    path = put(tmp_path / "a.csv", 'a,b,c\n"x\ny","say ""hi""",""\n1,,2\n')
    rows = [tuple(r) for r in csv.read_csv(spark, path).collect()]
    assert rows == [("x\ny", 'say "hi"', ""), ("1", None, "2")]


@pytest.mark.parametrize("bad", ["x", "yes", " 5 ", "1.5"])
def test_bad_integers_raise(spark, tmp_path, bad):
    path = put(tmp_path / "a.csv", f"id\n{bad}\n")
    with pytest.raises(Exception, match="not a value"):
        csv.read_csv(spark, path, {"id": T.LongType()}).collect()


def test_ragged_rows_raise(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)malformed"):
        csv.read_csv(spark, put(tmp_path / "a.csv", "a,b\n1,2,3\n")).collect()


def test_no_bytes_and_header_only(spark, tmp_path):
    with pytest.raises(ValueError, match="no data"):
        csv.read_csv(spark, put(tmp_path / "a.csv", ""))
    assert csv.read_csv(spark, put(tmp_path / "b.csv", "a,b\n")).count() == 0


def test_estimates(tmp_path):
    lines = "".join(f"{i},School {i}\n" for i in range(5000))
    assert 4000 <= csv.estimate_rows(put(tmp_path / "a.csv", "URN,Name\n" + lines)) <= 6500
    assert csv.estimate_rows(put(tmp_path / "b.csv", "")) == 0
    assert csv.estimate_rows(put(tmp_path / "c.csv", "a,b\n")) is None


def test_validation_counts_all_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "9")], "id long, name string")
    declared = TableSchema({"id": Column("int", unique=True), "name": Column("str", checks=(schema.matches("^[a-z]$"),))})
    with pytest.raises(SchemaError) as caught:
        schema.validate(df, declared)
    assert caught.value.violations == {"name: null": 1, "name: check 1": 1, "id: duplicate": 1}


def test_null_results_of_checks_do_not_pass(spark):
    df = spark.createDataFrame([("5",)], "v string")
    with pytest.raises(SchemaError):
        schema.validate(df, TableSchema({"v": Column("str", checks=(lambda c: F.lit(None).cast("boolean"),))}))


def test_strictness(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    assert schema.conform(df, TableSchema({"a": Column("int")}, strict="filter")).columns == ["a"]
    assert schema.conform(df, TableSchema({"a": Column("int")})).columns == ["a", "b"]
    for declared in (TableSchema({"a": Column("int")}, strict=True), TableSchema({"z": Column("int")}), TableSchema({"a": Column("str")})):
        with pytest.raises(SchemaError):
            schema.conform(df, declared)
    assert schema.conform(df, TableSchema({"z": Column("int", required=False)})).columns == ["a", "b"]
    assert dict(schema.conform(df, TableSchema({"a": Column("str", coerce=True)})).dtypes)["a"] == "string"


def test_a_bad_row_leaves_nothing(spark, tmp_path):
    body = "".join(f"{'x' if i == 500 else i},n\n" for i in range(1500))
    path = put(tmp_path / "in" / "a.csv", "URN,Name\n" + body)
    declared = TableSchema({"URN": Column("str", checks=(schema.matches("^[0-9]+$"),)), "Name": Column("str")})
    with pytest.raises(SchemaError):
        csv.materialize(spark, path, tmp_path / "out" / "a.parquet", declared)
    assert not (tmp_path / "out" / "a.parquet").exists()


def test_preprocess(spark, tmp_path):
    path = put(tmp_path / "a.txt", "x;y")
    declared = TableSchema({"l": Column("str"), "r": Column("str")})
    split = lambda spark, p: pd.DataFrame([p.read_text().split(";")], columns=["l", "r"])
    assert csv.materialize(spark, path, tmp_path / "a.parquet", declared, preprocess=split) == (1, 2)
    with pytest.raises(SchemaError):
        csv.materialize(spark, path, tmp_path / "b.parquet", TableSchema({"q": Column("str")}), preprocess=split)


def test_many_rows(spark, tmp_path):
    path = put(tmp_path / "a.csv", "id,value\n" + "".join(f"{i},{i * 2}\n" for i in range(120_000)))
    declared = TableSchema({"id": Column("int", unique=True), "value": Column("int")})
    assert csv.materialize(spark, path, tmp_path / "a.parquet", declared, multi_line=False) == (120_000, 2)


def spec(name, pattern, optional=False):
    return SourceSpec(name, pattern, TableSchema(), optional=optional)


def test_matching(tmp_path):
    for name in ("edubase1.csv", "links.csv"):
        put(tmp_path / name, "a\n")
    found = match.match_sources(tmp_path, [spec("links", "links*"), spec("all", "*.csv"), spec("no", "no*", True)])
    assert [(m.spec.name, m.path.name) for m in found] == [("links", "links.csv"), ("all", "edubase1.csv")]


@pytest.mark.parametrize(("specs", "text"), [([("a", "b*", False)], "no file matches"), ([("a", "*", False)], "several files"), ([("a", "edu*", False)], "no source declares"), ([("a", "z*", True)], "no declared source")])
def test_matching_errors(tmp_path, specs, text):
    for name in ("edubase1.csv", "links.csv"):
        put(tmp_path / name, "a\n")
    with pytest.raises(match.SourceMatchError, match=text):
        match.match_sources(tmp_path, [spec(*s) for s in specs])


def test_matching_refuses_folders(tmp_path):
    (tmp_path / "sub").mkdir()
    with pytest.raises(match.SourceMatchError, match="files only"):
        match.match_sources(tmp_path, [spec("a", "*")])
    with pytest.raises(match.SourceMatchError, match="not a directory"):
        match.match_sources(tmp_path / "none", [spec("a", "*")])


def test_publish_over_what_is_read(spark, tmp_path):
    path = tmp_path / "t.parquet"
    assert tables.publish(spark.range(100), path) == 100
    assert tables.publish(spark.read.parquet(str(path)).where("id < 40"), path) == 40
    assert tables.row_count(path) == 40 and [p.name for p in tmp_path.iterdir()] == ["t.parquet"]


def test_a_failed_publish_changes_nothing(spark, tmp_path):
    path = tmp_path / "t.parquet"
    tables.publish(spark.range(10), path)
    with pytest.raises(Exception, match="boom"):
        tables.publish(spark.range(5).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), path)
    assert tables.row_count(path) == 10 and len(list(tmp_path.iterdir())) == 1


def test_counts_and_sizes(spark, tmp_path):
    tables.publish(spark.range(7), tmp_path / "a.parquet")
    tables.publish(spark.range(0), tmp_path / "b.parquet")
    assert tables.row_count_many([tmp_path / "a.parquet", tmp_path / "b.parquet", tmp_path / "none"]) == 7
    assert tables.has_rows(tmp_path / "a.parquet") and not tables.has_rows(tmp_path / "b.parquet")
    assert tables.is_large(tmp_path / "a.parquet", 1) and not tables.is_large(tmp_path / "a.parquet")
    assert spark.read.parquet(str(tmp_path / "b.parquet")).columns == ["id"]


def test_batches(spark, tmp_path):
    tables.publish(spark.range(5), tmp_path / "a.parquet")
    assert [len(b) for b in tables.batches(tmp_path / "a.parquet", 2)] == [2, 2, 1]
    assert [len(b) for b in tables.batches(tmp_path / "a.parquet", 0)] == [5]


def test_writer(spark, tmp_path):
    with tables.TableWriter(tmp_path / "a.parquet") as writer:
        writer.append(spark.range(3))
        writer.append(spark.range(4))
        assert not (tmp_path / "a.parquet").exists()
    assert (writer.rows, writer.columns) == (7, 1) and tables.row_count(tmp_path / "a.parquet") == 7
    with pytest.raises(RuntimeError), tables.TableWriter(tmp_path / "b.parquet") as writer:
        writer.append(spark.range(3))
        raise RuntimeError
    assert [p.name for p in tmp_path.iterdir()] == ["a.parquet"]


def test_csv_chunks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, 'say "b"'), (3, "c")], "id long, name string").coalesce(1)
    files = export.export_csv(df, tmp_path, "out", ["name", "id"], 2)
    assert [(f.filename, f.rows) for f in files] == [("out-00001.csv", 2), ("out-00002.csv", 1)]
    assert (tmp_path / "out-00001.csv").read_text() == 'name,id\na,1\n"say ""b""",2\n'
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out-00001.csv", "out-00002.csv"]
    with pytest.raises(ValueError, match="missing"):
        export.export_csv(df, tmp_path, "x", ["nope"], 2)
    with pytest.raises(ValueError, match="one row"):
        export.export_csv(df, tmp_path, "x", ["id"], 0)
    assert export.export_csv(df.limit(0), tmp_path, "none", ["id"], 2) == []


def test_jsonl_chunks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None), (3, "c")], "id long, name string").coalesce(1)
    files = export.export_jsonl(df, tmp_path, "docs", 2)
    assert [f.documents for f in files] == [2, 1]
    assert (tmp_path / "docs-00001.jsonl").read_text("utf-8").splitlines() == ['{"id":1,"name":"é"}', '{"id":2,"name":null}']
    path = export.write_manifest(tmp_path, {"files": export.as_dicts(files)})
    assert json.loads(path.read_text())["files"][0] == {"filename": "docs-00001.jsonl", "bytes": files[0].bytes, "documents": 2}
    assert path.read_text().endswith("}\n")


def test_chunks_keep_the_order_of_many_partitions(spark, tmp_path):
    files = export.export_csv(spark.range(0, 1000, 1, 7), tmp_path, "n", ["id"], 300)
    assert [f.rows for f in files] == [300, 300, 300, 100]
    text = "".join((tmp_path / f.filename).read_text().replace("id\n", "") for f in files)
    assert text.split() == [str(i) for i in range(1000)]


def test_batches_keep_types_with_nulls(spark, tmp_path):
    rows = [(1, "a", True), (None, None, None), (3, "c", False)]
    tables.publish(spark.createDataFrame(rows, "n long, s string, b boolean").selectExpr("*", "date'2024-01-01' as d").coalesce(1), tmp_path / "a.parquet")
    frames = list(tables.batches(tmp_path / "a.parquet", 2))
    assert [str(t) for t in frames[0].dtypes] == ["Int64", "string", "boolean", "date32[day][pyarrow]"] and len(frames) == 2
    assert frames[0]["n"].isna().tolist() == [False, True] and frames[1]["n"].tolist() == [3]


def test_chunk_writer(spark, tmp_path):
    with export.ChunkWriter(spark, tmp_path, "out", 3, ["id", "name"]) as writer:
        writer.append(spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"))
        writer.append([{"id": 3.5, "name": "c", "more": 1}, {"id": 4.0, "name": None, "more": 2}])
        assert writer.rows == 4 and writer.last_file is None
        with pytest.raises(ValueError, match="missing"):
            writer.append(spark.range(1))
    assert [f.rows for f in writer.files] == [3, 1] and writer.last_file.filename == "out-00002.csv"
    assert (tmp_path / "out-00001.csv").read_text() == "id,name\n1.0,a\n2.0,b\n3.5,c\n"
    with export.ChunkWriter(spark, tmp_path, "docs", 2) as documents:
        documents.append(spark.range(1))
        documents.append([{"id": "é", "list": [1, None]}])
        documents.append([])
    assert (tmp_path / "docs-00001.jsonl").read_text("utf-8") == '{"id":0}\n{"id":"é","list":[1,null]}\n'
    with pytest.raises(RuntimeError), export.ChunkWriter(spark, tmp_path, "x", 2, ["id"]) as writer:
        writer.append(spark.range(3))
        raise RuntimeError
    assert sorted(p.name for p in tmp_path.iterdir()) == ["docs-00001.jsonl", "out-00001.csv", "out-00002.csv"]
    assert export.ChunkWriter(spark, tmp_path, "none", 2, ["id"]).close() == []


def test_chunk_writer_takes_uneven_dictionaries(spark, tmp_path):
    with export.ChunkWriter(spark, tmp_path, "out", 100, ["id", "name", "when", "none"]) as writer:
        writer.append([{"id": None, "name": None}, {"id": None}])  # all null
        writer.append([{"id": 1}, {"name": "b", "id": 2.5, "x": [1]}, {}, {"when": date(2024, 1, 2), "name": {"a": "é"}}])  # unlike keys
        writer.append([{"id": "z", "name": True}, {"name": 3}])  # unlike types
        writer.append(spark.createDataFrame([(7, "d")], "id long, name string").selectExpr("*", "date'2024-01-03' as when", "null as none"))
    assert writer.rows == 9 and (tmp_path / "out-00001.csv").read_text("utf-8") == 'id,name,when,none\n,,,\n,,,\n1.0,,,\n2.5,b,,\n,,,\n,"{""a"": ""é""}",2024-01-02,\nz,True,,\n,3,,\n7,d,2024-01-03,\n'


def quoted_files(folder, seed, n=400):
    import csv as plain
    import random

    rnd = random.Random(seed)
    field = lambda: "" if rnd.random() < 0.2 else "".join(rnd.choice(["a", "b", '"', '""', ",", "\n", "\r\n", " ", "é", '5" x', ""]) for _ in range(rnd.randint(0, 8)))
    rows = [[str(i), field(), field()] for i in range(n)]
    for part in (0, 1):
        with (folder / f"{part}.csv").open("w", newline="", encoding="utf-8") as f:
            out = plain.writer(f, lineterminator=rnd.choice(["\n", "\r\n"]), quoting=rnd.choice([plain.QUOTE_MINIMAL, plain.QUOTE_ALL]))
            out.writerow(["id", "x", "y"])
            out.writerows(rows[part::2])
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 60), (2, 333), (3, 1500), (4, 1 << 20)])
def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path, seed, size):
    rows = quoted_files(tmp_path, seed)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = csv.read_csv(spark, tmp_path)
        got = sorted(([v or "" for v in r] for r in df.collect()), key=lambda r: int(r[0]))
        assert got == rows and (size > 2000 or df.rdd.getNumPartitions() > 2)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_blocks_that_change_between_the_two_readings_raise(spark, tmp_path):
    quoted_files(tmp_path, 5)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = csv.read_csv(spark, tmp_path)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
        with pytest.raises(Exception, match="other blocks"):
            df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize(("line", "inside", "ends"), [('a,b', False, False), ('a,b', True, True), ('a,"b', False, True), ('"a', False, True), ('a"b', False, False), ('a"', True, False), ('a""', True, True), ('a"",b', True, True), ('"a""b",c', False, False), ('5" x,"y', False, True), ('x",5" y', True, False), ('', True, True), ('"', True, False), ('""', False, False), ('a, "b', False, False)])
def test_where_a_line_ends(line, inside, ends):
    assert records.line_ends()(line, inside) is ends


def test_a_replacement_that_was_cut_off_leaves_the_old_table(spark, tmp_path):
    target = tmp_path / "a.parquet"
    tables.publish(spark.range(3), target)
    target.rename(tmp_path / "a.parquet.old-1")  # as between the two renames
    assert tables.row_count(tables.settled(target)) == 3
    tables.publish(spark.range(5), target)
    assert tables.row_count(target) == 5 and [p.name for p in tmp_path.iterdir()] == ["a.parquet"]
