import sqlite3
import threading
import time

import pytest
from pyspark.sql import functions as F

from millrace import Pipeline, SourceSpec, TableSpec
from millrace.plans import cleanup, cli, discovery, display, engine, environment, logs, stats
from millrace.plans.ingest import ingest
from millrace.plans.model import ExecutionMode, slug
from millrace.plans.state import FileRecord, IngestBlocked, Manifest, NoRun, Role, Runs, RunStatus, StepStatus
from millrace.sources.match import SourceMatchError
from millrace.sources.schema import Column, TableSchema, matches

PLACES = TableSchema({"URN": Column("str", checks=(matches("^[0-9]+$"),)), "Name": Column("str")}, strict="filter")


class A(TableSpec):
    source = "a"


class B(TableSpec):
    source = "b"


def make(configure, mode="serial", optional=False, workers=None, execution="serial"):
    class Made(Pipeline):
        name = "made"
        step_execution_mode = ExecutionMode(mode)
        execution_mode = ExecutionMode(execution)
        max_parallel_workers = workers
        sources = [SourceSpec("a", "a*.csv", PLACES), SourceSpec("b", "b*.csv", PLACES, optional=optional)]

    Made.configure = configure
    return Made()


def start(spark, tmp_path, pipeline, b=True):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    (folder / "a.csv").write_text("URN,Name,Extra\n1,Open,x\n2,Closed,y\n999,Open,z\n")
    if b:
        (folder / "b.csv").write_text("URN,Name\n5,Open\n")
    done = ingest(spark, tmp_path, pipeline, folder)
    return done.run_directory


def go(spark, tmp_path, pipeline, directory, **how):
    try:
        return engine.run_steps(spark, tmp_path, pipeline, directory, Runs(tmp_path).manifest(directory), **how)
    finally:
        how.clear()


def states(tmp_path, directory):
    manifest = Runs(tmp_path).manifest(directory)
    return manifest.status, {s.step_id: s.status for s in manifest.step_states}


def nothing(context, handles):
    pass


def test_ingest_and_filters(spark, tmp_path):
    def configure(self):
        self.add_filter("Closed", F.col("Name") == "Closed", [A()])
        self.add_filter("Nine", lambda df: df.where("URN = '999'"), [A()])

    pipeline = make(configure)
    directory = start(spark, tmp_path, pipeline)
    result = go(spark, tmp_path, pipeline, directory)
    assert (result.steps_completed, result.status) == (2, RunStatus.COMPLETED)
    kept = spark.read.parquet(str(directory / "ingested" / "a.parquet")).collect()
    assert [tuple(r) for r in kept] == [("1", "Open")]
    removed = spark.read.parquet(str(directory / "filtered" / "closed" / "a.parquet")).collect()
    assert [tuple(r) for r in removed] == [("2", "Closed")]
    found = {(s.scope, s.subject, s.action): s.value for s in stats.StatsStore.of(tmp_path).stats(directory.name)}
    assert found["file", "a", "rows_removed"] == 1 and found["run", None, "rows_ingested"] == 4 and found["run", None, "steps_completed"] == 2
    assert stats.StatsStore.of(tmp_path).files(directory.name) == ["a", "b"]


def test_serial_gate_and_failed_ingest(spark, tmp_path):
    pipeline = make(lambda self: self.add_step("S", nothing, [A()]))
    start(spark, tmp_path, pipeline)
    with pytest.raises(IngestBlocked) as caught:
        start(spark, tmp_path, pipeline)
    assert caught.value.run_ids == [p.name for p in Runs(tmp_path).directories()]
    free = make(lambda self: self.add_step("S", nothing, [A()]), execution="parallel")
    (tmp_path / "in" / "junk.txt").write_text("")
    with pytest.raises(SourceMatchError):
        start(spark, tmp_path, free)
    assert len(Runs(tmp_path).directories()) == 1 and len(stats.StatsStore.of(tmp_path).runs()) == 1
    (Runs(tmp_path).root / "zzzzz").mkdir()
    assert "zzzzz" in Runs(tmp_path).incomplete()


def quarantining(released):
    def check(context, handles):
        (a,) = handles
        df = a.load()
        bad = F.col("URN") == "999"
        if not released and not df.where(bad).isEmpty():
            context.quarantine.rows("a", df.where(bad), "bad URN")
            a.sink(df.where(~bad))

    return check


@pytest.mark.parametrize("mode", ["serial", "parallel"])
def test_quarantine_block_and_retry(spark, tmp_path, mode):
    released = []

    def configure(self):
        self.add_step("Check", quarantining(released), [A()])
        self.add_step("After", nothing, [A()], depends_on=["check"])
        self.add_step("Free", nothing, [B()])

    pipeline = make(configure, mode)
    directory = start(spark, tmp_path, pipeline)
    for _ in range(2):
        assert go(spark, tmp_path, pipeline, directory).status == RunStatus.FAILED
        status, steps = states(tmp_path, directory)
        assert steps["check"] == StepStatus.QUARANTINED and steps["after"] == StepStatus.BLOCKED
        assert spark.read.parquet(str(directory / "ingested" / "a.parquet")).count() == 2
    assert Runs(tmp_path).resolve()[0] == directory
    released.append(True)
    assert go(spark, tmp_path, pipeline, directory).status == RunStatus.COMPLETED
    rows = spark.read.parquet(str(directory / "ingested" / "a.parquet")).collect()
    assert sorted(r["URN"] for r in rows) == ["1", "2", "999"]
    with pytest.raises(ValueError, match="cannot be processed"):
        go(spark, tmp_path, pipeline, directory)


@pytest.mark.parametrize("mode", ["serial", "parallel"])
def test_errors_stop_a_run(spark, tmp_path, mode):
    ran = []

    def boom(context, handles):
        raise KeyError("boom")

    def configure(self):
        self.add_step("Boom", boom, [A()])
        self.add_step("After", lambda c, h: ran.append(1), [A()], depends_on=["boom"])

    pipeline = make(configure, mode)
    directory = start(spark, tmp_path, pipeline)
    with pytest.raises(KeyError):
        go(spark, tmp_path, pipeline, directory)
    status, steps = states(tmp_path, directory)
    assert status == RunStatus.FAILED and steps == {"boom": "failed", "after": "pending"} and not ran
    assert any(s.action == "duration_ms" and s.subject == "boom" for s in stats.StatsStore.of(tmp_path).stats(directory.name))
    with pytest.raises(NoRun):
        Runs(tmp_path).resolve()


def slow(started, rows):
    """A step whose Spark job takes minutes."""

    def run(context, handles):
        started.set()
        handles[0].sink(handles[0].load().crossJoin(context.spark.range(rows).select(F.udf(lambda x: time.sleep(0.05) or x, "long")("id").alias("x"))).where("x >= 0").drop("x"))

    return run


def test_a_failed_step_ends_the_jobs_of_others(spark, tmp_path):
    started, tracker = threading.Event(), spark.sparkContext.statusTracker()

    def boom(context, handles):
        assert started.wait(20)
        time.sleep(1)
        raise KeyError("boom")

    def configure(self):
        self.add_step("Slow", slow(started, 100_000), [A()])
        self.add_step("Boom", boom, [B()])
        self.add_step("After", nothing, [A()], depends_on=["slow"])

    pipeline = make(configure, "parallel", workers=3)
    pipeline.cancel_on_failure = True
    directory, begun = start(spark, tmp_path, pipeline), time.monotonic()
    with pytest.raises(KeyError):
        go(spark, tmp_path, pipeline, directory)
    assert time.monotonic() - begun < 60 and not tracker.getActiveJobsIds()
    status, steps = states(tmp_path, directory)
    assert status == RunStatus.FAILED and steps == {"slow": "pending", "boom": "failed", "after": "pending"}
    assert "boom has failed" in next(s.detail for s in Runs(tmp_path).manifest(directory).step_states if s.step_id == "slow")
    (ingested,) = [f.parquet_path for f in Runs(tmp_path).manifest(directory).ingested_files if f.name == "a"]
    assert spark.read.parquet(ingested).count() == 3 and not list(directory.rglob("*.staging-*"))


@pytest.mark.parametrize("mode", ["serial", "parallel"])
def test_a_run_is_cancelled_from_outside(spark, tmp_path, mode):
    started = threading.Event()

    def configure(self):
        self.add_step("Slow", slow(started, 100_000), [A()])
        self.add_step("After", nothing, [A()], depends_on=["slow"])

    pipeline = make(configure, mode)
    directory = start(spark, tmp_path, pipeline)
    run = engine.Run(spark, tmp_path, pipeline, directory, Runs(tmp_path).manifest(directory), display.StepTracker(pipeline))
    stop = threading.Thread(target=lambda: started.wait(20) and run.cancel("enough"))
    stop.start()
    with pytest.raises(engine.Cancelled, match="enough"):
        run.go()
    stop.join()
    assert states(tmp_path, directory) == (RunStatus.FAILED, {"slow": "pending", "after": "pending"})


@pytest.mark.parametrize("mode", ["serial", "parallel"])
def test_a_step_accounts_for_its_own_jobs(spark, tmp_path, mode):
    """Steps side by side are told apart, a failed step's jobs are counted, and a second try is not charged for the first."""
    tries = []

    def counted(context, handles):
        tries.append(context.step_id)
        for _ in range(len(tries) if context.step_id == "again" else 1):
            handles[0].load().repartition(2).count()
        if context.step_id == "again" and len(tries) < 3:
            context.quarantine.rows("b", handles[0].load(), "not yet")

    def configure(self):
        self.add_step("Copy", lambda context, handles: handles[0].save_to("copies", "a.parquet", handles[0].load().repartition(3)), [A()])
        self.add_step("Again", counted, [B()])
        self.add_step("Nothing", nothing, [B()], depends_on=["again"])

    pipeline = make(configure, mode)
    pipeline.account_jobs = True
    directory = start(spark, tmp_path, pipeline)
    of = lambda step: {s.action: s.value for s in stats.StatsStore.of(tmp_path).stats(Runs(tmp_path).manifest(directory).run_id, subject=step)}
    for rows_read in (1 + 1, 2 + 1, 3):  # b has one row, which the first two tries set aside as well
        go(spark, tmp_path, pipeline, directory)
        assert of("again")["rows_read"] == rows_read
    assert of("copy") | {"rows_read": 3, "rows_written": 3, "bytes_spilled": 0} == of("copy")
    assert of("copy")["bytes_written"] > 0 < of("copy")["bytes_shuffled"]
    assert {of("nothing")[x] for x in ("rows_read", "bytes_read", "rows_written", "bytes_written")} == {0}


@pytest.mark.parametrize("row_ids", [True, False])
def test_a_retry_knows_changed_twins_by_their_number(spark, tmp_path, row_ids):
    """Of two equal rows one is changed and set aside; the retry has each once by number. Without numbers, both first forms come back beside it."""
    tries = []

    def check(context, handles):
        (a,) = handles
        df = a.load()
        tries.append(df.count())
        if len(tries) == 1:
            one = df.where("URN = '1'").limit(1).withColumn("Name", F.lit("Changed"))
            context.quarantine.rows("a", one, "not yet")

    pipeline = make(lambda self: self.add_step("Check", check, [A()]))
    pipeline.row_ids = row_ids
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("URN,Name\n1,Twin\n1,Twin\n2,Other\n")
    (folder / "b.csv").write_text("URN,Name\n5,Open\n")
    directory = ingest(spark, tmp_path, pipeline, folder).run_directory
    for _ in range(2):
        go(spark, tmp_path, pipeline, directory)
    names = [r["Name"] for r in spark.read.parquet(str(directory / "ingested" / "a.parquet")).collect()]
    assert sorted(names) == (["Changed", "Other", "Twin"] if row_ids else ["Changed", "Other", "Twin", "Twin"])
    assert tries == [3, len(names)]


def test_errors_of_cancelled_jobs_are_told_apart():
    inner = RuntimeError("[SPARK_JOB_CANCELLED] Job 1 cancelled")
    outer = ValueError("the step failed")
    outer.__cause__ = inner
    assert engine.by_cancelling(outer) and not engine.by_cancelling(ValueError("other")) and not engine.by_cancelling(None)


def test_optional_sources(spark, tmp_path):
    def configure(self):
        self.add_step("Only b", nothing, [B()])
        self.add_step("Both later", nothing, [A()], depends_on=["only-b"])

    pipeline = make(configure, optional=True)
    directory = start(spark, tmp_path, pipeline, b=False)
    assert go(spark, tmp_path, pipeline, directory).status == RunStatus.COMPLETED
    assert states(tmp_path, directory)[1] == {"only-b": "skipped", "both-later": "complete"}
    mixed = make(lambda self: self.add_step("Mixed", nothing, [A(), B()]), optional=True, execution="parallel")
    directory = start(spark, tmp_path, mixed, b=False)
    with pytest.raises(ValueError, match=r"absent \(b\).*there \(a\)"):
        go(spark, tmp_path, mixed, directory)
    required = make(lambda self: self.add_step("S", nothing, [B()]))
    with pytest.raises(ValueError, match="no table of source 'b'"):
        engine.run_steps(spark, tmp_path, required, directory, Runs(tmp_path).manifest(directory).model_copy(update={"status": RunStatus.INGESTED}))


def test_parallel_steps_overlap_but_share_tables_in_turn(spark, tmp_path):
    inside, most, meet = {"a": 0, "b": 0}, {"a": 0}, threading.Barrier(2, timeout=20)

    def on(name, wait):
        def run(context, handles):
            inside[name] += 1
            most["a"] = max(most["a"], inside["a"])
            if wait:
                meet.wait()
            time.sleep(0.05)
            inside[name] -= 1

        return run

    def configure(self):
        self.add_step("A1", on("a", True), [A()])
        self.add_step("B1", on("b", True), [B()])
        self.add_step("A2", on("a", False), [A()])

    pipeline = make(configure, "parallel", workers=4)
    directory = start(spark, tmp_path, pipeline)
    assert go(spark, tmp_path, pipeline, directory).steps_completed == 3 and most["a"] == 1
    assert engine.worker_count(make(lambda self: self.add_step("S", nothing, [A()]))) == 1
    with pytest.raises(ValueError, match="worker"):
        engine.worker_count(make(lambda self: self.add_step("S", nothing, [A()]), "parallel", workers=0))


def test_declarations():
    assert slug(" Drop: closed! ") == "drop-closed" and slug("!!") == "step"
    for configure, text in (
        (lambda self: None, "no steps"), (lambda self: self.add_step("S", nothing, []), "needs a table"), (lambda self: [self.add_step("S", nothing, [A()]) for _ in "12"], "already"),
        (lambda self: self.add_step("S", nothing, [A()], depends_on=["later"]), "later"), (lambda self: self.add_step("S", nothing, [type("C", (TableSpec,), {"source": "c"})()]), "'c'"), (lambda self: self.add_step("S", nothing, [TableSpec()]), "names no source"),
    ):
        with pytest.raises(ValueError, match=text):
            make(configure)
    with pytest.raises(TypeError):
        type("P", (Pipeline,), {"sources": []})
    with pytest.raises(TypeError, match="twice"):
        type("P", (Pipeline,), {"sources": [SourceSpec("a", "x", PLACES)] * 2})
    for how in ({"name": ""}, {"name": "a b"}, {"pattern": ""}, {"encoding": ""}, {"has_header": False}):
        with pytest.raises(ValueError):
            SourceSpec(**({"name": "a", "pattern": "x", "schema": PLACES} | how))


def test_handles(spark, tmp_path):
    seen = {}

    def step(context, handles):
        (a,) = handles
        seen["rows"], seen["large"], seen["batches"] = a.row_count(), a.is_large(), [len(x) for x in a.batches(2)]
        path = a.save_to("sub", "x.parquet", a.load().limit(1))
        assert a.active == path and a.row_count() == 1
        a.save_in_place(a.load())
        assert a.active == a.ingested
        a.sink(a.scan())
        for folder, name in (("", "x"), ("s", ""), ("/abs", "x"), ("..", "x"), ("s", "../../x")):
            with pytest.raises(ValueError):
                a.output_path(folder, name)
        with pytest.raises(ValueError, match="no table"):
            a.set_active(tmp_path / "none")
        a.set_active(path)

    pipeline = make(lambda self: self.add_step("S", step, [A()]))
    directory = start(spark, tmp_path, pipeline)
    go(spark, tmp_path, pipeline, directory)
    assert seen == {"rows": 3, "large": False, "batches": [2, 1]}


def test_which_run(tmp_path):
    runs, made = Runs(tmp_path), {}
    with pytest.raises(NoRun):
        runs.resolve()
    for i, (status, step) in enumerate([("ingested", None), ("failed", "quarantined"), ("quarantined", "quarantined"), ("completed", None)]):
        directory, manifest = runs.create("p", ExecutionMode.PARALLEL, tmp_path)
        manifest.status, manifest.ingested_at = RunStatus(status), manifest.created_at
        if step:
            manifest.set_step("s", StepStatus(step))
        runs.save(directory, manifest)
        made[status] = directory
    for status in ("quarantined", "failed", "ingested"):
        assert runs.resolve()[0] == made[status]
        runs.discard(made[status])
    for run_id, text in ((made["completed"].name, "completed"), ("nope", "no run nope")):
        with pytest.raises(NoRun, match=text):
            runs.resolve(run_id)


def test_statistics(tmp_path, spark):
    store = stats.StatsStore(tmp_path / "s.db")
    recorder = stats.Recorder(store, "r")
    for call, error in ((lambda: recorder.run("", 1), ValueError), (lambda: recorder.file("", "a", 1), ValueError), (lambda: recorder.step("a", 1), ValueError), (lambda: recorder.run("a", "1"), TypeError)):
        with pytest.raises(error):
            call()
    directory, manifest = Runs(tmp_path).create("p", ExecutionMode.SERIAL, tmp_path)
    store.record_run(manifest)
    recorder = stats.Recorder(store, manifest.run_id)
    recorder.run("rows", 1)
    recorder.run("rows", 2.5)
    recorder.for_step("s").step("rows", 3)
    assert [(s.subject, s.value) for s in store.stats(manifest.run_id)] == [(None, 2.5), ("s", 3.0)]
    assert len(store.stats(manifest.run_id, scope=stats.Scope.STEP, subject="s", action="rows")) == 1
    assert stats.listed(stats.as_table(spark, store.stats(manifest.run_id)), scope="step").count() == 1
    store.delete_run(manifest.run_id)
    assert store.runs() == [] and store.stats(manifest.run_id) == []
    with store.connect() as c:
        c.execute("UPDATE schema_version SET version = 99")
    with pytest.raises(RuntimeError, match="newer"):
        stats.StatsStore(tmp_path / "s.db").runs()


def test_a_database_of_the_first_version_is_taken_over(tmp_path):
    with sqlite3.connect(tmp_path / "s.db") as c:
        c.execute("CREATE TABLE schema_version (version INTEGER NOT NULL)")
        c.execute("INSERT INTO schema_version VALUES (1)")
        c.execute(f"CREATE TABLE runs ({stats.TABLES['runs']})")
        c.execute("INSERT INTO runs VALUES ('r', 'p', 'completed', '', '2024-01-01', NULL)")
        for name, size in (("ingest_files", "source_size_bytes"), ("output_files", "output_size_bytes")):
            c.execute(f"CREATE TABLE {name} (id INTEGER PRIMARY KEY AUTOINCREMENT, run_id TEXT, file_name TEXT, source_path TEXT, parquet_path TEXT, row_count INTEGER, column_count INTEGER, {size} INTEGER)")
            c.executemany(f"INSERT INTO {name} (run_id, file_name, source_path, parquet_path, row_count, column_count, {size}) VALUES (?, ?, 's', 'p', 3, 2, 70)", [("r", f"{name}-{i}") for i in range(2)])
    c.close()
    for _ in range(2):
        store = stats.StatsStore(tmp_path / "s.db")
        assert store.files("r") == ["ingest_files-0", "ingest_files-1"] and store.files("r", Role.OUTPUT) == ["output_files-0", "output_files-1"]
        assert FileRecord(**store.file_facts("r", Role.OUTPUT)[1]).size_bytes == 70


def test_a_manifest_of_an_earlier_version_is_read():
    assert FileRecord.model_validate_json('{"name": "a", "source_path": "s", "parquet_path": "p", "row_count": 1, "column_count": 1, "source_size_bytes": 9}').size_bytes == 9


def test_statistic_texts():
    scope = stats.Scope
    assert stats.log_line("r", scope.RUN, None, "rows", 5) == "STAT run=r scope=run subject=- action=rows value=5"
    assert stats.shown(scope.FILE, "a", "rows_kept", 12000.0) == "Stat · a · rows kept · 12,000"
    assert stats.shown(scope.STEP, "s", "duration_ms", 5.0) == "Stat · s · duration · 5 ms"
    assert stats.shown(scope.RUN, None, "share", 0.25) == "Stat · share · 0.25"


def test_environment(tmp_path, monkeypatch):
    base = tmp_path / "x" / "y" / "pipe"
    base.mkdir(parents=True)
    for name in ("DATA_ENV", "PAF_ENV", "MR_ONE", "MR_TWO"):
        monkeypatch.delenv(name, raising=False)
    assert environment.resolve_environment(base).root == tmp_path / "x" / "data" / "environments" / "dev"
    monkeypatch.setenv("PAF_ENV", "live")
    assert environment.resolve_environment(base).name == "live"
    (base / "environment.local").write_text("DATA_ENV='local'\n")
    assert environment.resolve_environment(base).root == base / "local"
    monkeypatch.setenv("DATA_ENV", str(tmp_path / "env"))
    (tmp_path / "env").mkdir()
    (tmp_path / "env" / ".env").write_text('# note\nENV_NAME="named"\nMR_ONE=1\nMR_TWO=2\nbroken\n')
    found = environment.resolve_environment(base)
    assert found.name == "named" and found.file("sqlite", "p.db") == found.root / "sqlite" / "p.db"
    monkeypatch.setenv("MR_ONE", "kept")
    environment.load_environment(found)
    import os

    assert (os.environ["MR_ONE"], os.environ.pop("MR_TWO")) == ("kept", "2")


def test_cleanup(tmp_path):
    runs = Runs(tmp_path)
    for status in RunStatus:
        directory, manifest = runs.create("p", ExecutionMode.PARALLEL, tmp_path)
        manifest.status = status
        runs.save(directory, manifest)
        stats.StatsStore.of(tmp_path).record_run(manifest)
    (tmp_path / ".persistent").mkdir()
    plan = cleanup.plan_cleanup(tmp_path)
    assert len(plan.run_ids) == 2 and all(x.startswith("would remove") for x in cleanup.clean_up(tmp_path, plan, dry_run=True))
    cleanup.clean_up(tmp_path, plan)
    assert len(runs.directories()) == 3 and len(stats.StatsStore.of(tmp_path).runs()) == 3
    cleanup.clean_up(tmp_path, cleanup.plan_cleanup(tmp_path, everything=True))
    assert not runs.directories() and not (tmp_path / ".persistent").exists() and not stats.StatsStore.of(tmp_path).path.exists()


PIPELINE = '''
from helper import NAME
from millrace import Pipeline, SourceSpec, TableSpec
from millrace.sources.schema import Column, TableSchema

class A(TableSpec):
    source = "a"

class P(Pipeline):
    name = NAME
    sources = [SourceSpec("a", "a*.csv", TableSchema({"URN": Column("str"), "Name": Column("str")}))]
    def configure(self):
        self.add_step("First", lambda c, h: None, [A()])
        self.add_step("Second", lambda c, h: None, [A()], depends_on=["first"])

pipeline = P()
'''


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "helper.py").write_text("NAME = 'helped'")
    (tmp_path / "pipeline.py").write_text(PIPELINE)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("URN,Name\n1,x\n")
    at = ["-C", str(tmp_path)]
    assert cli.main(["run", *at, "--mode", "cli"]) == 1
    assert cli.main(["ingest", *at, str(tmp_path / "none")]) == 1
    assert cli.main(["ingest", *at, str(tmp_path / "in")]) == 0
    assert cli.main(["ingest", *at, str(tmp_path / "in")]) == 1
    assert cli.main(["run", *at]) == 0
    out = capsys.readouterr().out
    assert "✓ First" in out and "Run completed" in out
    assert cli.main(["describe", *at]) == 0 and cli.main(["list", *at]) == 0
    out = capsys.readouterr().out
    assert "helped" in out and "▼" in out and "completed" in out
    text = (Runs(tmp_path).directories()[0] / "log").read_text()
    assert text.count("=====") == 4 and "STAT run=" in text
    assert cli.main(["cleanup", *at, "--dry-run"]) == 0 and Runs(tmp_path).directories()
    assert cli.main(["cleanup", *at, "-y"]) == 0 and not Runs(tmp_path).directories()
    assert cli.main(["cleanup", *at]) == 0
    assert cli.main(["describe", "-C", str(tmp_path / "in")]) == 1


def test_discovery(tmp_path):
    assert discovery.load_pipeline(tmp_path) is None
    (tmp_path / "pipeline.py").write_text("pipeline = 5")
    assert discovery.load_pipeline(tmp_path) is None
    (tmp_path / "pipeline.py").write_text("raise RuntimeError('bad')")
    import sys

    mine = lambda: [m for m in sys.modules if m.startswith("_millrace_pipeline_")]
    before = (mine(), list(sys.path))
    with pytest.raises(RuntimeError):
        discovery.load_pipeline(tmp_path)
    assert (mine(), list(sys.path)) == before


def test_branching_diagram():
    def configure(self):
        self.add_step("One", nothing, [A()])
        self.add_step("Two", nothing, [B()])
        self.add_filter("Three", lambda df: df, [A()], depends_on=["one", "two"])

    text = display.flow_diagram(make(configure, "parallel"))
    assert "one ──▶ three" in text and "two ──▶ three" in text and "[filter] three" in text
    assert "Ingest" in text.splitlines()[4] and "a, b" in text

    middle = lambda word: next(line.index(word) + len(word) // 2 for line in text.splitlines() if word in line)
    drawn = [line for line in text.splitlines() if set(line.strip()) <= set("│─┬┴┼▼ ") and line.strip()]
    assert drawn[-1].count("▼") == 1 and "┴" in "".join(drawn) and abs(drawn[-1].index("▼") - middle("[filter] three")) <= 1


def test_connectors():
    assert display.connectors({"a": 2}, {"b": 2}, [("a", "b")]) == ["  │", "  ▼"]
    assert display.connectors({"a": 1, "b": 7}, {"c": 4}, [("a", "c"), ("b", "c")]) == [" ┴──┬──┴", "    ▼"]
    assert display.connectors({"a": 4}, {"b": 1, "c": 7}, [("a", "b"), ("a", "c")]) == [" ┬──┼", " │  ┴──┬", " ▼     ▼"]


def test_log_buffer():
    import logging

    with logs.logging_session(console=False) as session:
        for i in range(600):
            logging.getLogger("millrace.x").info("line %s", i)
        assert len(session.buffer.records) == logs.KEPT and session.buffer.records[-1].getMessage() == "line 599"
    assert session.buffer not in logging.getLogger("millrace").handlers


def test_manifest_round_trip(tmp_path):
    directory, manifest = Runs(tmp_path).create("p", ExecutionMode.SERIAL, tmp_path)
    manifest.set_step("a", StepStatus.PENDING)
    manifest.set_step("b", StepStatus.PENDING)
    manifest.set_step("a", StepStatus.COMPLETE, "x")
    assert Manifest.model_validate_json(manifest.model_dump_json()) == manifest
    assert [s.step_id for s in manifest.step_states] == ["a", "b"] and manifest.step_states[0].detail == "x"


def test_files_are_ingested_once_as_they_arrive(spark, tmp_path):
    from millrace.streaming.incremental import ingest_available

    (tmp_path / "in").mkdir()
    how = {"folder": tmp_path / "in", "target": tmp_path / "out", "checkpoint": tmp_path / "cp", "schema": PLACES}
    for i in (1, 2):
        (tmp_path / "in" / f"{i}.csv").write_text(f"URN,Name\n{i},x\n")
        assert ingest_available(spark, **how) == 1
    assert ingest_available(spark, **how) == 0
    assert sorted(r["URN"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2"]
    (tmp_path / "in" / "3.csv").write_text("URN,Name\nx,x\n")
    with pytest.raises(Exception, match="breaks the schema"):
        ingest_available(spark, **how)


@pytest.mark.parametrize("names", [("URN",), ("URN", "Name")])
def test_a_stream_refuses_keys_of_earlier_files(spark, tmp_path, names):
    from millrace.sources.schema import Column, TableSchema
    from millrace.streaming.incremental import DuplicateKey, ingest_available

    (tmp_path / "in").mkdir()
    unique = TableSchema({"URN": Column("int", nullable=True, unique=True), "Name": Column("str", nullable=True, unique="Name" in names)})
    how = {"folder": tmp_path / "in", "target": tmp_path / "out", "checkpoint": tmp_path / "cp", "schema": unique}
    (tmp_path / "in" / "1.csv").write_text("URN,Name\n1,a\n2,b\n,\n,\n9007199254740993,c\n")
    assert ingest_available(spark, **how) == 1
    (tmp_path / "in" / "2.csv").write_text("URN,Name\n3,d\n01,e\n")
    for _ in range(2):  # nothing of it is committed, however often it is tried
        with pytest.raises(DuplicateKey, match="duplicate 'URN=1'"):
            ingest_available(spark, **how)
    (tmp_path / "in" / "2.csv").write_text("URN,Name\n3,d\n4,e\n")
    assert ingest_available(spark, **how) == 1
    got = sorted(((r["URN"] or 0, r["Name"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted([(1, "a"), (2, "b"), (0, None), (0, None), (9007199254740993, "c"), (3, "d"), (4, "e")], key=str)


def test_a_stream_keeps_its_keys_in_few_groups(spark, tmp_path, monkeypatch):
    """A call for each key took milliseconds, so a stream of millions never ended."""
    from millrace.sources.schema import Column, TableSchema
    from millrace.streaming import incremental

    monkeypatch.setattr(incremental, "GROUPS", 3, raising=False)
    (tmp_path / "in").mkdir()
    unique = TableSchema({"id": Column("int", unique=True), "name": Column("str", nullable=True, unique=True)})
    how = {"folder": tmp_path / "in", "target": tmp_path / "out", "checkpoint": tmp_path / "cp", "schema": unique}
    (tmp_path / "in" / "1.csv").write_text("id,name\n" + "".join(f'{i},"{i}""\n,é"\n' for i in range(200)))
    assert incremental.ingest_available(spark, **how) == 1
    assert spark.read.format("statestore").load(str(tmp_path / "cp")).count() <= 6
    (tmp_path / "in" / "2.csv").write_text('id,name\n200,"199""\n,é"\n')
    with pytest.raises(incremental.DuplicateKey):
        incremental.ingest_available(spark, **how)
    (tmp_path / "in" / "2.csv").write_text("id,name\n200,0\n201,\n")
    assert incremental.ingest_available(spark, **how) == 1
    got = {(r["id"], r["name"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(i, f'{i}"\n,é') for i in range(200)} | {(200, "0"), (201, None)}


def test_a_stream_refuses_a_key_twice_in_one_file(spark, tmp_path):
    from millrace.sources.schema import Column, TableSchema
    from millrace.streaming.incremental import DuplicateKey, ingest_available

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.csv").write_text("id\n1\n2\n1\n")
    with pytest.raises(DuplicateKey):
        ingest_available(spark, folder=tmp_path / "in", target=tmp_path / "out", checkpoint=tmp_path / "cp", schema=TableSchema({"id": Column("int", unique=True)}))
