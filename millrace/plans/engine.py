"""Running a pipeline's steps over an ingested run, one after the other or side by side.

Both ways share one loop over step states, woken by finished steps: whatever is ready is started, up
to the number of workers, which is one for serial pipelines. Tables that steps share are locked by
name. A step's snapshot is taken under these locks, so it is never of a table that another step is
just replacing.

The Spark jobs of a step carry tags of the run and of the step. When the run is cancelled, by the user
or by a failed step of a pipeline that wants it so, the jobs are cancelled by tag until all steps have
ended; these are pending again, and their tables are as they were, for a write that is cut off changes
nothing.
"""

from __future__ import annotations

import logging
import os
import threading
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from contextlib import ExitStack
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators.quarantine import QuarantineStore, StepQuarantine
from .accounts import JobAccounts
from .display import StepTracker
from .environment import load_environment, resolve_environment
from .model import ExecutionMode, Pipeline, Step, StepContext, TableHandle
from .state import DONE, Manifest, Runs, RunStatus, StepStatus
from .stats import Recorder, StatsStore

log = logging.getLogger("millrace.run")
#: Statuses from which a step can be started; a retry starts quarantined ones too.
STARTABLE = frozenset({StepStatus.PENDING, StepStatus.QUARANTINED, StepStatus.BLOCKED})
#: Seconds between looks at steps that are to end: a step may start another job after one was cancelled.
CANCEL_EVERY = 0.2


@dataclass(frozen=True)
class RunResult:
    run_id: str
    run_directory: Path
    steps_completed: int
    status: RunStatus


class Cancelled(RuntimeError):
    """The run was cancelled before all its steps had ended."""


class StepsBlocked(RuntimeError):
    """Steps that can never start, as what they depend on has not been completed."""


def by_cancelling(error: BaseException | None) -> bool:
    """Whether an error, or what it came from, is a Spark job's that was cancelled."""
    seen = set()
    while error is not None and id(error) not in seen:
        if "SPARK_JOB_CANCELLED" in str(error):
            return True
        seen.add(id(error))
        error = error.__cause__ or error.__context__
    return False


def optional_action(step: Step, pipeline: Pipeline, present: set[str]) -> tuple[str, str]:
    """("run" | "skip" | "fail", why) by the optional sources that are absent."""
    missing = sorted(s for s in step.sources if s not in present and pipeline.source(s).optional)
    there = sorted(set(step.sources) & present)
    if not missing:
        return "run", ""
    if there:
        return "fail", f"step {step.step_id} needs optional sources that are absent ({', '.join(missing)}) beside others that are there ({', '.join(there)})"
    return "skip", f"optional sources are absent: {', '.join(missing)}"


def worker_count(pipeline: Pipeline) -> int:
    if pipeline.step_execution_mode == ExecutionMode.SERIAL:
        return 1
    most = pipeline.max_parallel_workers
    if most is None:
        return min(32, (os.cpu_count() or 1) + 4)
    if most < 1:
        raise ValueError("at least one worker is needed")
    return most


@dataclass
class Run:
    """One invocation. Everything that steps share is changed under ``lock``."""

    spark: SparkSession
    pipeline_dir: Path
    pipeline: Pipeline
    directory: Path
    manifest: Manifest
    tracker: StepTracker
    on_change: Callable[[], None] | None = None
    literal_retry: bool = False
    lock: threading.RLock = field(default_factory=threading.RLock)
    completed: int = 0
    error: Exception | None = None
    stopped: str = ""
    cancelled: str = ""

    def __post_init__(self):
        self.runs, self.store = Runs(self.pipeline_dir), StatsStore.of(self.pipeline_dir)
        self.recorder = Recorder(self.store, self.manifest.run_id)
        self.quarantine = QuarantineStore(self.spark, self.directory)
        self.environment = resolve_environment(self.pipeline_dir)
        self.present = {f.name for f in self.manifest.ingested_files}
        self.handles: dict[str, TableHandle] = {}
        for step in self.pipeline.steps:
            for spec in step.tables:
                if spec.source in self.present:
                    path = next(Path(f.parquet_path) for f in self.manifest.ingested_files if f.name == spec.source)
                    self.handles.setdefault(spec.source, TableHandle(self.spark, spec, path, self.directory, path, self.pipeline.large_file_threshold_bytes, self.pipeline.run_batch_size))
                elif not self.pipeline.source(spec.source).optional:
                    raise ValueError(f"the run has no table of source {spec.source!r}")
        self.table_locks = {name: threading.Lock() for name in self.handles}

    def changed(self) -> None:
        if self.on_change:
            self.on_change()

    def persist(self, status: RunStatus | None = None) -> None:
        self.manifest.status = status or self.manifest.derived_status()
        self.runs.save(self.directory, self.manifest)
        self.store.record_run(self.manifest)

    def mark(self, step: Step, status: StepStatus, detail: str | None = None) -> None:
        with self.lock:
            self.manifest.set_step(step.step_id, status, detail)
            self.tracker.set(step.step_id, status, detail)
            self.persist(RunStatus.FAILED if status == StepStatus.FAILED else None)
            self.changed()

    def prepare(self) -> None:
        """Skips, from the start, steps whose sources are all absent."""
        if not self.manifest.step_states:
            for step in self.pipeline.steps:
                action, why = optional_action(step, self.pipeline, self.present)
                self.manifest.set_step(step.step_id, StepStatus.SKIPPED if action == "skip" else StepStatus.PENDING, why or None)
        for state in self.manifest.step_states:
            self.tracker.set(state.step_id, state.status, state.detail)
        self.completed = sum(s == StepStatus.COMPLETE for s in self.manifest.statuses().values())

    def tag(self, step: Step | None = None) -> str:
        """What the Spark jobs of the run, or of one of its steps, are tagged with."""
        return f"millrace-{self.manifest.run_id}" + (f"-{step.step_id.replace(',', ' ')}" if step else "")

    def cancel(self, why: str = "the run was cancelled") -> None:
        """Starts no more steps, and ends the Spark jobs of those that run; from any thread."""
        with self.lock:
            self.cancelled = self.cancelled or why
        self.spark.sparkContext.cancelJobsWithTag(self.tag())

    def execute(self, step: Step) -> None:
        before = self.manifest.statuses().get(step.step_id, StepStatus.PENDING)
        action, why = optional_action(step, self.pipeline, self.present)
        if action == "skip":
            return self.mark(step, StepStatus.SKIPPED, why)
        if action == "fail":
            return self.fail(step, ValueError(why))
        handles = [self.handles[s.source] for s in step.tables]
        stats, aside = self.recorder.for_step(step.step_id), StepQuarantine(self.quarantine, step.step_id)
        started, accounts = time.monotonic(), None
        try:
            with ExitStack() as held:
                for name in sorted(step.sources):
                    held.enter_context(self.table_locks[name])
                for handle in {h.name: h for h in handles}.values():
                    if before == StepStatus.QUARANTINED:
                        self.quarantine.merge(step.step_id, handle.name, handle.active, each_once=not self.literal_retry)
                    self.quarantine.keep_snapshot(step.step_id, handle.name, handle.active)
                with self.lock:
                    self.tracker.running(step.step_id, step.label)
                    self.changed()
                log.info("Running step %s", step.label)
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", step.step_id)  # a pool for each step, else FAIR lets them queue
                self.spark.sparkContext.setJobGroup(f"{self.manifest.run_id}/{step.step_id}", step.label)
                for tag in (self.tag(), self.tag(step)):
                    self.spark.sparkContext.addJobTag(tag)
                accounts = JobAccounts(self.spark, self.tag(step)) if self.pipeline.account_jobs else None
                started = time.monotonic()
                step.fn(StepContext(self.spark, self.pipeline_dir, self.directory, self.manifest.run_id, date.today(), step.step_id, logging.getLogger("millrace.run.steps"), self.progress, aside, stats, self.environment), handles)
        except Exception as error:
            stats.step("duration_ms", (time.monotonic() - started) * 1000)
            self.account(stats, accounts)
            with self.lock:
                why = self.cancelled
            if why and by_cancelling(error):
                log.info("Step %s was cancelled: %s", step.label, why)
                return self.mark(step, StepStatus.PENDING, f"cancelled: {why}")
            return self.fail(step, error)
        finally:
            self.spark.sparkContext.clearJobTags()
        stats.step("duration_ms", (time.monotonic() - started) * 1000)
        self.account(stats, accounts)
        if aside.any:
            stats.step("rows_quarantined", sum(self.quarantine.count(step.step_id, n) for n in step.sources))
            return self.mark(step, StepStatus.QUARANTINED, "Rows quarantined")
        with self.lock:
            self.completed += 1
        return self.mark(step, StepStatus.COMPLETE)

    def account(self, stats: Recorder, accounts: JobAccounts | None) -> None:
        """Records what the step's jobs have read and written. A step does not fail for want of its accounts."""
        if accounts:
            try:
                for action, value in accounts.sums().items():
                    stats.step(action, value)
            except Exception as error:
                log.warning("No accounts of the jobs tagged %s: %s", accounts.tag, error)

    def fail(self, step: Step, error: Exception) -> None:
        log.error("Step %s failed: %s", step.label, error, exc_info=error)
        with self.lock:
            self.error = self.error or error
        self.mark(step, StepStatus.FAILED, str(error))
        if self.pipeline.cancel_on_failure:
            self.cancel(f"step {step.step_id} has failed")

    def progress(self, percent: float | None) -> None:
        self.tracker.percent = percent
        self.changed()

    def blocked_by(self, step: Step) -> tuple[str, str]:
        """("", "") if the step can start; else the first dependency in its way, and its status."""
        statuses = self.manifest.statuses()
        return next(((d, statuses.get(d, StepStatus.PENDING)) for d in step.depends_on if statuses.get(d) not in DONE), ("", ""))

    def loop(self, workers: int) -> None:
        todo = [s for s in self.pipeline.steps if self.manifest.statuses().get(s.step_id, StepStatus.PENDING) in STARTABLE]
        running: dict[Future, Step] = {}
        with ThreadPoolExecutor(workers, thread_name_prefix="step") as pool:
            while todo or running:
                if not self.error and not self.stopped and not self.cancelled:
                    for step in list(todo):
                        with self.lock:
                            dependency, status = self.blocked_by(step)
                        pending = dependency and (any(s.step_id == dependency for s in todo) or any(s.step_id == dependency for s in running.values()))
                        if dependency and not pending:
                            self.stopped = f"step {step.step_id} is blocked by {dependency}, which is {status}"
                            self.mark(step, StepStatus.BLOCKED, self.stopped)
                            if status != StepStatus.QUARANTINED:
                                self.error = StepsBlocked(self.stopped)
                            todo.remove(step)
                            break
                        if dependency:
                            if workers == 1:
                                break  # in order of registration
                            continue
                        if len(running) >= workers:
                            break
                        todo.remove(step)
                        running[pool.submit(self.execute, step)] = step
                if not running:
                    break
                for future in self.waited(running):
                    running.pop(future)
                    future.result()

    def waited(self, running: dict[Future, Step]) -> set[Future]:
        """Steps that have ended; while the run is being cancelled, or from the moment the user interrupts it, with their jobs ended by tag."""
        while True:
            try:
                done = wait(running, CANCEL_EVERY, FIRST_COMPLETED).done
            except KeyboardInterrupt:
                self.cancel("interrupted")
                continue
            if done:
                return done
            if self.cancelled:
                self.spark.sparkContext.cancelJobsWithTag(self.tag())

    def go(self) -> RunResult:
        started = time.monotonic()
        load_environment(self.environment)
        self.prepare()
        workers = worker_count(self.pipeline)
        if workers > 1 and self.spark.sparkContext.getConf().get("spark.scheduler.mode", "FIFO") != "FAIR":
            log.info("spark.scheduler.mode is not FAIR: jobs of parallel steps queue up behind each other")
        self.loop(workers)
        status = RunStatus.FAILED if self.error or self.stopped or self.cancelled else self.manifest.derived_status()
        self.persist(status)
        self.recorder.run("steps_completed", self.completed)
        self.recorder.run("duration_ms", (time.monotonic() - started) * 1000)
        if aside := sum(s == StepStatus.QUARANTINED for s in self.manifest.statuses().values()):
            self.recorder.run("steps_quarantined", aside)
        self.tracker.message = {RunStatus.QUARANTINED: "Run quarantined", RunStatus.FAILED: self.stopped or self.cancelled or "Run failed"}.get(status, "Run completed")
        self.tracker.percent = None
        self.changed()
        log.info("Run %s finished with status %s", self.manifest.run_id, status)
        if self.error:
            raise self.error
        if self.cancelled:
            raise Cancelled(self.cancelled)
        return RunResult(self.manifest.run_id, self.directory, self.completed, status)


def run_steps(spark: SparkSession, pipeline_dir: Path, pipeline: Pipeline, directory: Path, manifest: Manifest, tracker: StepTracker | None = None, on_change: Callable[[], None] | None = None, literal_retry: bool = False) -> RunResult:
    """Runs what is left to run. A step's error is raised after the others have finished or, with ``cancel_on_failure``, been cancelled; blocked steps end the run as failed.

    literal_retry: a retried step starts from its snapshot and all quarantined rows, though the snapshot holds them too.
    """
    if not manifest.runnable():
        raise ValueError(f"run {manifest.run_id} cannot be processed (status {manifest.status})")
    return Run(spark, Path(pipeline_dir), pipeline, Path(directory), manifest, tracker or StepTracker(pipeline), on_change, literal_retry).go()
