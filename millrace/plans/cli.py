"""The commands: ingest, run, describe, list, cleanup."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from .cleanup import clean_up, plan_cleanup
from .discovery import find_pipeline, load_pipeline
from .display import Dashboard, StepTracker, flow_diagram, run_table
from .engine import run_steps
from .ingest import ingest
from .logs import logging_session, run_log
from .model import Pipeline
from .state import Runs

log = logging.getLogger("millrace.cli")


class CommandError(RuntimeError):
    """What a command tells its user before it ends with code 1."""


def session() -> SparkSession:
    return SparkSession.builder.appName("millrace").config("spark.scheduler.mode", "FAIR").getOrCreate()


def required_pipeline(directory: Path) -> Pipeline:
    if find_pipeline(directory) is None:
        raise CommandError(f"there is no pipeline.py in {directory}")
    pipeline = load_pipeline(directory)
    if pipeline is None:
        raise CommandError("pipeline.py exports no Pipeline named 'pipeline'")
    return pipeline


def do_ingest(args, logs) -> None:
    source = Path(args.path)
    if not source.exists():
        raise CommandError(f"there is no {source}")
    if not source.is_dir():
        raise CommandError(f"not a directory: {source}")
    pipeline = required_pipeline(args.pipeline_dir)
    result = ingest(session(), args.pipeline_dir, pipeline, source, on_created=lambda directory, run_id: logs.attach(run_log(directory), "ingest", run_id))
    log.info("Run %s created at %s with %s file(s)", result.run_id, result.run_directory, len(result.files))


def do_run(args, logs) -> None:
    directory, manifest = Runs(args.pipeline_dir).resolve(args.run_id)
    pipeline = required_pipeline(args.pipeline_dir)
    logs.attach(run_log(directory), "run", manifest.run_id)
    tracker = StepTracker(pipeline)
    dashboard = Dashboard(tracker, logs.buffer.records)
    live = sys.stdout.isatty()

    def show() -> None:
        if live:
            print(f"\x1b[2J\x1b[H{dashboard.render()}", flush=True)

    try:
        run_steps(session(), args.pipeline_dir, pipeline, directory, manifest, tracker, show if args.mode == "dashboard" else None)
    finally:
        if args.mode == "dashboard":
            print(dashboard.render())


def do_describe(args, logs) -> None:
    print(flow_diagram(required_pipeline(args.pipeline_dir)))


def do_list(args, logs) -> None:
    print(run_table(args.pipeline_dir))


def do_cleanup(args, logs) -> None:
    plan = plan_cleanup(args.pipeline_dir, args.all)
    if not plan.paths:
        return log.info("Nothing to clean up.")
    print("\n".join(clean_up(args.pipeline_dir, plan, dry_run=True)))
    if args.dry_run:
        return None
    if not args.yes and input("Proceed? [y/N] ").strip().lower() not in ("y", "yes"):
        return log.info("Nothing was removed.")
    for line in clean_up(args.pipeline_dir, plan):
        log.info(line)
    return None


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="millrace", description="Import pipelines on Spark.")
    out.add_argument("--debug", action="store_true", help="log more, and show tracebacks")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, do, text: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(name, help=text)
        sub.set_defaults(do=do)
        sub.add_argument("-C", "--pipeline-dir", type=Path, default=Path.cwd(), help="the directory of pipeline.py")
        return sub

    command("ingest", do_ingest, "ingest a directory of source files").add_argument("path")
    run = command("run", do_run, "run the steps over an ingested run")
    run.add_argument("--run-id", help="the latest run that can be processed, by default")
    run.add_argument("--mode", choices=("dashboard", "cli"), default="dashboard")
    command("describe", do_describe, "show the steps as a diagram")
    command("list", do_list, "list the runs")
    cleanup = command("cleanup", do_cleanup, "remove runs that are over")
    cleanup.add_argument("--all", action="store_true", help="all runs, statistics and resolver stores")
    cleanup.add_argument("--dry-run", action="store_true")
    cleanup.add_argument("-y", "--yes", action="store_true", help="do not ask")
    return out


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    quiet = args.command == "run" and args.mode == "dashboard"
    with logging_session(console=not quiet, level=logging.DEBUG if args.debug else logging.INFO) as logs:
        try:
            args.do(args, logs)
        except Exception as error:
            text = f"{args.command} failed: {error}"
            log.error(text, exc_info=error if args.debug else None)
            if quiet:
                print(text, file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
