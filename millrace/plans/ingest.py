"""Ingest: a directory of source files becomes a run's tables, or nothing at all."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession

from ..sources import csv
from ..sources.match import match_sources
from .model import Pipeline
from .state import INGESTED, FileRecord, Runs, RunStatus
from .stats import Recorder, StatsStore

log = logging.getLogger("millrace.ingest")


@dataclass(frozen=True)
class IngestResult:
    run_id: str
    run_directory: Path
    files: list[str]


def ingest(spark: SparkSession, pipeline_dir: Path, pipeline: Pipeline, source_directory: Path, on_created: Callable[[Path, str], None] | None = None, on_progress: Callable[[str, int, int | None], None] | None = None) -> IngestResult:
    """Matches, reads, validates and publishes every source. If one fails, the run's directory and its rows go.

    on_progress(file, rows done, rows estimated) is called before and after each file.
    """
    source_directory = Path(source_directory).resolve()
    runs, store = Runs(pipeline_dir), StatsStore.of(pipeline_dir)
    runs.check_free(pipeline.execution_mode)
    directory, manifest = runs.create(pipeline.name, pipeline.execution_mode, source_directory)
    if on_created:
        on_created(directory, manifest.run_id)
    try:
        for match in match_sources(source_directory, pipeline.sources):
            spec = match.spec
            expected = None if spec.preprocess else csv.estimate_rows(match.path, spec.has_header)
            log.info("Materializing %s (about %s rows)", spec.name, expected)
            if on_progress:
                on_progress(spec.name, 0, expected)
            target = directory / INGESTED / f"{spec.name}.parquet"
            rows, columns = csv.materialize(spark, match.path, target, spec.schema, pipeline.row_ids, encoding=spec.encoding, has_header=spec.has_header, column_names=spec.column_names, preprocess=spec.preprocess, multi_line=spec.multi_line)
            if on_progress:
                on_progress(spec.name, rows, rows)
            manifest.ingested_files.append(FileRecord(name=spec.name, source_path=str(match.path.resolve()), parquet_path=str(target.resolve()), row_count=rows, column_count=columns, size_bytes=match.path.stat().st_size))
            log.info("Ingested %s (%s rows)", spec.name, rows)
    except Exception as error:
        log.error("Ingest failed: %s", error)
        runs.discard(directory)
        store.delete_run(manifest.run_id)
        raise
    manifest.status, manifest.ingested_at = RunStatus.INGESTED, datetime.now(UTC)
    runs.save(directory, manifest)
    store.record_run(manifest)  # first, as the other rows refer to it
    recorder = Recorder(store, manifest.run_id)
    recorder.run("files_ingested", len(manifest.ingested_files))
    recorder.run("rows_ingested", sum(f.row_count for f in manifest.ingested_files))
    for f in manifest.ingested_files:
        recorder.file(f.name, "rows_ingested", f.row_count)
    store.record_files(manifest.run_id, manifest.ingested_files)
    return IngestResult(manifest.run_id, directory, [f.name for f in manifest.ingested_files])
