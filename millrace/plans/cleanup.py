"""Removing runs that are over, or everything."""

from __future__ import annotations

import shutil
from dataclasses import dataclass
from pathlib import Path

from ..operators.resolver import FOLDER as STORES
from .state import Runs, RunStatus
from .stats import StatsStore

OVER = frozenset({RunStatus.COMPLETED, RunStatus.FAILED})


@dataclass(frozen=True)
class Cleanup:
    paths: tuple[tuple[Path, str], ...]
    run_ids: tuple[str, ...]
    everything: bool


def plan_cleanup(pipeline_dir: Path, everything: bool = False) -> Cleanup:
    """Completed and failed runs; with everything all runs, the statistics and the resolvers' stores."""
    base, paths, ids = Path(pipeline_dir).resolve(), [], []
    runs = Runs(base)
    for directory in runs.directories():
        manifest = runs.manifest(directory)
        if everything or (manifest is not None and manifest.status in OVER):
            paths.append((directory, f"run {directory.name} ({manifest.status if manifest else 'no manifest'})"))
            ids.append(directory.name)
    if everything:
        extra = ((StatsStore.of(base).path, "statistics database"), (base / STORES, "resolver stores"))
        paths += [(p, what) for p, what in extra if p.exists()]
    return Cleanup(tuple(paths), tuple(ids), everything)


def clean_up(pipeline_dir: Path, plan: Cleanup, dry_run: bool = False) -> list[str]:
    """Lines that say what goes, or with dry_run would go."""
    lines = [f"{'would remove' if dry_run else 'removed'} {what}: {path}" for path, what in plan.paths]
    if dry_run:
        return lines
    for path, _ in plan.paths:
        if path.is_dir():
            shutil.rmtree(path)
        else:
            for suffix in ("", "-wal", "-shm"):
                Path(f"{path}{suffix}").unlink(missing_ok=True)
    store = StatsStore.of(pipeline_dir)
    if store.path.is_file():
        for run_id in plan.run_ids:
            store.delete_run(run_id)
    return lines
