"""Which file of a source directory is which declared source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase
from pathlib import Path


class SourceMatchError(ValueError):
    """A source directory that does not hold the declared files, and only those."""


@dataclass(frozen=True)
class SourceMatch:
    spec: object
    path: Path


def match_sources(directory: Path, specs: Sequence) -> list[SourceMatch]:
    """One file for each spec, in the order of declaration; a file that one spec has claimed is not seen by later ones.

    Only optional specs may find none, at least one spec must find its file, and no file may be left over.
    """
    directory = Path(directory)
    if not directory.is_dir():
        raise SourceMatchError(f"not a directory: {directory}")
    entries = sorted(directory.iterdir())
    if folders := [p.name for p in entries if p.is_dir()]:
        raise SourceMatchError(f"a source directory holds files only, not {', '.join(folders)}")
    free, found = entries, []
    for spec in specs:
        hits = [p for p in free if fnmatchcase(p.name, spec.pattern)]
        if len(hits) > 1:
            raise SourceMatchError(f"{spec.name}: several files match {spec.pattern}: {', '.join(p.name for p in hits)}")
        if not hits and not spec.optional:
            raise SourceMatchError(f"{spec.name}: no file matches {spec.pattern}")
        if hits:
            found.append(SourceMatch(spec, hits[0]))
            free = [p for p in free if p != hits[0]]
    if not found:
        raise SourceMatchError("no declared source is present")
    if free:
        raise SourceMatchError(f"files that no source declares: {', '.join(p.name for p in free)}")
    return found
