"""Plain-text views: a pipeline's flow, the progress of its steps, the list of runs."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence
from pathlib import Path

from .model import Pipeline, Step, StepKind
from .state import StepStatus
from .stats import StatsStore

#: The marks of step states.
MARKS = {"pending": "○", "running": "▶", "complete": "✓", "quarantined": "!", "failed": "✗", "blocked": "■", "skipped": "–"}


class StepTracker:
    """What a view shows of a run: each step's state, the running step and how far it is."""

    def __init__(self, pipeline: Pipeline):
        self.labels = {s.step_id: s.label for s in pipeline.steps}
        self.status = {s.step_id: str(StepStatus.PENDING) for s in pipeline.steps}
        self.detail: dict[str, str] = {}
        self.message, self.percent = "", None

    def set(self, step_id: str, status: StepStatus, detail: str | None = None) -> None:
        self.status[step_id] = str(status)
        self.detail.pop(step_id, None)
        if detail:
            self.detail[step_id] = detail

    def running(self, step_id: str, label: str) -> None:
        self.status[step_id], self.message, self.percent = "running", label, None

    def lines(self) -> list[str]:
        return [f"{MARKS[self.status[i]]} {label}" + (f" ({self.detail[i]})" if i in self.detail else "") for i, label in self.labels.items()]


def boxed(title: str, lines: Sequence[str], width: int) -> list[str]:
    inside = width - 4
    cut = [x if len(x) <= inside else x[: inside - 1] + "…" for x in lines]
    return [f"┌─ {title} {'─' * max(0, width - 5 - len(title))}┐", *(f"│ {x:<{inside}} │" for x in cut), f"└{'─' * (width - 2)}┘"]


class Dashboard:
    """Three panels: steps, log, status."""

    def __init__(self, tracker: StepTracker, records: deque, width: int = 100, log_lines: int = 12):
        self.tracker, self.records, self.width, self.log_lines = tracker, records, width, log_lines

    def status_lines(self) -> list[str]:
        percent = self.tracker.percent
        bar = [] if percent is None else [f"[{'#' * int(percent / 5):<20}] {percent:.0f}%"]
        return [self.tracker.message or "Waiting", *bar]

    def log_panel(self) -> list[str]:
        last = list(self.records)[-self.log_lines :]
        return [f"{r.levelname:<7} {getattr(r, 'shown', None) or r.getMessage()}" for r in last]

    def render(self) -> str:
        panels = (("Steps", self.tracker.lines()), ("Log", self.log_panel()), ("Status", self.status_lines()))
        return "\n".join(line for title, lines in panels for line in boxed(title, lines, self.width))


def layers(steps: Iterable[Step]) -> list[list[Step]]:
    """Steps by the length of the longest way to them."""
    depth: dict[str, int] = {}
    out: list[list[Step]] = []
    for step in steps:
        depth[step.step_id] = 1 + max((depth[d] for d in step.depends_on), default=-1)
        while len(out) <= depth[step.step_id]:
            out.append([])
        out[depth[step.step_id]].append(step)
    return out


def box(lines: Sequence[str]) -> list[str]:
    width = max(map(len, lines))
    return [f"┌{'─' * (width + 2)}┐", *(f"│ {x:^{width}} │" for x in lines), f"└{'─' * (width + 2)}┘"]


def step_box(step: Step) -> list[str]:
    kind = "filter" if step.kind == StepKind.FILTER else "step"
    return box([step.label, f"[{kind}] {step.step_id}", ", ".join(step.sources)])


def connectors(above: dict[str, int], below: dict[str, int], edges: Sequence[tuple[str, str]]) -> list[str]:
    """Lines from boxes to those under them, by the middles of both; one line across for each box below."""
    left = {a: sum(x == a for x, _ in edges) for a in above}
    out, reached = [], []
    for name, middle in below.items():
        own = [a for a, b in edges if b == name]
        if not own:
            continue
        line = dict.fromkeys([above[a] for a in above if left[a]] + reached, "│")
        ends = sorted([middle, *(above[a] for a in own)])
        line |= {x: "┼" if line.get(x) == "│" and x not in ends else "─" for x in range(ends[0], ends[-1] + 1) if len(set(ends)) > 1}
        for a in own:
            left[a] -= 1
            line[above[a]] = ("│" if len(set(ends)) == 1 else "┼") if left[a] or above[a] == middle else "┴"
        if middle not in {above[a] for a in own}:
            line[middle] = "┬"
        reached.append(middle)
        out.append("".join(line.get(x, " ") for x in range(max(line) + 1)))
    return [*out, "".join("▼" if x in reached else " " for x in range(max(reached) + 1))] if reached else []


def flow_diagram(pipeline: Pipeline) -> str:
    """Ingest and the steps, in layers from first to last, boxes connected; edges that skip a layer are named only."""
    head = [pipeline.name, f"steps run {'in parallel' if pipeline.step_execution_mode == 'parallel' else 'one after the other'}", ""]
    ingest = box(["Ingest", ", ".join(s.name for s in pipeline.sources)])
    rows = layers(pipeline.steps)
    chain = all(len(r) == 1 for r in rows) and all(s.depends_on == ((pipeline.steps[i - 1].step_id,) if i else ()) for i, s in enumerate(pipeline.steps))
    if chain or len(pipeline.steps) == 1:
        boxes = [ingest, *map(step_box, pipeline.steps)]
        width = max(len(b[0]) for b in boxes)
        body = []
        for i, lines in enumerate(boxes):
            body += [x.center(width).rstrip() for x in ((["│", "▼"] if i else []) + lines)]
        return "\n".join(head + body)
    body, above = list(ingest), {"": len(ingest[0]) // 2}
    for i, row in enumerate(rows):
        boxes, below, at = [step_box(s) for s in row], {}, 0
        for step, lines in zip(row, boxes, strict=True):
            below[step.step_id] = at + len(lines[0]) // 2
            at += len(lines[0]) + 2
        if i:
            body += ["", *(f"  {d} ──▶ {s.step_id}" for s in row for d in s.depends_on), ""]
        body += connectors(above, below, [(d, s.step_id) for s in row for d in (s.depends_on if i else ("",)) if d in above])
        body += ["  ".join(parts).rstrip() for parts in zip(*boxes, strict=True)]
        above = below
    return "\n".join(head + body)


def text_table(title: str, columns: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    widths = [max(len(str(x)) for x in column) for column in zip(columns, *rows, strict=True)]
    line = lambda values: "  ".join(f"{v!s:<{w}}" for v, w in zip(values, widths, strict=True)).rstrip()
    return "\n".join([title, line(columns), line(["─" * w for w in widths]), *map(line, rows)])


def run_table(pipeline_dir: Path) -> str:
    columns = {"run_id": "Run", "pipeline_name": "Pipeline", "status": "Status", "source_directory": "Sources", "created_at": "Created", "ingested_at": "Ingested"}
    rows = [[r[c] or "-" for c in columns] for r in StatsStore.of(pipeline_dir).runs()]
    return text_table("Pipeline runs", list(columns.values()), rows or [["-", "-", "no runs recorded", "-", "-", "-"]])
