"""Logging of commands: to the console, to a run's file, to a buffer that a view shows."""

from __future__ import annotations

import logging
import sys
from collections import deque
from contextlib import contextmanager
from datetime import datetime
from pathlib import Path

ROOT, FILE, KEPT = "millrace", "log", 500
FORMAT = "%(asctime)s %(levelname)s %(name)s %(message)s"


class Buffer(logging.Handler):
    """Keeps the last records."""

    def __init__(self, kept: int = KEPT):
        super().__init__()
        self.records: deque[logging.LogRecord] = deque(maxlen=kept)

    def emit(self, record: logging.LogRecord) -> None:
        self.records.append(record)


class Shown(logging.Formatter):
    """A record as a reader sees it: statistics in words."""

    def format(self, record: logging.LogRecord) -> str:
        return getattr(record, "shown", None) or super().format(record)


class Session:
    def __init__(self, logger: logging.Logger):
        self.logger, self.handlers, self.buffer = logger, [], Buffer()

    def add(self, handler: logging.Handler, formatter: logging.Formatter) -> None:
        handler.setFormatter(formatter)
        self.logger.addHandler(handler)
        self.handlers.append(handler)

    def attach(self, path: Path, command: str, run_id: str) -> None:
        """From now on records also go to a run's file, below a line that says which command it is."""
        path = Path(path)
        again = path.exists() and path.stat().st_size > 0
        path.parent.mkdir(parents=True, exist_ok=True)
        with path.open("a", encoding="utf-8") as f:
            f.write(f"{chr(10) if again else ''}===== {command} run={run_id} at {datetime.now().isoformat(timespec='seconds')} =====\n")
        self.add(logging.FileHandler(path, encoding="utf-8"), logging.Formatter(FORMAT))


@contextmanager
def logging_session(console: bool = True, level: int = logging.INFO):
    """Handlers are taken off, and the level is set back, when the session ends."""
    logger = logging.getLogger(ROOT)
    before, session = logger.level, Session(logger)
    logger.setLevel(level)
    session.add(session.buffer, Shown("%(message)s"))
    if console:
        session.add(logging.StreamHandler(sys.stderr), Shown("%(levelname)s %(message)s"))
    try:
        yield session
    finally:
        for handler in session.handlers:
            logger.removeHandler(handler)
            handler.close()
        logger.setLevel(before)


def run_log(run_directory: Path) -> Path:
    return Path(run_directory) / FILE
