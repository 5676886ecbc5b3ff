"""Finding a pipeline: a directory's pipeline.py and the instance that it exports."""

from __future__ import annotations

import hashlib
import importlib.util
import sys
from pathlib import Path

from .model import Pipeline

FILE = "pipeline.py"


def find_pipeline(directory: Path) -> Path | None:
    path = Path(directory) / FILE
    return path if path.is_file() else None


def load_pipeline(directory: Path) -> Pipeline | None:
    """The exported instance, None without one. The module has a name of its own, so two pipelines do not meet.

    The directory is importable while its pipeline is loaded; a module that fails is not kept, and what
    an earlier load has left under its name stays.
    """
    path = find_pipeline(directory)
    if path is None:
        return None
    path = path.resolve()
    name = f"_millrace_pipeline_{hashlib.sha256(str(path).encode()).hexdigest()[:16]}"
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    before, earlier = list(sys.path), sys.modules.get(name)
    sys.modules[name] = module
    sys.path.insert(0, str(path.parent))
    try:
        spec.loader.exec_module(module)
    except BaseException:
        if earlier is None:
            sys.modules.pop(name, None)
        else:
            sys.modules[name] = earlier
        raise
    finally:
        sys.path[:] = before
    found = getattr(module, "pipeline", None)
    return found if isinstance(found, Pipeline) else None
