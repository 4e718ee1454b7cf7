"""Around a run: signals, notices, seeds, logs, and exports."""

from __future__ import annotations

import json
import logging
import random
import signal
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np


class StopFlag:
    """Set by the first of the signals; a second one interrupts."""

    def __init__(self, signals=(signal.SIGINT, signal.SIGTERM)):
        self.signals, self.raised, self.before = signals, False, {}

    def _set(self, number, frame) -> None:
        if self.raised:
            raise KeyboardInterrupt
        self.raised = True

    def __call__(self) -> bool:
        return self.raised

    def __enter__(self) -> StopFlag:
        self.before = {s: signal.signal(s, self._set) for s in self.signals}
        return self

    def __exit__(self, *_) -> None:
        for s, handler in self.before.items():
            signal.signal(s, handler)


class Notifier:
    """Takes events of a run; this one ignores them."""

    def send(self, event: str, **details) -> None:
        pass


class LogNotifier(Notifier):
    def send(self, event: str, **details) -> None:
        logging.getLogger("tidewheel").info("%s %s", event, json.dumps(details, default=str, sort_keys=True))


class FileNotifier(Notifier):
    """One JSON line for each event."""

    def __init__(self, path: str):
        self.path = Path(path)

    def send(self, event: str, **details) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps({"event": event, **details}, default=str) + "\n")


class CallNotifier(Notifier):
    def __init__(self, call: Callable[[str, dict], None]):
        self.call = call

    def send(self, event: str, **details) -> None:
        self.call(event, details)


def seed_all(seed: int) -> np.random.Generator:
    """Seed the generators of Python and numpy; returns one of numpy's own."""
    random.seed(seed)
    np.random.seed(seed)
    return np.random.default_rng(seed)


def logging_to(folder: str | None = None, level: int = logging.INFO, name: str = "tidewheel") -> logging.Logger:
    """Log to the console and, if a folder is given, to <folder>/<name>.log; handlers are set up once."""
    log = logging.getLogger(name)
    log.setLevel(level)
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(folder, f"{name}.log"), encoding="utf-8"))
    have = {(type(h), getattr(h, "baseFilename", None)) for h in log.handlers}
    for h in handlers:
        if (type(h), getattr(h, "baseFilename", None)) not in have:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
            log.addHandler(h)
    return log


def zipped(folder: str, target: str) -> int:
    """All files of a folder in an archive; returns their number."""
    root, out = Path(folder), Path(target).resolve()
    files = sorted(p for p in root.rglob("*") if p.is_file() and p.resolve() != out)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, p.relative_to(root))
    return len(files)


def shrinking(call: Callable[[int], object], size: int, least: int = 1, errors: tuple[type[BaseException], ...] = (MemoryError,)):
    """call(size), with half the size after each lack of memory; below `least` the last error is raised."""
    while True:
        try:
            return call(size)
        except errors:
            if size // 2 < least:
                raise
            logging.getLogger("tidewheel").warning("out of memory at size %d", size)
            size //= 2


def discovered(root: str) -> dict[str, str | None]:
    """Where under root the feature files, the mapping and the settings are: the first folder or file of each kind by path."""
    found: dict[str, str | None] = {"features": None, "mapping": None, "config": None}
    for path in sorted(Path(root).rglob("*")):
        kind, at = None, path
        if path.name.endswith("_features.csv"):
            kind, at = "features", path.parent
        elif path.name == "coin_mapping.csv":
            kind = "mapping"
        elif path.suffix in (".yaml", ".yml"):
            kind = "config"
        if kind and found[kind] is None:
            found[kind] = str(at)
    return found
