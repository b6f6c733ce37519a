"""Records the calls of a Python program within one source tree, for comparison with inferred edges. Runs outside Spark."""

from __future__ import annotations

import contextlib
import json
import os
import subprocess
import sys
import tempfile
import threading
from types import FrameType

from .functions.paths import EXCLUDED

#: Calls written at a time.
BATCH = 200


def module_of(file: str, root: str) -> str | None:
    """Dotted module of a file below root; a package is named without __init__. None outside or below a left-out folder."""
    if not file.startswith(root + os.sep) or not file.endswith(".py"):
        return None
    parts = file[len(root) + 1 : -3].split(os.sep)
    if any(p in EXCLUDED for p in parts):
        return None
    if parts[-1] == "__init__":
        parts.pop()
    return ".".join(parts) or None


def scope_of(qualname: str) -> str:
    """A qualname up to its first part with a ``<``."""
    out = []
    for p in qualname.split("."):
        if "<" in p:
            break
        out.append(p)
    return ".".join(out)


class Recorder:
    """A profile hook that keeps each pair of caller and callee within the tree once and appends them to a file of its process."""

    def __init__(self, root: str, folder: str):
        self.root, self.folder = os.path.realpath(root), folder
        self.pid, self.seen, self.pending, self.recorded = os.getpid(), set(), [], 0
        self.modules: dict[str, str | None] = {}
        self.error = ""

    def _module(self, file: str) -> str | None:
        if file not in self.modules:
            self.modules[file] = module_of(os.path.realpath(file), self.root)
        return self.modules[file]

    def hook(self, frame: FrameType, event: str, arg: object) -> None:
        if event != "call" or frame.f_back is None or self.error:
            return
        here, there = frame.f_code, frame.f_back.f_code
        a, b = self._module(there.co_filename), self._module(here.co_filename)
        if not (a and b):
            return
        caller = scope_of(there.co_qualname)
        pair = (a, caller, b, here.co_qualname)
        if caller and pair not in self.seen:
            self.seen.add(pair)
            self.pending.append(pair)
            if len(self.pending) >= BATCH:
                self.flush()

    def flush(self) -> None:
        if os.getpid() != self.pid:  # a forked child writes its own file
            self.pid, self.pending, self.recorded = os.getpid(), self.pending[-1:], 0
        try:
            with open(f"{self.folder}/calls-{self.pid}.jsonl", "a", encoding="utf-8") as f:
                f.writelines(json.dumps(p) + "\n" for p in self.pending)
            self.recorded += len(self.pending)
        except OSError as e:  # a trace that goes on would be a smaller one that still looks like a result
            self.error = f"the trace could not be written: {e}"
            sys.setprofile(None)
            threading.setprofile(None)
        self.pending = []
        self.status(False)

    def status(self, finished: bool) -> None:
        with contextlib.suppress(OSError), open(f"{self.folder}/calls-{self.pid}.status.json", "w", encoding="utf-8") as f:
            json.dump({"pid": self.pid, "recorded": self.recorded, "error": self.error or None, "finished": finished and not self.error}, f)

    def start(self) -> None:
        sys.setprofile(self.hook)
        threading.setprofile(self.hook)

    def stop(self) -> None:
        sys.setprofile(None)
        threading.setprofile(None)
        if not self.error:
            self.flush()
        self.status(True)


_SITE = """import atexit, sys
sys.path.insert(0, {home!r})
from weftgraph.tracing import Recorder
_r = Recorder({root!r}, {folder!r})
atexit.register(_r.stop)
_r.start()
"""


def run_traced(command: list[str], root: str, folder: str, timeout: float = 1800) -> str | None:
    """Runs a command, a test suite say, with every Python process of it recorded into ``folder``; why it failed, or None."""
    os.makedirs(folder, exist_ok=True)
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as site:
        with open(f"{site}/sitecustomize.py", "w", encoding="utf-8") as f:
            f.write(_SITE.format(home=home, root=os.path.realpath(root), folder=os.path.realpath(folder)))
        env = os.environ | {"PYTHONPATH": os.pathsep.join([site, os.path.realpath(root), os.environ.get("PYTHONPATH", "")])}
        try:
            done = subprocess.run(command, cwd=root, env=env, capture_output=True, text=True, timeout=timeout)
        except subprocess.TimeoutExpired:
            return f"it took more than {timeout:g} s"
    return None if done.returncode == 0 else f"it ended with {done.returncode}: {(done.stderr or done.stdout).strip()[-500:]}"
