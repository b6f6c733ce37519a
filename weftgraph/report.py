"""An accuracy run from end to end, and its report. A run that failed has a reason and no figure."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .indexing import index_folder
from .operators import accuracy
from .operators.export import bounded_table
from .runtime import local_path, shared_dir, stage
from .sources.traces import health, read_calls
from .tracing import run_traced


@dataclass
class Run:
    failure: str | None = None
    summary: dict | None = None
    matched: DataFrame | None = None
    unmatched: DataFrame | None = None
    unobserved: DataFrame | None = None
    misses: DataFrame | None = None

    @property
    def precision(self) -> float | None:
        s = self.summary
        return None if self.failure or not s or not s["n_observed"] else s["n_matched"] / s["n_observed"]


def checkout(repository: str, commit: str | None, workdir: str) -> str:
    """A clone of an address or path at a commit; RuntimeError tells which step failed."""
    place = os.path.join(workdir, "repos", repository.rstrip("/").rsplit("/", 1)[-1].removesuffix(".git"))
    if not os.path.isdir(f"{place}/.git"):
        os.makedirs(os.path.dirname(place), exist_ok=True)
        _step(f"could not clone {repository}", ["git", "clone", "--quiet", repository, place], workdir)
    if commit:
        _step(f"could not check out {commit}", ["git", "checkout", "--quiet", "--detach", commit], place)
    return place


def environment(place: str, requirements: list[str], workdir: str) -> str:
    """The interpreter of a virtual environment beside, not within, the checkout, with the requirements."""
    python = os.path.join(workdir, "venv", "bin", "python")
    if not os.path.exists(python):
        _step("could not build a virtual environment", [sys.executable, "-m", "venv", os.path.join(workdir, "venv")], workdir)
    if requirements:
        _step("could not install the requirements", [python, "-m", "pip", "install", "-q", *requirements], place)
    return python


def _step(why: str, command: list[str], cwd: str) -> None:
    try:
        done = subprocess.run(command, cwd=cwd, capture_output=True, text=True)
    except OSError as e:
        raise RuntimeError(f"{why}: {e}") from None
    if done.returncode:
        raise RuntimeError(f"{why}: {(done.stderr or done.stdout).strip()[-500:]}")


def measure_repository(
    spark: SparkSession, repository: str, command: list[str], workdir: str, commit: str | None = None, requirements: list[str] | None = None, python: str | None = None, install: bool = True
) -> Run:
    """A whole run: clone at the commit, environment, traced command (its arguments go to the interpreter), comparison. Each
    step that fails is the reason of a run without figures. workdir must be a folder that executors share."""
    try:
        place = checkout(repository, commit, workdir)
        if python is None:
            if not install:
                raise RuntimeError("no interpreter given and installation turned off")
            python = environment(place, requirements or [], workdir)
    except RuntimeError as e:
        return Run(failure=str(e))
    return measure(spark, place, [python, *command])


def measure(spark: SparkSession, root: str, command: list[str]) -> Run:
    """Traces the command in ``root``, indexes ``root`` and compares. Traces go to the shared folder, where executors read
    them."""
    with tempfile.TemporaryDirectory(dir=local_path(shared_dir(spark)), prefix="trace-") as folder:
        why = run_traced(command, root, folder) or health(folder)
        if why:
            return Run(failure=why)
        calls = stage(read_calls(spark, folder), "observed")
    if calls.isEmpty():
        return Run(failure="no calls were observed")
    end = lambda e: F.struct(F.col(f"{e}_module").alias("module"), F.col(f"{e}_qualname").alias("qualname")).alias(e)
    pairs = calls.select(end("caller"), end("callee"))
    split = stage(accuracy.split_calls(index_folder(spark, root).graph), "calls")
    return Run(
        summary=accuracy.summary(split, pairs).first().asDict(),
        matched=accuracy.matched(split, pairs),
        unmatched=accuracy.unmatched(split, pairs),
        unobserved=accuracy.unobserved(split, pairs),
        misses=accuracy.miss_classes(split, pairs),
    )


def markdown(run: Run, title: str) -> str:
    """The report of a run; tables show their first 25 rows."""
    if run.failure:
        return f"# {title}\n\nThe run failed, so there is no figure: {run.failure}\n"
    s = run.summary
    name = lambda e: F.concat_ws(":", f"{e}.module", f"{e}.qualname").alias(e)
    pairs = lambda df: df.select(name("caller"), name("callee")).orderBy("caller", "callee")
    return "\n".join(
        [
            f"# {title}\n",
            f"{s['n_matched']} of {s['n_observed']} observed calls are inferred: {100 * run.precision:.2f} %.\n",
            f"{s['n_inferred']} calls are inferred, {s['n_judgeable']} of them can be judged, {s['n_unresolved']} are unresolved.\n",
            "## Misses by class\n",
            bounded_table(run.misses.orderBy("class"), ["class", "n"]),
            "## Observed, not inferred\n",
            bounded_table(pairs(run.unmatched), ["caller", "callee"]),
            "## Inferred, not observed\n",
            bounded_table(pairs(run.unobserved), ["caller", "callee"]),
        ]
    )
