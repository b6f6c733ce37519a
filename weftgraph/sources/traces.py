"""Recorded calls, their health, and hand labels."""

from __future__ import annotations

import glob
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CALL = "caller_module string, caller_qualname string, callee_module string, callee_qualname string"


def read_calls(spark: SparkSession, folder: str) -> DataFrame:
    """(caller_module, caller_qualname, callee_module, callee_qualname): distinct calls of all calls-*.jsonl of a folder."""
    if not glob.glob(f"{folder}/calls-*.jsonl"):
        return spark.createDataFrame([], _CALL)
    lines = spark.read.text(f"{folder}/calls-*.jsonl").filter(F.length(F.trim("value")) > 0)
    a = lines.select(F.from_json("value", "array<string>").alias("a")).filter(F.size("a") == 4)
    names = [c.split()[0] for c in _CALL.split(", ")]
    return a.select(*[F.col("a")[i].alias(n) for i, n in enumerate(names)]).distinct().orderBy(*names)


def health(folder: str) -> str | None:
    """Why the traces of a folder must not be used: a writer with an error, or one that recorded and did not finish. None
    if they may."""
    for path in sorted(glob.glob(f"{folder}/*.status.json")):
        with open(path, encoding="utf-8") as f:
            s = json.load(f)
        if s.get("error"):
            return f"{os.path.basename(path)}: {s['error']}"
        if not s.get("finished") and s.get("recorded", 0) > 0:
            return f"{os.path.basename(path)}: it did not finish"
    return None


def parse_labels(text: str, name: str) -> list[tuple[str, str, str, int]]:
    """(caller_file, caller_qualname, callee, seq) of lines ``file:qualname -> callee``; blank lines and # comments aside."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        left, arrow, callee = line.partition("->")
        file, colon, qualname = left.strip().rpartition(":")
        if not (arrow and colon and file.strip() and qualname.strip() and callee.strip()):
            raise ValueError(f"{name}:{n}: expected 'file:qualname -> callee'")
        out.append((file.strip(), qualname.strip(), callee.strip(), len(out)))
    return out


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        rows = parse_labels(f.read(), os.path.basename(path))
    if not rows:
        raise ValueError(f"{os.path.basename(path)}: it has no labels")
    return spark.createDataFrame(rows, "caller_file string, caller_qualname string, callee string, seq long")
