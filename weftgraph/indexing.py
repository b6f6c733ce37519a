"""Indexing of a source tree: scan, reuse what did not change, extract the rest, merge, keep state for the next run."""

from __future__ import annotations

import json
import os
import platform
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import SCHEMA_VERSION, __version__
from .extract import extract_all
from .extract.rows import SCHEMA
from .graph import CodeGraph, first_wins
from .operators.incremental import reuse
from .runtime import ship, stage
from .sources.repository import scan

CACHE_VERSION = 2
STRIDE = 1 << 24  # more rows than one file gives


@dataclass
class IndexResult:
    graph: CodeGraph
    files_scanned: int
    files_indexed: int
    files_reused: int
    files_extracted: int


def fingerprint(root: str) -> dict[str, object]:
    """What the state of another run must share to be used."""
    return {"version": CACHE_VERSION, "repo_root": os.path.realpath(root), "host_id": platform.node(), "tool_version": __version__, "schema_version": SCHEMA_VERSION}


def _load_state(spark: SparkSession, folder: str | None, root: str) -> tuple[DataFrame, DataFrame]:
    """Files and rows of the last run; empty if there are none, or of another place, host or version, or unreadable."""
    none = spark.createDataFrame([], "rel string, lang string, hash string, mtime_ns long"), spark.createDataFrame([], SCHEMA)
    if not folder:
        return none
    try:
        with open(f"{folder}/current.json", encoding="utf-8") as f:
            current = json.load(f)
        if current["fingerprint"] != fingerprint(root):
            return none
        files, rows = (spark.read.parquet(f"{folder}/{current['run']}/{x}") for x in ("files", "rows"))
        return files.select("rel", "lang", "hash", "mtime_ns"), rows.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    except Exception:  # noqa: BLE001 - a broken state is no state
        return none


def _save_state(spark: SparkSession, folder: str, root: str, files: DataFrame, rows: DataFrame) -> None:
    """A new folder, then one small file that names it: a reader sees the old state or the new one."""
    run = f"run-{os.urandom(8).hex()}"
    files.write.parquet(f"{folder}/{run}/files")
    rows.write.parquet(f"{folder}/{run}/rows")
    part = f"{folder}/{run}.json"
    with open(part, "w", encoding="utf-8") as f:
        json.dump({"fingerprint": fingerprint(root), "run": run}, f)
    os.replace(part, f"{folder}/current.json")


def merge(rows: DataFrame, root_name: str) -> CodeGraph:
    """One graph of the rows of all files, in the order of files and then of finding; the repository's symbol comes first."""
    rank = F.col("file_seq") * STRIDE + F.col("emit") + 1
    symbols = rows.filter("kind = 's'").select(rank.alias("ord"), "id", "type", "language", "name", "file", "line", F.lit(None).cast("int").alias("column"), "metadata")
    top = rows.sparkSession.createDataFrame([(0, f"repo://{root_name}", "repo", "meta", root_name, ".", None, None, None)], symbols.schema)
    edges = rows.filter("kind = 'e'").select(rank.alias("seq"), "type", "source", "target", "language", "confidence", "file", "line", F.lit(None).cast("int").alias("column"), F.lit(None).cast("string").alias("metadata"))
    return CodeGraph(first_wins(top.unionByName(symbols)), edges)


def index_folder(spark: SparkSession, root: str, exclude: Iterable[str] = (), state: str | None = None) -> IndexResult:
    """The graph of a folder. A file is reused if the state has it with the same language, time and content; what the scan
    has not is gone. A file whose extractor fails counts as seen, not as indexed."""
    ship(spark)
    files = stage(scan(spark, root, exclude), "scan")
    old_files, old_rows = _load_state(spark, state, root)
    actions = reuse(files.select("rel", "lang", "hash", "mtime_ns"), old_files)
    kept = stage(actions.filter("action = 'reused'").select("rel"), "reused")
    again = files.join(kept, "rel", "left_anti")
    seqs = files.select("rel", F.col("file_seq").alias("now"))
    reused = old_rows.join(kept, "rel", "left_semi").join(seqs, "rel").withColumn("file_seq", F.col("now")).drop("now")
    rows = stage(extract_all(again).unionByName(reused.select(*old_rows.columns)), "rows")
    failed = rows.filter("kind = 'x'").select("rel")
    done = files.join(failed, "rel", "left_anti")
    g = merge(rows, os.path.basename(os.path.realpath(root)))
    per = files.join(failed.withColumn("failed", F.lit(True)), "rel", "left").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("failed").isNull()).alias("ok"))
    cover = {r.lang: {"files_seen": r.n, "files_indexed": r.ok, "coverage_percent": round(100 * r.ok / r.n, 2)} for r in per.collect()}
    g.meta["extraction_coverage"] = dict(sorted(cover.items()))
    if state:
        os.makedirs(state, exist_ok=True)
        _save_state(spark, state, root, done.select("rel", "lang", "hash", "mtime_ns"), rows.filter("kind <> 'x'"))
    seen, ok, n_kept = sum(c["files_seen"] for c in cover.values()), sum(c["files_indexed"] for c in cover.values()), kept.count()
    return IndexResult(g, seen, ok, n_kept, ok - n_kept)
