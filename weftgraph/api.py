"""Tools over a stored graph: bounded arguments, one envelope, an error code for everything that can go wrong."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .graph import CodeGraph
from .indexing import index_folder
from .operators import lookup, stats, traverse
from .sources.graph_json import InvalidGraph, read_json, read_parquet, write_json
from .sources.repository import open_source

# Defaults and bounds of the tools.
FIND, CALLERS, CALLEES = 20, 50, 50
RELATED_DEPTH, RELATED, IMPACT_DEPTH, IMPACT, PATH_DEPTH = 2, 100, 3, 200, 12
MOST_ROWS, MOST_DEPTH = 500, 20
DEFAULT_GRAPH = "tmp/weftgraph.graph.json"


class ToolError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Envelope:
    """ok with data, or not ok with error; meta has the duration and, for rows, their count."""

    ok: bool
    data: Any = None
    error: dict[str, str] | None = None
    meta: dict[str, Any] = field(default_factory=dict)

    def document(self) -> dict[str, Any]:
        d = asdict(self)
        d.pop("error" if self.ok else "data")
        return d


def graph_path(path: str | None) -> str:
    """The absolute path of a graph, by default of the usual one below the working directory."""
    return os.path.realpath(path or DEFAULT_GRAPH)


def clamp_limit(value: int | None, default: int) -> int:
    return max(1, min(MOST_ROWS, default if value is None else value))


def clamp_depth(value: int | None, default: int) -> int:
    return max(1, min(MOST_DEPTH, default if value is None else value))


def _rows(df: DataFrame, *leave: str) -> list[dict[str, str]]:
    """Rows as the tools give them: all values text, missing ones empty. The frames are bounded by a limit."""
    return [{k: "" if v is None else str(v) for k, v in r.asDict().items() if k not in leave} for r in df.collect()]


class Tools:
    """The tools of one session. A graph file is read again only after it changed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._graphs: dict[str, tuple[float, CodeGraph]] = {}

    def graph(self, path: str | None) -> CodeGraph:
        path = graph_path(path)
        if not os.path.exists(path):
            raise ToolError("GRAPH_NOT_FOUND", f"no graph at {path}; index a source first")
        parquet = os.path.isdir(path) and os.path.isdir(f"{path}/symbols")
        if os.path.isdir(path) and not parquet:
            raise ToolError("GRAPH_UNREADABLE", f"{path} is a folder without a graph")
        stamp = os.stat(path).st_mtime
        if path in self._graphs and self._graphs[path][0] == stamp:
            return self._graphs[path][1]
        try:
            g = (read_parquet if parquet else read_json)(self.spark, path).cache()
        except InvalidGraph as e:
            raise ToolError("INVALID_GRAPH", str(e)) from None
        except OSError as e:
            raise ToolError("GRAPH_UNREADABLE", str(e)) from None
        self._graphs[path] = (stamp, g)
        return g

    def _run(self, failure: str, work: Callable[[], Any]) -> Envelope:
        began = time.perf_counter()
        try:
            data, error = work(), None
        except ToolError as e:
            data, error = None, {"code": e.code, "message": str(e)}
        except Exception as e:  # noqa: BLE001
            data, error = None, {"code": failure, "message": f"{type(e).__name__}: {e}"[:500]}
        meta: dict[str, Any] = {"duration_ms": round((time.perf_counter() - began) * 1000)}
        if isinstance(data, list):
            meta["count"] = len(data)
        return Envelope(error is None, data, error, meta)

    @staticmethod
    def _known(g: CodeGraph, symbol: str) -> None:
        if not lookup.exact_ids(g, symbol, 1):
            raise ToolError("SYMBOL_NOT_FOUND", f"no symbol has the id or name {symbol!r}")

    def index_repo(self, source: str, path: str | None = None, exclude: list[str] | None = None, state: str | None = None) -> Envelope:
        def work():
            try:
                with open_source(source) as (folder, kind):
                    r = index_folder(self.spark, folder, exclude or (), state)
                    write_json(r.graph, graph_path(path))
                    return {
                        "graph_path": graph_path(path), "source_kind": kind, "files_scanned": r.files_scanned, "files_indexed": r.files_indexed,
                        "files_reused": r.files_reused, "files_extracted": r.files_extracted, "stats": stats.stats_document(r.graph),
                    }
            except FileNotFoundError as e:
                raise ToolError("SOURCE_NOT_FOUND", str(e)) from None
            except PermissionError as e:
                raise ToolError("PERMISSION_DENIED", str(e)) from None
            except ValueError as e:
                raise ToolError("INVALID_SOURCE", str(e)) from None

        return self._run("INDEX_FAILED", work)

    def stats(self, path: str | None = None) -> Envelope:
        return self._run("STATS_FAILED", lambda: stats.stats_document(self.graph(path)))

    def find_symbol(self, query: str, limit: int | None = None, path: str | None = None) -> Envelope:
        return self._run("FIND_FAILED", lambda: _rows(lookup.find_symbol(self.graph(path), query, clamp_limit(limit, FIND))))

    def callers(self, symbol: str, limit: int | None = None, path: str | None = None) -> Envelope:
        def work():
            g = self.graph(path)
            self._known(g, symbol)
            return _rows(lookup.callers_of(g, symbol, clamp_limit(limit, CALLERS)), "seq")

        return self._run("CALLERS_FAILED", work)

    def callees(self, symbol: str, limit: int | None = None, path: str | None = None) -> Envelope:
        def work():
            g = self.graph(path)
            self._known(g, symbol)
            return _rows(lookup.callees_of(g, symbol, clamp_limit(limit, CALLEES)), "seq")

        return self._run("CALLEES_FAILED", work)

    def path_between(self, source: str, target: str, types: list[str] | None = None, max_depth: int | None = None, path: str | None = None) -> Envelope:
        def work():
            g = self.graph(path)
            self._known(g, source)
            self._known(g, target)
            return _rows(traverse.shortest_path(g, source, target, types, clamp_depth(max_depth, PATH_DEPTH)))

        return self._run("PATH_FAILED", work)

    def impact(self, symbol: str, depth: int | None = None, limit: int | None = None, types: list[str] | None = None, path: str | None = None) -> Envelope:
        def work():
            g = self.graph(path)
            self._known(g, symbol)
            return _rows(traverse.impact_of(g, symbol, clamp_depth(depth, IMPACT_DEPTH), clamp_limit(limit, IMPACT), types))

        return self._run("IMPACT_FAILED", work)

    def related_files(self, file: str, depth: int | None = None, limit: int | None = None, path: str | None = None) -> Envelope:
        def work():
            g = self.graph(path)
            if lookup.file_symbols(g, file).isEmpty():
                raise ToolError("FILE_NOT_FOUND", f"no symbol lies in {file!r}")
            return [r.file for r in traverse.related_files(g, file, clamp_depth(depth, RELATED_DEPTH), clamp_limit(limit, RELATED)).collect()]

        return self._run("RELATED_FAILED", work)


#: Names under which an agent server registers the tools.
TOOL_NAMES = ("index_repo", "stats", "find_symbol", "callers", "callees", "path_between", "impact", "related_files")
