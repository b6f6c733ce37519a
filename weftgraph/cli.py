"""Command line: one command, or a prompt that keeps a graph loaded."""

from __future__ import annotations

import argparse
import json
import os
import shlex
import sys

from pyspark.sql import DataFrame, SparkSession

from . import api
from .graph import CodeGraph
from .indexing import index_folder
from .operators import export, lookup, stats, traverse
from .sources.graph_json import read_json, read_parquet, write_json
from .sources.repository import open_source


def _at_least(least: int):
    def number(text: str) -> int:
        n = int(text)
        if n < least:
            raise argparse.ArgumentTypeError(f"must be {least} or more")
        return n

    return number


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("weftgraph", exit_on_error=False)
    p.add_argument("--graph", default=api.DEFAULT_GRAPH, help="graph file, or folder of Parquet tables")
    p.add_argument("--raw", action="store_true", help="rows as JSON")
    sub = p.add_subparsers(dest="command")
    count, depth = _at_least(0), _at_least(0)
    types = lambda text: [x for x in text.upper().split(",") if x]
    c = sub.add_parser("index")
    c.add_argument("source")
    c.add_argument("--exclude", type=lambda x: x.split(","), default=[])
    c.add_argument("--state")
    c = sub.add_parser("init")
    c.add_argument("source", nargs="?", default=".")
    c = sub.add_parser("load")
    c.add_argument("path")
    for name in ("stats", "where", "clear", "raw", "help", "exit", "quit"):
        sub.add_parser(name)
    for name, default in (("find", api.FIND), ("callers", api.CALLERS), ("callees", api.CALLEES)):
        c = sub.add_parser(name)
        c.add_argument("symbol")
        c.add_argument("--limit", type=count, default=default)
    c = sub.add_parser("related")
    c.add_argument("file")
    c.add_argument("--depth", type=depth, default=api.RELATED_DEPTH)
    c.add_argument("--limit", type=count, default=api.RELATED)
    c = sub.add_parser("path")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--max-depth", type=depth, default=api.PATH_DEPTH)
    c.add_argument("--types", type=types)
    c = sub.add_parser("impact")
    c.add_argument("symbol")
    c.add_argument("--depth", type=depth, default=api.IMPACT_DEPTH)
    c.add_argument("--limit", type=count, default=api.IMPACT)
    c.add_argument("--types", type=types)
    c = sub.add_parser("visual")
    c.add_argument("--out", default="tmp/dashboard.html")
    c.add_argument("--limit", type=count, default=export.VISUAL_LIMIT)
    return p


def snippets(here: str) -> str:
    """What agent programs need in their settings to start the tools' server in a folder."""
    run = [sys.executable, "-m", "weftgraph.server"]
    forms = {
        "servers with command and arguments": {"mcpServers": {"weftgraph": {"command": run[0], "args": run[1:], "cwd": here}}},
        "servers with one command line": {"mcp": {"weftgraph": {"type": "local", "command": run, "cwd": here, "enabled": True}}},
    }
    return "\n".join(f"{name}:\n{json.dumps(form, indent=2)}" for name, form in forms.items()) + f"\nas a plain command: {shlex.join(run)}"


class Shell:
    def __init__(self, spark: SparkSession):
        self.spark, self.g, self.path, self.raw = spark, None, None, False

    def load(self, path: str) -> CodeGraph:
        if not os.path.exists(path):
            raise FileNotFoundError(f"no graph at {path}; index a source first")
        if self.g is None or self.path != path:
            self.g = (read_parquet if os.path.isdir(path) else read_json)(self.spark, path).cache()
            self.path = path
        return self.g

    def show(self, df: DataFrame, *leave: str) -> None:
        rows = [{k: v for k, v in r.asDict().items() if k not in leave} for r in df.collect()]
        if self.raw:
            print(json.dumps(rows, ensure_ascii=False, indent=2))
            return
        for r in rows:
            print("  ".join("" if v is None else str(v) if len(str(v)) <= 90 else str(v)[:89] + "…" for v in r.values()))
        print(f"{len(rows)} rows")

    def run(self, a: argparse.Namespace) -> None:
        self.raw = self.raw or a.raw
        match a.command:
            case "index" | "init":
                with open_source(a.source) as (folder, kind):
                    r = index_folder(self.spark, folder, getattr(a, "exclude", ()), getattr(a, "state", None))
                    write_json(r.graph, a.graph)
                print(f"{kind}: {r.files_scanned} files, {r.files_indexed} indexed, {r.files_reused} reused, {r.files_extracted} extracted; graph at {a.graph}")
                if a.command == "init":
                    self._dashboard(self.load(a.graph), "tmp/dashboard.html", export.VISUAL_LIMIT)
                    print(snippets(os.getcwd()))
            case "load":
                self.load(a.path)
            case "where":
                print(self.path or a.graph)
            case "raw":
                self.raw = not self.raw
            case "clear":
                print("\033[2J\033[H", end="")
            case "stats":
                print(json.dumps(stats.stats_document(self.load(self.path or a.graph)), indent=2, ensure_ascii=False))
            case "find":
                self.show(lookup.find_symbol(self._g(a), a.symbol, a.limit))
            case "callers":
                self.show(lookup.callers_of(self._g(a), a.symbol, a.limit), "seq")
            case "callees":
                self.show(lookup.callees_of(self._g(a), a.symbol, a.limit), "seq")
            case "related":
                self.show(traverse.related_files(self._g(a), a.file, a.depth, a.limit))
            case "path":
                self.show(traverse.shortest_path(self._g(a), a.source, a.target, a.types, a.max_depth))
            case "impact":
                self.show(traverse.impact_of(self._g(a), a.symbol, a.depth, a.limit, a.types))
            case "visual":
                self._dashboard(self._g(a), a.out, a.limit)
            case _:
                print(parser().format_help())

    def _g(self, a: argparse.Namespace) -> CodeGraph:
        return self.load(self.path or a.graph)

    @staticmethod
    def _dashboard(g: CodeGraph, out: str, limit: int) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
        with open(out, "w", encoding="utf-8") as f:
            f.write(export.dashboard(g, "Code graph", limit))
        print(out)


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    spark = SparkSession.builder.appName("weftgraph").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    shell, p = Shell(spark), parser()
    if args:
        try:
            shell.run(p.parse_args(args))
        except (argparse.ArgumentError, OSError, ValueError, RuntimeError) as e:
            print(e, file=sys.stderr)
            return 1
        except SystemExit as e:
            return int(bool(e.code))
        return 0
    while True:
        try:
            words = shlex.split(input("weftgraph> "))
        except (EOFError, KeyboardInterrupt):
            return 0
        if words and words[0] in ("exit", "quit"):
            return 0
        try:
            if words:
                shell.run(p.parse_args(words))
        except (argparse.ArgumentError, OSError, ValueError, RuntimeError) as e:
            print(e)
        except SystemExit:
            pass


if __name__ == "__main__":
    sys.exit(main())
