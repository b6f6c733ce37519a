"""Registered queries of sources, sinks, extraction, tools and command line, and SQL that tells the same.

Tools and stored graphs run over the whole test tables; scans, indexing, traces and extraction run over small trees that are
written into the shared folder, and their SQL holds the rows that must come out.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import shutil
import subprocess
import sys
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api, cli, report, server
from ..extract import EXTRACTORS
from ..functions import paths
from ..graph import CodeGraph, from_tables
from ..indexing import fingerprint, index_folder, merge
from ..operators import export
from ..runtime import local_path, shared_dir, stage
from ..runtime import read_table as t
from ..sources import graph_json, repository, traces
from ..tracing import run_traced
from . import graph_queries
from .fixtures import EXPECTED, SOURCES, TREE

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def values(columns: str, rows: list[tuple]) -> str:
    """SQL that gives constant rows; every value is text or null."""
    cell = lambda v: "cast(null as varchar)" if v is None else "'" + str(v).replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as x({columns})"


def frame(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    text = [tuple(None if v is None else str(v) for v in r) for r in rows]
    return spark.createDataFrame(text, ", ".join(f"{c.strip()} string" for c in columns.split(",")))


@contextlib.contextmanager
def folder(spark: SparkSession, files: dict[str, str] = {}) -> Iterator[str]:  # noqa: B006
    """A new folder in the shared one, with ``files``; gone afterwards."""
    at = f"{local_path(shared_dir(spark))}/surface-{uuid.uuid4().hex}"
    try:
        os.makedirs(at)
        for rel, text in files.items():
            os.makedirs(os.path.dirname(f"{at}/{rel}"), exist_ok=True)
            with open(f"{at}/{rel}", "w", encoding="utf-8") as f:
                f.write(text)
        yield at
    finally:
        shutil.rmtree(at, ignore_errors=True)


# --- scans, sources, sinks -------------------------------------------------------------------------------------------

_SCAN = [(0, "a/b.py", "python"), (1, "a/c.TSX", "typescript"), (2, "a.py", "python"), (3, "lib/e.mjs", "typescript"), (4, "lib/f.go", "go"), (5, "lib/g.java", "java")]


@query(values("file_seq, rel, lang", _SCAN))
def scan_order(spark: SparkSession, d: str) -> DataFrame:
    """Only known suffixes, without left-out names, ordered part by part of the path."""
    tree = {"a.py": "", "a/b.py": "", "a/c.TSX": "", "lib/e.mjs": "", "lib/f.go": "", "lib/g.java": "", "build/x.py": "", "lib/.venv/y.py": "", "read.md": "", "lib/tmp": "", "lib/h": ""}
    with folder(spark, tree) as at:
        return frame(spark, "file_seq, rel, lang", repository.scan(spark, at).select("file_seq", "rel", "lang").collect())


@query(values("names, rel", [("given", "build/x.py"), ("given", "lib/y.py"), ("usual", "lib/y.py"), ("usual", "own/z.py")]))
def scan_left_out(spark: SparkSession, d: str) -> DataFrame:
    """Names that are given replace the usual ones; no names mean the usual ones."""
    with folder(spark, {"build/x.py": "", "lib/y.py": "", "own/z.py": ""}) as at:
        rows = [(k, r[1]) for k, names in (("given", {"own"}), ("usual", set())) for r in repository.list_files(at, names)]
    return frame(spark, "names, rel", rows)


_URLS = ["https://github.com/a/b", "http://WWW.github.com/a/b.git", "https://github.com/a/b/tree/main", "https://github.com/a", "https://example.org/a/b", "ftp://github.com/a/b", "/tmp/x", "https://github.com/a/b.git/", None]
_URL_SQL = f"""with u as ({values('url', [(u,) for u in _URLS])}), p as (select url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) host,
  string_split(trim(regexp_replace(url, '^https?://[^/]+', ''), '/'), '/') parts from u)
select url, case when host in ('github.com', 'www.github.com') and len(parts) >= 2 then 'https://github.com/' || parts[1] || '/' || regexp_replace(parts[2], '\\.git$', '') || '.git' end as clone,
  cast(coalesce(host in ('github.com', 'www.github.com') and len(parts) >= 2, false) as varchar) as is_hosted from p"""


@query(_URL_SQL)
def hosted_addresses(spark: SparkSession, d: str) -> DataFrame:
    u = frame(spark, "url", [(u,) for u in _URLS])
    return u.select("url", paths.hosted_repository(u.url).alias("clone"), paths.hosted_repository(u.url).isNotNull().cast("string").alias("is_hosted"))


@query(values("source, result", [("folder", "local"), ("gone", "FileNotFoundError"), ("https://example.org/a/b", "ValueError")]))
def opened_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    with folder(spark) as at:
        for name, source in (("folder", at), ("gone", f"{at}/gone"), ("https://example.org/a/b",) * 2):
            try:
                with repository.open_source(source) as (_, kind):
                    rows.append((name, kind))
            except (FileNotFoundError, ValueError) as e:
                rows.append((name, type(e).__name__))
    return frame(spark, "source, result", rows)


@contextlib.contextmanager
def _back(spark: SparkSession, d: str, kind: str) -> Iterator[CodeGraph]:
    """The graph of the tables, written and read again; what was written goes afterwards. A document is compressed, as a plain
    one is ten times as large as the tables."""
    g = from_tables(spark, d)
    g.meta["made"] = {"by": ["x", 1]}
    write, read, end = (graph_json.write_json, graph_json.read_json, "json.gz") if kind == "json" else (graph_json.write_parquet, graph_json.read_parquet, kind)
    with folder(spark) as at:
        write(g, f"{at}/deep/g.{end}")
        yield read(spark, f"{at}/deep/g.{end}")


_S = f"with {graph_queries._G}"


@query(f"{_S} select id, row_number() over (order by ord) - 1 as rank, type, language, name, file, line from s")
def json_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols of a graph document; their order in it is their rank."""
    with _back(spark, d, "json") as back:
        return back.symbols.select("id", F.col("ord").alias("rank"), "type", "language", "name", "file", "line")


@query(f"{_S} select row_number() over (order by seq) - 1 as rank, type, source, target, language, confidence, file, line from e")
def json_edges(spark: SparkSession, d: str) -> DataFrame:
    with _back(spark, d, "json") as back:
        return back.edges.select(F.col("seq").alias("rank"), "type", "source", "target", "language", "confidence", "file", "line")


@query(f"{_S} select id, ord, type, language, name, file, line from s")
def parquet_symbols(spark: SparkSession, d: str) -> DataFrame:
    with _back(spark, d, "parquet") as back:
        return stage(back.symbols, "back-symbols").select("id", "ord", "type", "language", "name", "file", "line")


@query(f"{_S} select seq, type, source, target, language, confidence, file, line from e")
def parquet_edges(spark: SparkSession, d: str) -> DataFrame:
    with _back(spark, d, "parquet") as back:
        return stage(back.edges, "back-edges").select("seq", "type", "source", "target", "language", "confidence", "file", "line")


@query(values("kind, made", [("json", '{"by": ["x", 1]}'), ("parquet", '{"by": ["x", 1]}')]))
def graph_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for kind in ("json", "parquet"):
        with _back(spark, d, kind) as back:
            rows.append((kind, json.dumps(back.meta["made"])))
    return frame(spark, "kind, made", rows)


_CALLS = [("m", "f", "m", "g"), ("m", "f", "n", "C.h"), ("n", "C.h", "m", "g")]


@query(values("caller_module, caller_qualname, callee_module, callee_qualname", _CALLS))
def trace_source(spark: SparkSession, d: str) -> DataFrame:
    """Distinct calls of all trace files; blank and broken lines aside."""
    line = lambda *x: json.dumps(x) + "\n"
    with folder(spark, {"calls-2.jsonl": line(*_CALLS[1]) + "\n" + line(*_CALLS[0]), "calls-1.jsonl": line(*_CALLS[2]) + line(*_CALLS[0]) + "broken\n" + line("a", "b"), "other.jsonl": line(*"wxyz")}) as at:
        return stage(traces.read_calls(spark, at), "trace-source")


@query(values("state, why", [("done", None), ("error", "b.status.json: disk full"), ("idle", None), ("open", "b.status.json: it did not finish")]))
def trace_health(spark: SparkSession, d: str) -> DataFrame:
    states = {"done": {"recorded": 3, "finished": True}, "error": {"recorded": 3, "finished": True, "error": "disk full"}, "idle": {"recorded": 0, "finished": False}, "open": {"recorded": 1, "finished": False}}
    rows = []
    for name, s in states.items():
        with folder(spark, {"a.status.json": json.dumps(states["done"]), "b.status.json": json.dumps(s)}) as at:
            rows.append((name, traces.health(at)))
    return frame(spark, "state, why", rows)


_LABELS = "# by hand\n\n a/b.py : C.f ->  m:g \nx:y.py:h -> k\n"


@query(values("caller_file, caller_qualname, callee, seq", [("a/b.py", "C.f", "m:g", 0), ("x:y.py", "h", "k", 1)]))
def label_source(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, "caller_file, caller_qualname, callee, seq", traces.parse_labels(_LABELS, "l.txt"))


@query(values("line, error", [(x, f"l.txt:2: {'expected'}") for x in ("a.py f -> g", "a.py:f", ":f -> g", "a.py: -> g", "a.py:f ->")]))
def label_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for x in ("a.py f -> g", "a.py:f", ":f -> g", "a.py: -> g", "a.py:f ->"):
        try:
            traces.parse_labels(f"# c\n{x}\n", "l.txt")
        except ValueError as e:
            rows.append((x, " ".join(str(e).split()[:2])))
    return frame(spark, "line, error", rows)


@query("select 'links' as what, cast(count(*) as varchar) as n from (" + graph_queries.SQL["visual_links"] + ") union all select 'nodes', cast(count(*) as varchar) from (" + graph_queries.SQL["visual_nodes"] + ")")
def dashboard_data(spark: SparkSession, d: str) -> DataFrame:
    """What the page holds: all nodes of the export and every link between them."""
    page = export.dashboard(from_tables(spark, d), "t")
    data = json.loads(page.split('id="data">')[1].split("</script>")[0].replace("<\\/", "</"))
    return frame(spark, "what, n", [(k, len(v)) for k, v in data.items()])


@query("select 'language' as first, (select count(distinct language) from (" + f"{_S} select language from s))" + " as n, 25 as shown")
def bounded_table(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 rows of a table and, where there are more, how many there are."""
    g = from_tables(spark, d)
    few = export.bounded_table(g.symbols.groupBy("language").count().orderBy("language"), ["language", "count"])
    many = export.bounded_table(g.symbols.orderBy("id"), ["id"])
    assert many.rstrip().endswith(f"Showing 25 of {g.symbols.count()}.")
    return spark.createDataFrame([(few.split("|")[1].strip(), len(few.splitlines()) - 2, len([x for x in many.splitlines() if "://" in x]))], "first string, n long, shown int")


# --- extraction ------------------------------------------------------------------------------------------------------


def _extraction(lang: str) -> None:
    columns = "kind, id, type, source, target, name, confidence, file, line, metadata"

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = []
        for rel, text in SOURCES[lang].items():
            for kind, _, id_, type_, source, target, _, name, confidence, file, line, metadata in EXTRACTORS[lang](rel, text.encode()).rows:
                rows.append((kind, id_, type_, source, target, name, confidence, file, line, metadata))
        return frame(spark, columns, rows)

    run.__name__ = f"extract_{lang}"
    query(values(columns, EXPECTED[lang]))(run)


for _lang in SOURCES:
    _extraction(_lang)

_LINES = """f as (select distinct rel, lang, content from source_files where content is not null and rel is not null),
l as (select rel, lang, content, unnest(string_split(content, chr(10))) as x, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line from f)"""


@query(f"""with {_LINES} select rel, line, regexp_extract(x, '^func ([A-Za-z_]\\w*)', 1) as name from l where rel like '%.go' and regexp_matches(x, '^func [A-Za-z_]\\w*\\s*\\(')""")
def extracted_go_functions(spark: SparkSession, d: str) -> DataFrame:
    e = graph_queries._extracted(spark, d).filter("kind = 'e' and type = 'CONTAINS' and language = 'go'")
    return e.select("rel", F.col("line").cast("long").alias("line"), F.substring_index("target", ":", -1).alias("name"))


@query("select rel, count(*) as n_modules from (select distinct rel, content from source_files where content is not null and rel is not null) where regexp_matches(lower(rel), '\\.(go|java|ts|tsx|js|mjs|cjs)$') group by rel")
def extracted_modules(spark: SparkSession, d: str) -> DataFrame:
    """Every file of the languages that are read by the tokenizer gives its module, whatever is in it."""
    e = graph_queries._extracted(spark, d).filter("kind = 's' and emit = 0 and type = 'module' and language <> 'python'")
    return e.groupBy("rel").agg(F.count("*").alias("n_modules"))


# --- indexing --------------------------------------------------------------------------------------------------------

_RUNS = [("cold", 5, 5, 0, 5), ("same", 5, 5, 5, 0), ("changed", 5, 5, 3, 2), ("touched", 5, 5, 4, 1), ("broken state", 5, 5, 0, 5)]


@query(values("run, scanned, indexed, reused, extracted", _RUNS))
def index_runs(spark: SparkSession, d: str) -> DataFrame:
    """Reuse of files that are the same in language, time and content; new, changed, touched and deleted ones."""
    rows = []
    with folder(spark, {f"repo/{k}": v for k, v in TREE.items()}) as at:
        root, state = f"{at}/repo", f"{at}/state"

        def run(name: str) -> None:
            r = index_folder(spark, root, state=state)
            rows.append((name, r.files_scanned, r.files_indexed, r.files_reused, r.files_extracted))

        run("cold")
        run("same")
        with open(f"{root}/a.py", "w") as f:
            f.write("def f():\n    return h()\n")
        with open(f"{root}/new.py", "w") as f:
            f.write("import a\n")
        os.remove(f"{root}/c.go")
        run("changed")
        os.utime(f"{root}/a.py", ns=(10**18, 10**18))  # a touched file is read again
        run("touched")
        with open(f"{state}/current.json", "w") as f:
            f.write("broken")
        run("broken state")
    return frame(spark, "run, scanned, indexed, reused, extracted", rows)


@query(values("language, files_seen, files_indexed, coverage_percent", [("go", 1, 1, "100.0"), ("java", 1, 1, "100.0"), ("python", 2, 2, "100.0"), ("typescript", 1, 1, "100.0")]))
def index_coverage(spark: SparkSession, d: str) -> DataFrame:
    with folder(spark, TREE) as at:
        meta = index_folder(spark, at).graph.meta["extraction_coverage"]
    return frame(spark, "language, files_seen, files_indexed, coverage_percent", [(k, *v.values()) for k, v in meta.items()])


@query(values("id, type, file, ord", [("repo://r", "repo", ".", 0), ("x", "function", "a.py", 1), ("y", "symbol", None, (1 << 24) + 2)]))
def merged_files(spark: SparkSession, d: str) -> DataFrame:
    """Files in their order, then as found; the first symbol of an id stays, the repository goes before all."""
    from ..extract.rows import SCHEMA

    row = lambda seq, emit, id_, kind, file: (f"f{seq}", seq, "s", emit, id_, kind, None, None, "python", id_, None, file, None, None)
    rows = spark.createDataFrame([row(1, 0, "x", "symbol", None), row(0, 0, "x", "function", "a.py"), row(1, 1, "y", "symbol", None)], SCHEMA)
    return frame(spark, "id, type, file, ord", merge(rows, "r").symbols.select("id", "type", "file", "ord").orderBy("ord").collect())


@query(values("field", [("host_id",), ("repo_root",), ("schema_version",), ("tool_version",), ("version",)]))
def state_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, "field", [(k,) for k in fingerprint(".")])


# --- tracing ---------------------------------------------------------------------------------------------------------

_TRACED = [("go", "main", "use", "<lambda>"), ("go", "main", "use", "twice"), ("use", "twice", "ops", "add")]


@query(values("caller_module, caller_qualname, callee_module, callee_qualname", _TRACED))
def traced_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls within the tree of a run program: callees by any name, callers up to their first unnamed part, modules' own
    code calls nothing."""
    tree = {
        "ops.py": "def add(a, b):\n    return abs(a) + b\n",
        "use.py": "from ops import add\n\n\ndef twice(a):\n    return add(a, a)\n\n\npick = lambda a: a\n",
        "go.py": "from use import pick, twice\n\n\ndef main():\n    twice(1)\n    twice(2)\n    pick(3)\n\n\nif __name__ == '__main__':\n    main()\n",
    }
    with folder(spark, tree) as at:
        why = run_traced([sys.executable, "go.py"], at, f"{at}/trace") or traces.health(f"{at}/trace")
        return frame(spark, "caller_module, caller_qualname, callee_module, callee_qualname", [(why,) * 4] if why else traces.read_calls(spark, f"{at}/trace").collect())


_PROGRAM = {"calc.py": "def add(a, b):\n    return a + b\n\n\ndef twice(a):\n    return add(a, a)\n", "go.py": "from calc import twice\n\n\ndef main():\n    twice(1)\n\n\nif __name__ == '__main__':\n    main()\n"}
_HARNESS = [("whole", None, "2", "2"), ("commit", "could not check out 123abc", None, None), ("clone", "could not clone /nowhere/x.git", None, None), ("interpreter", "no interpreter given and installation turned off", None, None), ("command", "it ended with 3", None, None), ("silent", "no calls were observed", None, None)]


@query(values("run, failure, n_observed, n_matched", _HARNESS))
def accuracy_harness(spark: SparkSession, d: str) -> DataFrame:
    """A run from a repository at a commit to figures; every step that fails is its reason."""
    rows = []
    with folder(spark, {f"src/{k}": v for k, v in _PROGRAM.items()}) as at:
        git = ["git", "-c", "user.name=x", "-c", "user.email=x@example.org", "-C", f"{at}/src"]
        for step in (["init", "-q"], ["add", "."], ["commit", "-qm", "x"]):
            subprocess.run([*git, *step], check=True, capture_output=True)
        cases = {"whole": {}, "commit": {"commit": "123abc"}, "clone": {"repository": "/nowhere/x.git"}, "interpreter": {"python": None, "install": False}, "command": {"command": ["-c", "raise SystemExit(3)"]}, "silent": {"command": ["-c", "pass"]}}
        for name, more in cases.items():
            r = report.measure_repository(spark, **({"repository": f"{at}/src", "command": ["go.py"], "workdir": f"{at}/{name}", "python": sys.executable} | more)) if os.makedirs(f"{at}/{name}") is None else None
            s = r.summary or {}
            rows.append((name, r.failure and r.failure.split(": ")[0], s.get("n_observed"), s.get("n_matched")))
    return frame(spark, "run, failure, n_observed, n_matched", rows)


# --- tools and command line ------------------------------------------------------------------------------------------


@query("select v, cast(greatest(1, least(500, coalesce(v, 20))) as int) as as_limit, cast(greatest(1, least(20, coalesce(v, 3))) as int) as as_depth from (values (null), (-5), (0), (1), (19), (20), (21), (499), (500), (501), (100000)) x(v)")
def clamped(spark: SparkSession, d: str) -> DataFrame:
    rows = [(v, api.clamp_limit(v, 20), api.clamp_depth(v, 3)) for v in (None, -5, 0, 1, 19, 20, 21, 499, 500, 501, 100000)]
    return spark.createDataFrame(rows, "v int, as_limit int, as_depth int")


@contextlib.contextmanager
def _tools(spark: SparkSession, d: str) -> Iterator[tuple[api.Tools, str, CodeGraph]]:
    g = from_tables(spark, d)
    with folder(spark) as at:
        graph_json.write_parquet(g, f"{at}/g")
        yield api.Tools(spark), f"{at}/g", g


def _tool(name: str, like: str, columns: str, call) -> None:
    """A tool over the stored graph; its rows are the operator's as text, missing values empty."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        with _tools(spark, d) as (tools, path, g):
            envelope = call(tools, path, g)
            assert envelope.ok and envelope.meta["count"] == len(envelope.data) and "error" not in envelope.document(), envelope
            data = [{"file": x} if isinstance(x, str) else x for x in envelope.data]
            return frame(spark, columns, [tuple(x[c.strip()] for c in columns.split(",")) for x in data])

    run.__name__ = name
    text = ", ".join(f"coalesce(cast({c.strip()} as varchar), '') as {c.strip()}" for c in columns.split(","))
    query(f"select {text} from ({graph_queries.SQL[like]}) q")(run)


_tool("tool_find_symbol", "find_symbol", "id, type, name, file", lambda t, p, g: t.find_symbol("Ledger", path=p))
_tool("tool_callers", "callers", "caller, caller_name, line, confidence", lambda t, p, g: t.callers(graph_queries.hub(g), path=p))
_tool("tool_callees", "callees", "callee, callee_name, line, confidence", lambda t, p, g: t.callees(graph_queries.busy(g), path=p))
_tool("tool_impact", "impact_d3", "distance, via, id, type, name, file", lambda t, p, g: t.impact(graph_queries.hub(g), path=p))
_tool("tool_path", "path_default", "step, edge, id, type, name, file", lambda t, p, g: t.path_between(graph_queries.far(g), graph_queries.hub(g), path=p))
_tool("tool_related_files", "related_files_d2", "file", lambda t, p, g: t.related_files(graph_queries._file(g, graph_queries.hub(g)), path=p))

_ENVELOPES = [
    ("stats", "true", None), ("callers", "false", "SYMBOL_NOT_FOUND"), ("callees", "false", "SYMBOL_NOT_FOUND"), ("path_between", "false", "SYMBOL_NOT_FOUND"), ("impact", "false", "SYMBOL_NOT_FOUND"),
    ("related_files", "false", "FILE_NOT_FOUND"), ("no graph", "false", "GRAPH_NOT_FOUND"), ("a folder", "false", "GRAPH_UNREADABLE"), ("no json", "false", "INVALID_GRAPH"),
    ("old version", "false", "INVALID_GRAPH"), ("unknown field", "false", "INVALID_GRAPH"), ("no source", "false", "SOURCE_NOT_FOUND"), ("no address", "false", "INVALID_SOURCE"),
]


@query(values("call, ok, code", _ENVELOPES))
def tool_envelopes(spark: SparkSession, d: str) -> DataFrame:
    bad = {"none.json": "nothing", "old.json": '{"schema_version": "1.0.0"}', "field.json": '{"schema_version": "2.0.0", "symbols": [{"idd": 1}]}'}
    with _tools(spark, d) as (tools, path, _), folder(spark, bad) as at:
        got = {
            "stats": tools.stats(path), "callers": tools.callers("no such", path=path), "callees": tools.callees("no such", path=path),
            "path_between": tools.path_between("no such", "x", path=path), "impact": tools.impact("no such", path=path), "related_files": tools.related_files("no such", path=path),
            "no graph": tools.stats(f"{at}/gone"), "a folder": tools.stats(at), "no json": tools.stats(f"{at}/none.json"), "old version": tools.stats(f"{at}/old.json"),
            "unknown field": tools.stats(f"{at}/field.json"), "no source": tools.index_repo(f"{at}/gone"), "no address": tools.index_repo("https://example.org/x"),
        }
        return frame(spark, "call, ok, code", [(k, str(e.ok).lower(), None if e.ok else e.document()["error"]["code"]) for k, e in got.items()])


_INDEXED = [("files_extracted", 5), ("files_indexed", 5), ("files_reused", 0), ("files_scanned", 5), ("source_kind", "local")]


@query(values("field, value", _INDEXED))
def tool_index(spark: SparkSession, d: str) -> DataFrame:
    with folder(spark, {f"r/{k}": v for k, v in TREE.items()}) as at:
        data = api.Tools(spark).index_repo(f"{at}/r", f"{at}/out/g.json").data
        assert os.path.exists(f"{at}/out/g.json") and data["stats"]["total_symbols"] > 5
        return frame(spark, "field, value", [(k, data[k]) for k, _ in _INDEXED])


@query("select cast((select count(*) from s) as varchar) as symbols, cast((select count(*) from e) as varchar) as edges".replace("select cast", f"{_S} select cast", 1))
def tool_stats(spark: SparkSession, d: str) -> DataFrame:
    with _tools(spark, d) as (tools, path, _):
        data = tools.stats(path).data
        return frame(spark, "symbols, edges", [(data["total_symbols"], data["total_edges"])])


_MESSAGES = [("1", "result", "weftgraph"), ("2", "result", str(len(api.TOOL_NAMES))), ("3", "error", "-32602"), ("4", "error", "-32601"), ("5", "result", "True"), (None, "error", "-32700")]


@query(values("id, part, said", _MESSAGES))
def server_messages(spark: SparkSession, d: str) -> DataFrame:
    ask = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "callers", "arguments": {}}},
        {"id": 4, "method": "tools/call", "params": {"name": "nothing"}}, {"id": 5, "method": "tools/call", "params": {"name": "stats", "arguments": {"path": "/nowhere/g.json"}}},
    ]
    out = io.StringIO()
    server.serve(api.Tools(spark), io.StringIO("\n".join(map(json.dumps, ask)) + "\n{broken\n"), out)
    rows = []
    for r in map(json.loads, out.getvalue().splitlines()):
        x = r.get("result") or r["error"]
        rows.append((r["id"], "result" if "result" in r else "error", x["serverInfo"]["name"] if "serverInfo" in x else len(x["tools"]) if "tools" in x else x.get("code", x.get("isError"))))
    return frame(spark, "id, part, said", rows)


_SAID = [("find", "a.py"), ("index", "local: 5 files, 5 indexed, 0 reused, 5 extracted"), ("limit", "1"), ("missing", "1"), ("path", "2 rows"), ("raw", "["), ("stats", "{"), ("visual", "written"), ("where", "here")]


@query(values("command, said", _SAID))
def command_line(spark: SparkSession, d: str) -> DataFrame:
    """What commands print: rows, a count, raw rows as JSON; exit codes of wrong arguments and missing graphs."""
    with folder(spark, {f"r/{k}": v for k, v in TREE.items()}) as at:
        shell, p, rows = cli.Shell(spark), cli.parser(), []

        def run(name: str, *words: str) -> str:
            out = io.StringIO()
            with contextlib.redirect_stdout(out):
                shell.run(p.parse_args(["--graph", f"{at}/g.json", *words]))
            return out.getvalue()

        rows.append(("index", run("index", "index", f"{at}/r").split(";")[0]))
        rows.append(("find", run("find", "find", "python://a:f").split()[-3]))
        rows.append(("path", run("path", "path", "java://D:f", "java://D:g").splitlines()[-1]))
        rows.append(("stats", run("stats", "stats")[0]))
        rows.append(("visual", "written" if os.path.exists(run("visual", "visual", "--out", f"{at}/v.html").strip()) else "lost"))
        rows.append(("where", "here" if run("where", "where").strip() == f"{at}/g.json" else "elsewhere"))
        rows.append(("raw", run("raw", "--raw", "find", "D")[0]))
        with contextlib.redirect_stderr(io.StringIO()):
            rows += [("limit", cli.main(["find", "x", "--limit", "-1"])), ("missing", cli.main(["--graph", f"{at}/no.json", "stats"]))]
        return frame(spark, "command, said", rows)


@query(values("form, starts", [("mcp", "weftgraph"), ("mcpServers", "weftgraph"), ("plain", "weftgraph.server")]))
def agent_settings(spark: SparkSession, d: str) -> DataFrame:
    """The settings that the first run of the command line prints for agent programs."""
    text = cli.snippets("/here")
    forms = [json.loads(x[x.index("{") : x.rindex("}") + 1]) for x in text.split("servers with ")[1:]]
    rows = [(k, next(iter(v))) for f in forms for k, v in f.items()] + [("plain", text.split()[-1])]
    return frame(spark, "form, starts", rows)


@query("select lang, count(*) as n_rows, round(100.0 * count(*) / sum(count(*)) over (), 2) as percent, round(avg(n_bytes), 2) as mean_bytes from source_files group by lang")
def rounded_shares(spark: SparkSession, d: str) -> DataFrame:
    """Percentages and means with two places."""
    f = t(spark, d, "source_files")
    by = f.groupBy("lang").agg(F.count("*").alias("n_rows"), F.round(F.avg("n_bytes"), 2).alias("mean_bytes"))
    total = by.agg(F.sum("n_rows").alias("total"))  # one row
    return by.join(F.broadcast(total)).select("lang", "n_rows", F.round(100.0 * F.col("n_rows") / F.col("total"), 2).alias("percent"), "mean_bytes")


@query("select ord, id, json_extract_string(metadata, '$.kind') as kind, json_extract_string(metadata, '$.async') as is_async, cast(json_array_length(metadata, '$.args') as int) as n_args from symbols where metadata is not null")
def symbol_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the symbols' free-form metadata."""
    m = F.col("metadata")
    return t(spark, d, "symbols").filter(m.isNotNull()).select("ord", "id", F.get_json_object(m, "$.kind").alias("kind"), F.get_json_object(m, "$.async").alias("is_async"), F.json_array_length(F.get_json_object(m, "$.args")).alias("n_args"))
