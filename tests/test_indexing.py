import sys

import pytest

from weftgraph import api, indexing, report
from weftgraph.extract import EXTRACTORS
from weftgraph.functions.paths import hosted
from weftgraph.sources import graph_json

POLYGLOT = {
    "a.py": "def f():\n    return g()\n",
    "b.ts": 'import { g } from "pkg-a";\nexport function f() {\n  return g();\n}\n',
    "c.go": 'package c\nimport "fmt"\nfunc F() {\n\tfmt.Println(g())\n}\nfunc g() int { return 1 }\n',
    "D.java": "import java.util.List;\nclass D {\n  int f() { return g(); }\n  int g() { return 1; }\n}\n",
    "README.md": "no code",
    "node_modules/x.js": "function no() {}",
    "pkg/__init__.py": "",
}


@pytest.fixture
def tree(tmp_path):
    for rel, text in POLYGLOT.items():
        p = tmp_path / "repo" / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return tmp_path / "repo"


def rows(g):
    return (
        [tuple(r) for r in g.symbols.orderBy("ord").drop("ord").collect()],
        [tuple(r) for r in g.edges.orderBy("seq").drop("seq").collect()],
    )


def test_polyglot(spark, tree):
    r = indexing.index_folder(spark, str(tree))
    assert (r.files_scanned, r.files_indexed) == (5, 5)
    assert {k: v["coverage_percent"] for k, v in r.graph.meta["extraction_coverage"].items()} == {"go": 100.0, "java": 100.0, "python": 100.0, "typescript": 100.0}
    symbols, edges = rows(r.graph)
    assert symbols[0][0] == "repo://repo" and {"typescript://b:f", "go://c:g", "python://pkg.__init__"} <= {s[0] for s in symbols}
    imports = {e[1:3] for e in edges if e[0] == "IMPORTS"}
    assert imports == {("typescript://b", "typescript://pkg-a"), ("go://c", "go://fmt"), ("java://D", "java://java.util.List")}
    assert ("CALLS", "typescript://b:f", "typescript://pkg-a:g", "typescript", "medium") in {e[:5] for e in edges}
    assert ("CALLS", "go://c:F", "go://fmt", "go", "low") in {e[:5] for e in edges}
    assert ("CALLS", "java://D:f", "java://D:g", "java", "medium") in {e[:5] for e in edges}


def test_incremental_equals_cold(spark, tree, tmp_path):
    state = str(tmp_path / "state")
    first = indexing.index_folder(spark, str(tree), state=state)
    assert (first.files_reused, first.files_extracted) == (0, 5)
    again = indexing.index_folder(spark, str(tree), state=state)
    assert (again.files_reused, again.files_extracted) == (5, 0) and rows(again.graph) == rows(first.graph)
    (tree / "a.py").write_text("def f():\n    return h()\n")
    (tree / "new.py").write_text("import a\n")
    (tree / "c.go").unlink()
    warm = indexing.index_folder(spark, str(tree), state=state)
    assert (warm.files_reused, warm.files_extracted) == (3, 2)
    assert rows(warm.graph) == rows(indexing.index_folder(spark, str(tree)).graph)
    (tmp_path / "state" / "current.json").write_text("broken")
    assert indexing.index_folder(spark, str(tree), state=state).files_reused == 0


def calls(lang, rel, text):
    return [(r[4], r[5], r[8]) for r in EXTRACTORS[lang](rel, text.encode()).rows if r[0] == "e" and r[3] == "CALLS"]


def test_python_extraction():
    s = EXTRACTORS["python"]("pkg/a.py", b"import os.path\nfrom .b import g as h\nclass C(B):\n  def m(self): self.n(); h(); os.path.join('')\n  def n(self): pass\nasync def k(x, *, y): k(x)\n")
    ids = {r[2]: r for r in s.rows if r[0] == "s"}
    assert ids["python://pkg.a:C.n"][3] == "symbol" and ids["python://pkg.a:C.n"][9] is None  # met as a call before its definition
    assert ids["python://pkg.a:k"][11] == '{"args": ["x"], "async": true}'
    edges = [(r[3], r[4], r[5]) for r in s.rows if r[0] == "e"]
    assert ("IMPORTS", "python://pkg.a", "python://b.g") in edges and ("CALLS", "python://pkg.a:C.m", "python://b.g") in edges
    assert ("CALLS", "python://pkg.a:C.m", "python://os.path.path.join") in edges  # an alias stands for the whole target
    assert ("CALLS", "python://pkg.a:k", "python://k") in edges and ("INHERITS", "python://pkg.a:C", "python://B") in edges
    broken = EXTRACTORS["python"]("x/broken.py", b"def (")
    assert len(broken.rows) == 1 and broken.rows[0][2:4] == ("python://x/broken.py", "file") and "parse_error" in broken.rows[0][11]
    assert [r[2] for r in EXTRACTORS["python"]("e.py", b"").rows] == ["python://e"]


def test_brace_languages():
    assert calls("go", "c.go", "package c\nfunc (t *T) M(a int) { x.y(1) }\nfunc F() { if (a) { z() } }\n") == [("go://c:F", "go://x", "low"), ("go://c:F", "go://z", "low")]
    assert calls("java", "D.java", "class D { D() { this.x(); }\n @Override public int f(int a) { return new T(1).g(a); } }") == [("java://D:Override", "java://x", "low"), ("java://D:Override", "java://g", "low")]
    ts = 'import d, { g as k } from "./m";\nclass A extends B {\n  y = 1;\n  m() { this.n(); k(); d(); foo.bar.baz(); }\n  n() {}\n}\nconst w = () => { m(); };\nA.m();\na()();\n'
    assert calls("typescript", "b.ts", ts) == [
        ("typescript://b:A.m", "typescript://b:A.n", "high"),
        ("typescript://b:A.m", "typescript://..m:k", "medium"),
        ("typescript://b:A.m", "typescript://d", "low"),
        ("typescript://b:A.m", "typescript://bar", "low"),
        ("typescript://b:A.m", "typescript://b:A.m", "high"),
        ("typescript://b", "typescript://b:A.m", "high"),
        ("typescript://b", "typescript://a", "low"),
    ]
    for lang, rel in (("go", "x.go"), ("java", "X.java"), ("typescript", "x.ts")):
        for text in ("", "((({{{", "}}}", "func func(", "class", "import", "import {", '"', "const x ="):
            assert EXTRACTORS[lang](rel, text.encode()).rows


def test_tools(spark, tree, tmp_path):
    t, out = api.Tools(spark), str(tmp_path / "out" / "g.json")
    done = t.index_repo(str(tree), out)
    assert done.ok and done.data["files_indexed"] == 5
    assert t.stats(out).data["total_symbols"] == done.data["stats"]["total_symbols"]
    assert t.find_symbol("d:", 0, out).meta["count"] == 1  # a limit is at least 1
    assert t.callers("java://D:g", path=out).data[0]["caller"] == "java://D:f"
    assert t.impact("java://D:g", depth=-1, path=out).ok and t.path_between("java://D:f", "java://D:g", path=out).meta["count"] == 2
    assert t.related_files("D.java", path=out).data == ["D.java"]
    codes = [t.callers("zz", path=out), t.related_files("zz", path=out), t.stats(str(tmp_path / "no")), t.stats(str(tmp_path)), t.index_repo(str(tmp_path / "no")), t.index_repo("https://example.org/x")]
    assert [c.document()["error"]["code"] for c in codes] == ["SYMBOL_NOT_FOUND", "FILE_NOT_FOUND", "GRAPH_NOT_FOUND", "GRAPH_UNREADABLE", "SOURCE_NOT_FOUND", "INVALID_SOURCE"]
    bad = tmp_path / "bad.json"
    for text in ("nothing", '{"schema_version": "1.0.0"}', '{"schema_version": "2.0.0", "symbols": [{"idd": 1}]}'):
        bad.write_text(text)
        assert t.stats(str(bad)).error["code"] == "INVALID_GRAPH"


def test_stored_graphs(spark, tree, tmp_path):
    g = indexing.index_folder(spark, str(tree)).graph
    graph_json.write_json(g, str(tmp_path / "g.json"))
    graph_json.write_parquet(g, str(tmp_path / "g"))
    for back in (graph_json.read_json(spark, str(tmp_path / "g.json")), graph_json.read_parquet(spark, str(tmp_path / "g"))):
        assert back.meta == g.meta
        assert back.symbols.select("id", "type", "file", "line").exceptAll(g.symbols.select("id", "type", "file", "line")).count() == 0
        assert back.edges.count() == g.edges.count()
        assert [r.id for r in back.symbols.orderBy("ord").collect()] == [r.id for r in g.symbols.orderBy("ord").collect()]


def test_accuracy_run(spark, tmp_path):
    (tmp_path / "calc").mkdir()
    (tmp_path / "calc" / "__init__.py").write_text("")
    (tmp_path / "calc" / "ops.py").write_text("def add(a, b):\n    return a + b\n")
    (tmp_path / "calc" / "use.py").write_text("from calc.ops import add\n\n\ndef twice(a):\n    return add(a, a)\n\n\ndef hidden(a):\n    f = add\n    return f(a, a)\n\n\ndef unused(a):\n    return add(a, 1)\n")
    (tmp_path / "go.py").write_text("from calc.use import hidden, twice\n\n\ndef main():\n    twice(1)\n    hidden(2)\n\n\nif __name__ == '__main__':\n    main()\n")
    run = report.measure(spark, str(tmp_path), [sys.executable, "go.py"])
    assert run.failure is None and run.summary["n_matched"] == run.summary["n_observed"] - 1 >= 2
    assert "calc.use:hidden" in report.markdown(run, "t") and "calc.use:unused" in report.markdown(run, "t")
    failed = report.measure(spark, str(tmp_path), [sys.executable, "-c", "raise SystemExit(3)"])
    assert failed.precision is None and "no figure" in report.markdown(failed, "t")
    silent = report.measure(spark, str(tmp_path), [sys.executable, "-c", "pass"])
    assert silent.failure == "no calls were observed"


def test_addresses(spark):
    from weftgraph.functions.paths import hosted_repository, language, module_name

    urls = ["https://github.com/a/b", "http://WWW.github.com/a/b.git/tree/x", "https://github.com/a", "https://example.org/a/b", "/tmp", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(hosted_repository(df.u)).collect()] == ["https://github.com/a/b.git"] * 2 + [None] * 4
    df = spark.createDataFrame([(r,) for r in ("a/b.PY", "a/__init__.py", "build/x.py", "x.tar.go", ".py", "a/b.py", None)], "rel string")
    assert [r[0] for r in df.select(language(df.rel)).collect()] == ["python", "python", "python", "go", None, "python", None]
    assert [r[0] for r in df.select(module_name(df.rel)).collect()] == [None, "a", None, None, None, "a.b", None]
    assert hosted("https://github.com/a/b") == hosted("http://www.github.com/a/b.git/tree/x") == "https://github.com/a/b.git"
    assert hosted("https://github.com/a") is None and hosted("https://example.org/a/b") is None and hosted("/tmp") is None
