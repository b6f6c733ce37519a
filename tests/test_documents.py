import gzip
import json
import os
import tracemalloc

import pytest
from graphs import EDGES, make
from pyspark.sql import functions as F

from weftgraph.graph import CodeGraph
from weftgraph.sources import graph_json

E = "type", "source", "target", "language", "confidence", "file", "line"


def peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("name", ["g.json", "g.json.gz"])
def test_the_driver_holds_no_document(spark, tmp_path, name):
    n, path = 150_000, str(tmp_path / "deep" / name)
    edges = spark.range(n).selectExpr(f"{n} - id seq", "'CALLS' type", "concat('python://m:', id) source", "concat('python://m:', id + 1) target", "'python' language", "'high' confidence", "'m.py' file", "int(id) line")
    g = CodeGraph(make(spark, [("x", "module", "x", "x.py", 1)], []).symbols, edges, {"made": {"by": ["x", 1]}})
    _, wrote = peak(lambda: graph_json.write_json(g, path))
    back, read = peak(lambda: graph_json.read_json(spark, path))
    assert max(wrote, read) < 20e6 < len((gzip.open if name.endswith("gz") else open)(path, "rb").read())
    assert back.meta == g.meta and os.listdir(tmp_path / "deep") == [name]
    assert back.edges.filter(F.col("seq") != n - 1 - F.col("line")).count() == 0 and back.edges.count() == n


def test_edges_in_pieces(spark, tmp_path, monkeypatch):
    """Repeats of whole rows go, those of other rows stay; the pieces' order is that of seq; the text is that of json.dump."""
    rows = [(k // 2, "CALLS", f"s{k // 4}", 't"\\\n\x1fé', "python", None, "f", k // 2) for k in range(400)]
    e = spark.createDataFrame(rows[::-1], EDGES).repartition(7)
    g = CodeGraph(make(spark, [], []).symbols, e.distinct(), {"edges": [{"a": "]}"}]}, all_edges=e)
    want = sorted(set(rows))
    monkeypatch.setattr(graph_json, "BLOCK", 300)
    monkeypatch.setattr(graph_json, "BATCH", 3)
    for name in ("g.json", "g.json.gz"):
        graph_json.write_json(g, str(tmp_path / name))
        back = graph_json.read_json(spark, str(tmp_path / name))
        assert [tuple(r) for r in back.edges.select("seq", *E).orderBy("seq").collect()] == want and back.meta == g.meta
    text = (tmp_path / "g.json").read_text()
    doc = json.loads(text)
    assert text == json.dumps(doc, indent=2, sort_keys=True, ensure_ascii=False) == gzip.open(tmp_path / "g.json.gz", "rt").read()
    (tmp_path / "one-line.json").write_text(json.dumps(doc))
    (tmp_path / "one-member.gz").write_bytes(gzip.compress(text.encode()))
    for name in ("one-line.json", "one-member.gz"):
        back = graph_json.read_json(spark, str(tmp_path / name))
        assert [tuple(r) for r in back.edges.select("seq", *E).orderBy("seq").collect()] == want


def test_symbols_of_odd_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graph_json, "BLOCK", 16)
    path = tmp_path / "g.json"

    def read(symbols, more=""):
        path.write_text('{"schema_version": "2.0.0", "symbols": ' + symbols + more + "}")
        return [tuple(r) for r in graph_json.read_json(spark, str(path)).symbols.orderBy("ord").select("ord", "id", "line", "metadata").collect()]

    assert read('[{"id": "a", "line": 1}, {"id": null}, {"id": "a", "line": 2}, {"id": "b\\\\\\"{", "metadata": {"k": ["}]"]}}]') == [(0, "a", 1, None), (3, 'b\\"{', None, '{"k":["}]"]}')]
    assert read('[{"id": "a"}]', ', "s\\u0079mbols": [{"id": "b"}]') == [(0, "b", None, None)]
    assert read("[ ]") == []
    for wrong in ('[{"id": "a"},]', '[{"id": "a"} {"id": "b"}]', '[{"id": "a"},,{"id": "b"}]', "[5]", "[null]", '[{"id": "a\nb"}]', '[{"id": "a"}', '{"id": 1}', '[{"id": "a"}] x', '[{"id": "a"}, {"idd": "b"}]'):
        with pytest.raises(graph_json.InvalidGraph):
            read(wrong)
    (tmp_path / "cut.gz").write_bytes(gzip.compress(b'{"schema_version": "2.0.0"}')[:-9])
    with pytest.raises(graph_json.InvalidGraph):
        graph_json.read_json(spark, str(tmp_path / "cut.gz"))


def test_the_driver_holds_no_symbols(spark, tmp_path):
    """Most of the text is symbols with metadata; all come back, with their rank."""
    n, path = 60_000, str(tmp_path / "g.json")
    rows = spark.range(n).selectExpr("cast(id as string) id", "'function' type", "'python' language", "'f' name", "'m.py' file", "int(id) line", f"{n} - id ord", """to_json(struct(array_repeat('argument', 20) args)) metadata""")
    g = CodeGraph(rows, make(spark, [], []).edges, {})
    _, wrote = peak(lambda: graph_json.write_json(g, path))
    back, read = peak(lambda: graph_json.read_json(spark, path))
    assert max(wrote, read) < 20e6 < os.path.getsize(path)
    assert back.symbols.filter((F.col("ord") == n - 1 - F.col("line")) & (F.col("metadata").like('{"args":["argument",%'))).count() == n == back.symbols.count()
