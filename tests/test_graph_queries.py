from collections import deque

from graphs import make, two_modules
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftgraph.graph import first_wins
from weftgraph.operators import export, lookup, stats, traverse

P = "python://"


def test_lookup(spark):
    g = two_modules(spark)
    assert [r.id for r in lookup.find_symbol(g, "M1:").collect()] == [P + "m1:f", P + "m1:g"]
    assert lookup.find_symbol(g, "%").count() == 0
    assert lookup.exact_ids(g, "f") == [P + "m1:f"] and lookup.exact_ids(g, P + "m1") == [P + "m1"]
    assert lookup.resolve_ids(g, "nobody") == [] and lookup.resolve_ids(g, "m2:c") == [P + "m2:C", P + "m2:C.run"]
    assert [tuple(r)[:4] for r in lookup.callers_of(g, "f").collect()] == [(P + "m2:C.run", "run", 12, "medium")]
    assert [r.callee for r in lookup.callees_of(g, "run").collect()] == [P + "m1:f"]
    assert lookup.callers_of(g, "nobody").count() == 0 and lookup.callers_of(g, "f", 0).count() == 0
    assert [r.seq for r in lookup.edges_from(g, P + "m1").collect()] == [0, 1]
    assert lookup.probe(g, "M1").count() == 0 and lookup.probe(g, "C").first().id == P + "m2:C"


def test_traversals(spark):
    g = two_modules(spark)
    assert {r.id: (r.distance, r.via) for r in traverse.impact_of(g, "f", 1).collect()} == {P + "m2:C.run": (1, "CALLS"), P + "m1": (1, "CONTAINS")}
    assert traverse.impact_of(g, "f", 3).count() == 4
    path = [tuple(r)[:3] for r in traverse.shortest_path(g, "f", "g").collect()]
    assert path == [(0, "", P + "m1:f"), (1, "CALLS", P + "m1:g")]
    assert traverse.shortest_path(g, "run", "g", max_depth=1).count() == 0
    assert traverse.shortest_path(g, "run", "g", max_depth=2).count() == 3
    assert traverse.shortest_path(g, "m2", "m1", ["IMPORTS"]).count() == 2
    assert traverse.shortest_path(g, "f", "C").count() == 0
    assert [tuple(r)[:2] for r in traverse.shortest_path(g, "f", "f").collect()] == [(0, "")]
    assert [r.file for r in traverse.related_files(g, "m2.py").collect()] == ["m1.py", "m2.py"]
    assert [r.file for r in traverse.related_files(g, "m2.py", 0).collect()] == ["m2.py"]
    assert traverse.related_files(g, "no.py").count() == 0
    rows, edges = traverse.neighbourhood(g, "f", 1)
    assert {r.id for r in rows.collect()} == {P + "m1", P + "m1:f", P + "m1:g", P + "m2:C.run"} and edges.count() == 4


def test_stats_and_export(spark):
    g = two_modules(spark)
    d = stats.stats_document(g)
    assert (d["total_symbols"], d["total_edges"]) == (6, 7) and d["confidence"] == {"high": 6, "medium": 1}
    assert d["confidence_percent"] == {"high": 85.71, "medium": 14.29} and d["symbol_types"]["function"] == 2
    nodes, links = export.visual(g, 2)
    assert nodes.count() == 2 and links.count() == 0
    assert export.visual(g)[1].count() == 7 and "m2:C.run" in export.dashboard(g, "t")
    e = make(spark, [], [("CALLS", "a", "b", None, None, None)])
    assert stats.stats_document(e)["confidence"] == {"unknown": 1}
    assert stats.stats_document(make(spark, [], []))["total_edges"] == 0
    assert "Showing 25 of 30" in export.bounded_table(spark.range(30), ["id"]) and export.bounded_table(spark.range(0), ["id"]) == "None.\n"


def test_first_wins(spark):
    rows = spark.createDataFrame([(1, "a", "symbol", None), (2, "a", "function", "f.py"), (3, None, "x", None), (4, "b", "class", "g.py")], "ord long, id string, type string, file string")
    assert {r.id: r.type for r in first_wins(rows).collect()} == {"a": "symbol", "b": "class"}
    assert {r.id: r.type for r in first_wins(rows, keep="definition").collect()} == {"a": "function", "b": "class"}


def queue_walk(edges, seeds, depth):
    """(id, depth, seq of the edge of discovery) in order of discovery."""
    out = {s: (0, None) for s in dict.fromkeys(seeds)}
    todo = deque(out)
    while todo:
        x = todo.popleft()
        if out[x][0] == depth:
            continue
        for k, (a, b) in enumerate(edges):
            if a == x and b not in out:
                out[b] = (out[x][0] + 1, k)
                todo.append(b)
    return [(n, d, k) for n, (d, k) in out.items()]


node = st.integers(0, 7).map(lambda k: f"n{k}")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(node, node), max_size=22), st.lists(node, min_size=1, max_size=3), st.integers(0, 4))
def test_levels_walk_as_a_queue_does(spark, edges, seeds, depth):
    g = make(spark, [], [("CALLS", a, b, "high", None, None) for a, b in edges])
    got = traverse.levels(traverse.forward(g.edges), traverse._seeds(spark, seeds), depth).orderBy("depth", "key").collect()
    assert [(r.id, r.depth, r.key[-1] if r.depth else None) for r in got] == queue_walk(edges, seeds, depth)
