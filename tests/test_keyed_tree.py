from collections import Counter

from pyspark.sql import functions as F

from weftgraph.operators.keyed_tree import edge_key_counts, heavy_edge_keys, keyed_counts

EDGE = "edge_id long, type string, source string, target string, file string, facet int, n long"


def edges(spark, rows):
    return spark.createDataFrame([(k, *r, 7, 1) for k, r in enumerate(rows)], EDGE)


def test_counts_with_a_hot_key_nulls_and_clashing_columns(spark):
    rows = [("CALLS", f"s{k % 70}", "hot", f"f{k % 9}") for k in range(600)]
    rows += [(" calls", "s1", "hot", "f1"), ("Imports", None, "x", None), ("IMPORTS ", None, "x", "f"), (None, "a", None, None), ("CALLS", "a", None, "f")]
    got = {(r.type, r.target): (r.n_edges, r.n_sources, r.n_files) for r in edge_key_counts(edges(spark, rows)).collect()}
    assert got == {("CALLS", "hot"): (601, 70, 9), ("IMPORTS", "x"): (2, 0, 1), (None, None): (1, 1, 0), ("CALLS", None): (1, 1, 1)}
    assert {(r.type, r.target) for r in heavy_edge_keys(edges(spark, rows), 50).collect()} == {("CALLS", "hot")}


def test_any_tree_gives_the_same(spark):
    df = spark.createDataFrame([(k % 3, k % 11) for k in range(200)], "k int, v int")
    want = {k: (n, len({v for a, v in [(i % 3, i % 11) for i in range(200)] if a == k})) for k, n in Counter(i % 3 for i in range(200)).items()}
    for chunks, fan_in in ((1, 2), (5, 2), (64, 8), (100, 3)):
        got = {r.k: (r.n_rows, r.d) for r in keyed_counts(df, {"k": df.k}, {"d": df.v}, chunks=chunks, fan_in=fan_in).collect()}
        assert got == want


def test_empty(spark):
    assert edge_key_counts(edges(spark, [])).count() == 0
    assert heavy_edge_keys(edges(spark, [])).count() == 0


def test_summaries_hold_every_frequent_key(spark, monkeypatch):
    from weftgraph.operators import keyed_tree as t

    monkeypatch.setattr(t, "CHUNK", 50)
    values = [k % 7 if k % 3 else 1000 + k for k in range(3000)]  # seven keys with about a tenth each, a thousand with one row
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(11)
    kept = t.frequent_keys(df, [df.v], 20)
    h1, _ = t.key_hash([df.v])
    named = {r.v for r in df.join(kept.withColumnRenamed("k1", "h"), h1 == F.col("h"), "left_semi").distinct().collect()}
    assert set(range(7)) <= named and kept.count() <= 20 * 2


def test_a_hot_key_is_split_by_default(spark, monkeypatch):
    from weftgraph.operators import keyed_tree as t

    monkeypatch.setattr(t, "LEAF", 100)
    rows = [("CALLS", f"s{k % 170}", "hot" if k % 3 else f"t{k}", None if k % 5 == 0 else f"f{k % 9}") for k in range(2000)]
    want = {}
    for _, a, b, f in rows:
        n, s, fs = want.get(b, (0, set(), set()))
        want[b] = (n + 1, s | {a}, fs | ({f} - {None}))
    got = {r.target: (r.n_edges, r.n_sources, r.n_files) for r in edge_key_counts(edges(spark, rows)).collect()}
    assert got == {k: (n, len(s), len(f)) for k, (n, s, f) in want.items()}
