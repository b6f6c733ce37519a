from datetime import datetime as d

from weftgraph.operators.orphans import graph_orphans, orphan_references, orphan_report

T = [d(2025, m, 1) for m in range(1, 9)]
REF = "tbl string, row_id long, field string, ref string, at timestamp_ntz"
PAR = "id string, start timestamp_ntz, stop timestamp_ntz"


def test_reasons(spark):
    parents = [("a", T[1], T[3]), ("a", T[5], None), ("b", T[4], None), ("b", T[4], None), (None, T[0], None), ("c", T[0], T[2]), ("c", T[1], T[4])]
    refs = [
        ("e", 1, "s", "a", T[1]),  # from its start on
        ("e", 2, "s", "a", T[3]),  # its end is exclusive
        ("e", 3, "s", "a", T[6]),
        ("e", 4, "s", "a", T[0]),  # before both lives
        ("e", 5, "t", "b", T[2]),
        ("e", 6, "t", "nobody", T[2]),
        ("e", 6, "t", "nobody", T[2]),
        ("e", 7, "t", "always", T[0]),
        ("e", 8, "t", "c", T[2]),
        ("e", 9, "t", "a", None),
        ("e", 10, "t", "nobody", None),
    ]
    refs += [("e", 100 + k, "t", "hot", T[2]) for k in range(300)]
    got = orphan_references(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PAR), spark.createDataFrame([("always",), (None,)], "id string"))
    rows = {(r.row_id, r.reason, r.period) for r in got.collect()}
    assert {x for x in rows if x[0] < 100} == {
        (2, "deleted", "2025-04"), (4, "late", "2025-01"), (5, "late", "2025-03"), (6, "missing", "2025-03"), (9, "deleted", None), (10, "missing", None)}
    assert sum(x[0] >= 100 for x in rows) == 300
    assert {(r.reason, r.n_references) for r in orphan_report(got).collect() if r.reason == "late"} == {("late", 1)}


def test_empty_tables(spark):
    edges = spark.createDataFrame([], "edge_id long, source string, target string, indexed_at timestamp_ntz")
    inferred = spark.createDataFrame([], "edge_no long, callee string, resolved boolean, indexed_at timestamp_ntz")
    symbols = spark.createDataFrame([], "id string, indexed_at timestamp_ntz, removed_at timestamp_ntz")
    external = spark.createDataFrame([], "id string, start int")
    assert graph_orphans(edges, inferred, symbols, external).count() == 0
    one = spark.createDataFrame([(1, "x", None, T[0])], edges.schema)
    assert [r.reason for r in graph_orphans(one, inferred, symbols, external).collect()] == ["missing"]


def test_hot_ids_many_lives_and_sliced_filters(spark, monkeypatch):
    """A hot id with very many lives, filters too small for all ids: as by brute force."""
    import datetime as dt

    from weftgraph.functions import bloom
    from weftgraph.operators import orphans as o

    monkeypatch.setattr(bloom, "MOST_BITS", 1 << 10)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    lives = [("hot", 10 * k, 10 * k + 4) for k in range(200)] + [("hot", 40, 47), ("open", 100, None)] + [(f"id{k}", k, k + 50) for k in range(300)]
    refs = [(k, "hot", k % 2100) for k in range(3000)] + [(5000 + k, f"id{k % 350}", k) for k in range(700)] + [(9000, "open", 99), (9001, "open", 100), (9002, "open", 5000), (9003, "ext", 0), (9004, "hot", None)]
    p = spark.createDataFrame([(i, day(a), None if b is None else day(b)) for i, a, b in lives], "id string, start timestamp_ntz, stop timestamp_ntz")
    r = spark.createDataFrame([("t", n, "f", i, None if h is None else day(h)) for n, i, h in refs], "tbl string, row_id long, field string, ref string, at timestamp_ntz")
    want = set()
    for n, i, h in refs:
        own = [(a, b) for x, a, b in lives if x == i]
        if i == "ext" or (h is not None and any(a <= h and (b is None or h < b) for a, b in own)):
            continue
        reason = "missing" if not own else "late" if h is not None and all(a > h for a, _ in own) else "deleted"
        want.add((n, reason))
    got = o.orphan_references(r, p, spark.createDataFrame([("ext",), (None,)], "id string"))
    assert {(x.row_id, x.reason) for x in got.collect()} == want and got.count() == len(want)
