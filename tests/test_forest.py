import random

import pytest

from weftgraph.operators import forest

LINK = "child string, parent string, at long, path string, root string"


def truth(parent):
    nodes, out = set(parent) | set(parent.values()), {}
    for n in nodes:
        seen, x = [], n
        while x in parent and x not in seen:
            seen.append(x)
            x = parent[x]
        if x not in parent:
            out[n] = (x, len(seen), [x, *reversed(seen)])
        else:
            out[n] = ("", -1 if x == n else -2, None)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(c, p, k, "clash", "clash") for k, (c, p) in enumerate(rows)], LINK)
    nodes = forest.hierarchy(df, df.child, df.parent, [df["at"]], with_paths=True)
    return {r.id: (r.root, r.depth, r.path) for r in nodes.collect()}, nodes


@pytest.mark.parametrize("small", [False, True])
def test_random_forests_with_cycles(spark, monkeypatch, small):
    if small:  # many levels, pieces and pointer doubling on a small graph
        monkeypatch.setattr(forest, "LAST_NODES", 8)
        monkeypatch.setattr(forest, "PART_NODES", 15)
    r = random.Random(5)
    names = [f"x://m{k % 6}.{k % 4}:n{k}" for k in range(120)]
    parent = {names[k]: names[r.randrange(max(0, k - 9), k)] for k in range(1, 90)}
    parent |= {names[90 + k]: names[90 + (k + 1) % 7] for k in range(7)}  # a cycle over modules
    parent |= {names[100 + k]: names[90 + r.randrange(10)] for k in range(10)}
    parent[names[115]] = names[115]
    parent[names[116]] = names[115]
    got, _ = run(spark, [*parent.items(), (None, "x"), ("y", None), (None, None)])
    assert got == truth(parent)


def test_chain_latest_row_and_descendants(spark, monkeypatch):
    monkeypatch.setattr(forest, "LAST_NODES", 5)
    monkeypatch.setattr(forest, "PART_NODES", 6)
    chain = [(f"a://c{k}:x", f"a://c{k - 1}:x") for k in range(1, 60)]
    rows = [("a://c7:x", "a://wrong"), *chain]  # an older row of c7
    got, nodes = run(spark, rows)
    want = truth(dict(rows)) | {"a://wrong": ("a://wrong", 0, ["a://wrong"])}
    assert got == want
    pairs = forest.descendants(nodes)
    assert pairs.count() == 59 * 60 // 2
    counts = {r.id: r.n_descendants for r in forest.descendant_counts(nodes).collect()}
    assert counts["a://c0:x"] == 59 and counts["a://c59:x"] == 0


def test_empty(spark):
    got, _ = run(spark, [])
    assert got == {}
