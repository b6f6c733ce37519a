import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.functions import field61 as gf
from weftgraph.operators.reconcile import call_site_differences, field_differences

numbers = st.integers(0, gf.P - 1)


@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=30))
def test_field_product(pairs):
    a, b = (np.array(x, dtype=np.uint64) for x in zip(*pairs))
    assert gf.mul(a, b).tolist() == [x * y % gf.P for x, y in pairs]
    assert gf.sub(a, b).tolist() == [(x - y) % gf.P for x, y in pairs]


@settings(max_examples=40)
@given(st.sets(st.integers(1 << 21, gf.P - 1), max_size=6), st.sets(st.integers(1 << 21, gf.P - 1), max_size=6))
def test_rational_recovers_a_difference(a, b):
    a, b = a - b, b - a

    def chi(xs, z):
        v = 1
        for x in xs:
            v = v * (z - x) % gf.P
        return v

    zs = list(range(1, 18))
    ratio = [chi(a, z) * pow(chi(b, z), -1, gf.P) % gf.P for z in zs]
    p, q = gf.rational(zs[:15], ratio[:15], len(a) - len(b), list(zip(zs[15:], ratio[15:])))
    assert len(p) - 1 == len(a) and all(gf._poly_at(p, x) == 0 for x in a)
    assert len(q) - 1 == len(b) and all(gf._poly_at(q, x) == 0 for x in b)


def test_differences_of_two_copies(spark):
    r = random.Random(3)
    left = {k: (r.choice("abc"), r.choice([None, 1, 2])) for k in range(900)}
    right = {k: v for k, v in left.items() if r.random() > 0.1}
    for k in list(right)[::7]:
        right[k] = (r.choice("abcd"), r.choice([None, 3]))
    right |= {k: ("z", None) for k in range(2000, 2400)}  # many more than the first bound of a bucket
    df = lambda x: spark.createDataFrame([(k, *v) for k, v in x.items()], "key long, a string, b int")
    want = {(k, "only_l") for k in left.keys() - right.keys()} | {(k, "only_r") for k in right.keys() - left.keys()}
    want |= {(k, f) for k in left.keys() & right.keys() for i, f in enumerate("ab") if left[k][i] != right[k][i]}
    got = [tuple(x) for x in field_differences(df(left), df(right), ["a", "b"], "only_l", "only_r").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert field_differences(df(left), df(left), ["a", "b"], "only_l", "only_r").count() == 0


OBS = "obs_id long, site_id long, repo string, caller string, callee string, file string, line int, recorded_at timestamp_ntz, key int"
INF = "edge_no long, site_id long, repo string, caller string, callee string, confidence string, file string, line int, resolved boolean, indexed_at timestamp_ntz"


def test_call_sites(spark):
    from datetime import datetime as d

    t1, t2 = d(2025, 1, 1), d(2025, 1, 2)
    obs = [
        (1, 1, "r", " m:f.<locals>.g ", "n:h", "a.py", 1, t1, 0),
        (2, 2, "r", "m:f", "n:h", "a.py", 1, t2, 0),
        (3, 2, "r", "m:old", "n:h", "a.py", 1, t1, 0),  # an older row of the site
        (4, 3, "r", "m:f", None, None, 1, t1, 0),
        (5, 4, "r", "m:f", "n:h", "a.py", 1, t1, 0),
        (5, 4, "r", "m:f", "n:h", "a.py", 1, t1, 0),  # delivered again
        (6, None, "r", "m:f", "n:h", "a.py", 1, t1, 0),
        (7, 6, "r", "m:f", "n:<lambda>", "a.py", 1, t1, 0),
        (8, 7, "r", "m:x", "n:h", "a.py", 1, t1, 0),
        (9, 7, "r", "m:y", "n:h", "a.py", 1, t1, 0),  # a tie: the greater number is current
    ]
    inf = [
        (1, 1, "r", "python://m.__init__:f", "python://n.h", "high", "a.py", 1, True, t1),
        (2, 2, "r", "python://m:f", "python://n:h", "high", "b.py", None, True, t1),
        (3, 3, "r", "python://m:f", None, "high", None, 1, True, t1),
        (4, 5, "r", "python://m:f", "python://n:h", "high", "a.py", 1, True, t1),
        (5, 6, "r", "python://m:f", "python://n:", "high", "a.py", 1, True, t1),
        (6, 7, "r", "python://m:y", "python://n:h", "high", "a.py", 1, True, t1),
    ]
    got = {tuple(x) for x in call_site_differences(spark.createDataFrame(obs, OBS), spark.createDataFrame(inf, INF)).collect()}
    assert got == {(2, "file"), (2, "line"), (4, "only_observed"), (5, "only_inferred"), (6, "callee")}
    assert call_site_differences(spark.createDataFrame([], OBS), spark.createDataFrame([], INF)).count() == 0
    assert {r.diff for r in call_site_differences(spark.createDataFrame(obs, OBS), spark.createDataFrame([], INF)).collect()} == {"only_observed"}
