import pytest
from graphs import make

from weftgraph.functions.keys import call_end, symbol_key
from weftgraph.operators import accuracy
from weftgraph.sources.traces import health, parse_labels, read_calls

P = "python://"


def key(df, c):
    return [tuple(r.k) if r.k else None for r in df.select(c.alias("k")).collect()]


def test_keys(spark):
    df = spark.createDataFrame([(x,) for x in (P + "a.b:C.m", P + "a.b.f", P + "len", "go://a:b", P + ":x", None)], "id string")
    assert key(df, symbol_key(df.id)) == [("a.b", "C.m"), ("a.b", "f"), None, None, None, None]
    df = spark.createDataFrame([(x,) for x in (" a.__init__:f.<locals>.g\t", "a.b.<lambda>", "x", None)], "id string")
    assert key(df, call_end(df.id, True)) == [("a", "f"), ("a.b", ""), ("", "x"), None]
    assert key(df, call_end(df.id, False))[0] == ("a", "f.<locals>.g")


def graph(spark):
    symbols = [(P + f"m:{n}", "function", n, "m.py", 1) for n in ("a", "b", "c", "X.run", "Y.run")] + [(P + "m:ghost", "symbol", "ghost", None, None)]
    calls = [("a", "b"), ("a", "b"), ("b", "ghost"), ("c", "X.run"), ("a", "c")]
    return make(spark, symbols, [("CALLS", P + f"m:{x}", P + f"m:{y}", "high", "m.py", k) for k, (x, y) in enumerate(calls)])


def test_compare(spark):
    split = accuracy.split_calls(graph(spark))
    assert {r.seq: r.resolved for r in split.collect()} == {0: True, 1: True, 2: False, 3: True, 4: True}
    seen = [("m:a", "m:b"), ("m:b", "m:ghost"), ("m:c", "m:Y.run"), ("m:b", "m:c"), ("m:a", "m:X.run"), ("m:a", "m:b"), (None, "m:b")]
    pairs = accuracy.observed_pairs(spark.createDataFrame(seen, "caller string, callee string"))
    m = {(r.caller.qualname, r.callee.qualname): r.seq for r in accuracy.matched(split, pairs).collect()}
    assert m == {("a", "b"): 1, ("b", "ghost"): 2}
    assert accuracy.unmatched(split, pairs).count() == 3 and [r.seq for r in accuracy.unobserved(split, pairs).orderBy("seq").collect()] == [3, 4]
    assert {r["class"]: r.n for r in accuracy.miss_classes(split, pairs).collect()} == {"override": 1, "unresolved": 1, "silent": 1}
    s = accuracy.summary(split, pairs).first()
    assert (s.n_observed, s.n_matched, s.n_judgeable, s.precision_bp) == (5, 2, 4, 4000)
    none = accuracy.summary(split, pairs.limit(0)).first()
    assert none.n_observed == 0 and none.precision_bp is None


def test_sample(spark):
    labels = spark.createDataFrame([("m.py", "a", "m:b", 0), ("m.py", "c", "m:nope", 1), ("m.py", "c", "m:X.run", 2)], "caller_file string, caller_qualname string, callee string, seq long")
    region = accuracy.sample_region(graph(spark), labels)
    assert accuracy.sample_confirmed(region, labels).count() == 2 and accuracy.sample_unconfirmed(region, labels).count() == 2
    assert [r.callee for r in accuracy.sample_missing(region, labels).collect()] == ["m:nope"]
    assert accuracy.sample_summary(region, labels).first().precision_bp == 5000
    assert accuracy.sample_summary(region.limit(0), labels).first().precision_bp == 0


def test_traces_and_labels(spark, tmp_path):
    (tmp_path / "calls-1.jsonl").write_text('["a", "f", "b", "g"]\n\n["a", "f", "b", "g"]\n')
    (tmp_path / "calls-2.jsonl").write_text('["a", "e", "b", "g"]\n')
    assert [tuple(r) for r in read_calls(spark, str(tmp_path)).collect()] == [("a", "e", "b", "g"), ("a", "f", "b", "g")]
    assert health(str(tmp_path)) is None
    (tmp_path / "calls-1.status.json").write_text('{"pid": 1, "recorded": 3, "error": null, "finished": false}')
    assert "did not finish" in health(str(tmp_path))
    assert read_calls(spark, str(tmp_path / "none")).count() == 0
    assert parse_labels("# x\n\na/b.py:C.m -> n:f\n", "l") == [("a/b.py", "C.m", "n:f", 0)]
    for bad in ("a.py:f", "f -> g", "a.py: -> g"):
        with pytest.raises(ValueError, match="l:1"):
            parse_labels(bad, "l")
