import io
import json

from graphs import two_modules

from weftgraph import cli, server
from weftgraph.api import TOOL_NAMES, Tools
from weftgraph.operators import traverse
from weftgraph.sources import graph_json
from weftgraph.streaming.calls import call_stream, edge_counts


def test_server(spark, tmp_path):
    graph_json.write_json(two_modules(spark), str(tmp_path / "g.json"))
    ask = [
        {"id": 1, "method": "initialize"},
        {"method": "notifications/initialized"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "callers", "arguments": {"symbol": "f", "path": str(tmp_path / "g.json")}}},
        {"id": 4, "method": "tools/call", "params": {"name": "callers", "arguments": {}}},
        {"id": 5, "method": "tools/call", "params": {"name": "nothing"}},
        {"id": 6, "method": "tools/call", "params": {"name": "callers", "arguments": {"symbol": "zz", "path": str(tmp_path / "g.json")}}},
    ]
    out = io.StringIO()
    server.serve(Tools(spark), io.StringIO("\n".join(map(json.dumps, ask)) + "\n{broken\n"), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert [t["name"] for t in got[2]["result"]["tools"]] == list(TOOL_NAMES)
    envelope = json.loads(got[3]["result"]["content"][0]["text"])
    assert envelope["ok"] and set(envelope["data"][0]) == {"caller", "caller_name", "line", "confidence"} and envelope["data"][0]["line"] == "12"
    assert got[4]["error"]["code"] == -32602 and got[5]["error"]["code"] == -32601 and got[None]["error"]["code"] == -32700
    assert got[6]["result"]["isError"]


def test_command_line(spark, tmp_path, capsys):
    graph_json.write_json(two_modules(spark), str(tmp_path / "g.json"))
    shell, p = cli.Shell(spark), cli.parser()
    run = lambda *a: shell.run(p.parse_args(["--graph", str(tmp_path / "g.json"), *a]))
    run("find", "m1:")
    run("impact", "m1:", "--depth", "1")  # by part of a name, unlike the tools
    run("path", "run", "g", "--types", "calls")
    run("related", "m2.py")
    run("callees", "run")
    run("stats")
    run("visual", "--out", str(tmp_path / "d.html"))
    said = capsys.readouterr().out
    assert "python://m1:f" in said and '"total_edges": 7' in said and (tmp_path / "d.html").exists()
    assert cli.main(["find", "x", "--limit", "-1"]) == 1 and cli.main(["--graph", str(tmp_path / "no.json"), "stats"]) == 1


def test_streams(spark, tmp_path):
    (tmp_path / "calls-1.jsonl").write_text('["a", "f", "b", "g"]\nbroken\n["a", "f"]\n')
    q = call_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("calls_seen").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.caller.module, r.callee.qualname) for r in spark.table("calls_seen").collect()] == [("a", "g")]
    edges = spark.createDataFrame([("calls ", "2025-01-01T05:00:00"), ("CALLS", "2025-01-01T06:00:00"), ("IMPORTS", "2025-01-03T00:00:00")], "type string, at string").selectExpr("type", "cast(at as timestamp_ntz) indexed_at")
    edges.write.parquet(str(tmp_path / "edges"))
    live = spark.readStream.schema(edges.schema).parquet(str(tmp_path / "edges"))
    q = edge_counts(live).writeStream.format("memory").queryName("edges_seen").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.type, r.n) for r in spark.table("edges_seen").collect()} == {("CALLS", 2)}


def test_the_same_for_any_number_of_partitions(spark):
    g, want = two_modules(spark), None
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = [tuple(r) for r in traverse.impact_of(g, "f", 3).collect()]
            want = want or got
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
