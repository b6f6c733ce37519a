import json
import os

import duckdb
import pytest
from graphs import make
from pyspark.sql import functions as F

from weftgraph import cli, extract, report, runtime
from weftgraph.operators import export
from weftgraph.plans import surface_queries as s

#: Queries over small trees, whose SQL needs no tables.
SMALL = [n for n in s.QUERIES if n in s.SQL and "from (values" in s.SQL[n] and n not in ("tool_envelopes", "graph_metadata")]


@pytest.mark.parametrize("name", SMALL)
def test_the_rows_that_must_come_out(spark, name):
    got = sorted(tuple(map(str, r)) for r in s.QUERIES[name](spark, "/nowhere").collect())
    assert got == sorted(tuple(map(str, r)) for r in duckdb.sql(s.SQL[name]).fetchall())


def test_a_broken_extractor_fails_its_language_only(monkeypatch):
    monkeypatch.setitem(extract.PLACES, "go", ("no_such_module", "extract"))
    monkeypatch.delitem(extract.EXTRACTORS, "go", raising=False)
    with pytest.raises(extract.ExtractorUnavailable):
        extract.EXTRACTORS["go"]
    with pytest.raises(extract.ExtractorUnavailable):
        extract.EXTRACTORS["cobol"]
    assert extract.extract_file("a.go", "go", b"") is None and extract.extract_file("a.py", "python", b"").rows


def test_an_import_of_very_many_names():
    names = ", ".join(f"n{k}" for k in range(500))
    rows = extract.EXTRACTORS["typescript"]("a.ts", f'import {{ {names} }} from "./m";\n'.encode()).rows
    assert sum(r[0] == "e" and r[3] == "IMPORTS" for r in rows) == 500


def test_the_dashboard_has_every_link(spark):
    p = [(f"x{k}", "function", f"n{k}", "a.py", k) for k in range(3)]
    g = make(spark, p, [("CALLS", "x0", f"x{k % 3}", "high", "a.py", k) for k in range(30_000)])
    page = export.dashboard(g, "t", limit=3)
    data = json.loads(page.split('id="data">')[1].split("</script>")[0])
    assert len(data["links"]) == 30_000 and len(data["nodes"]) == 3


def test_a_lookup_reaches_the_scan(spark, tmp_path):
    from weftgraph.graph import from_tables
    from weftgraph.operators import lookup

    rows = spark.range(100).selectExpr("id ord", "concat('python://m:', id % 50) id", "'function' type", "'python' language", "concat('f', id) name", "'m.py' file", "1 line", "cast(null as string) metadata")
    rows.write.parquet(f"{tmp_path}/symbols.parquet")
    spark.createDataFrame([], "edge_id long, type string, source string, target string, language string, confidence string, file string, line int").write.parquet(f"{tmp_path}/edges.parquet")
    g = from_tables(spark, str(tmp_path))
    found = lookup.file_symbols(g, "m.py")
    plan = g.where(F.col("file") == "m.py")._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 50 and "EqualTo(file,m.py)" in plan
    assert {r.id for r in lookup.find_symbol(g, "F7", 50).collect()} == {"python://m:7"}  # the first row of an id decides


def test_staged_tables_go(spark, tmp_path):
    df = runtime.stage(spark.range(3), "to-go")
    path = runtime._STAGED[-1][1]
    assert df.count() == 3
    kept = list(runtime._STAGED)
    try:
        runtime._STAGED[:] = kept[-1:]
        runtime._remove_staged()
        assert not runtime._STAGED
    finally:
        runtime._STAGED[:] = kept[:-1]
    assert not os.path.exists(runtime.local_path(path))


def test_reasons_of_a_run(spark, tmp_path):
    with pytest.raises(RuntimeError, match="could not clone"):
        report.checkout("/nowhere/x", None, str(tmp_path))
    assert "weftgraph.server" in cli.snippets("/x")
