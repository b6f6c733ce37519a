"""Counts over a graph and over what was read of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph


def _counts(df: DataFrame, column, section: str) -> DataFrame:
    return df.groupBy(column.alias("metric")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "metric", "n")


def stats(g: CodeGraph) -> DataFrame:
    """(section, metric, n): totals, symbols by type and language, edges by type and confidence. A missing confidence is
    ``unknown``. One pass over each table by grouping sets."""
    s = g.symbols.groupingSets([["type"], ["language"], []], "type", "language").agg(F.count("*").alias("n"), F.grouping("type").alias("gt"), F.grouping("language").alias("gl"))
    s = s.select(
        F.when(F.col("gt") == 0, "symbol_types").when(F.col("gl") == 0, "languages").otherwise("totals").alias("section"),
        F.when(F.col("gt") == 0, F.col("type")).when(F.col("gl") == 0, F.col("language")).otherwise(F.lit("symbols")).alias("metric"), "n")
    e = g.edges.select("type", F.when(F.length("confidence") > 0, F.col("confidence")).otherwise("unknown").alias("confidence"))
    e = e.groupingSets([["type"], ["confidence"], []], "type", "confidence").agg(F.count("*").alias("n"), F.grouping("type").alias("gt"), F.grouping("confidence").alias("gc"))
    e = e.select(
        F.when(F.col("gt") == 0, "edge_types").when(F.col("gc") == 0, "confidence").otherwise("totals").alias("section"),
        F.when(F.col("gt") == 0, F.col("type")).when(F.col("gc") == 0, F.col("confidence")).otherwise(F.lit("edges")).alias("metric"), "n")
    return s.unionByName(e)


def stats_document(g: CodeGraph) -> dict:
    """The statistics as one nested document, percentages half-even to two places; coverage if the graph has it."""
    out: dict = {"symbol_types": {}, "languages": {}, "edge_types": {}, "confidence": {}}
    totals = {"symbols": 0, "edges": 0}
    for r in stats(g).collect():
        (totals if r.section == "totals" else out[r.section])[r.metric] = r.n
    share = {k: round(100 * v / totals["edges"], 2) if totals["edges"] else 0.0 for k, v in out["confidence"].items()}
    doc = {"total_symbols": totals["symbols"], "total_edges": totals["edges"], **{k: dict(sorted(v.items())) for k, v in out.items()}, "confidence_percent": dict(sorted(share.items()))}
    if "extraction_coverage" in g.meta:
        doc["extraction_coverage"] = g.meta["extraction_coverage"]
    return doc


def coverage(files: DataFrame) -> DataFrame:
    """(language, files_seen, files_indexed, basis_points): each file once by its newest row; indexed: it could be read."""
    last = files.filter(F.col("rel").isNotNull()).groupBy("rel").agg(F.max(F.struct("file_seq", "lang", F.col("content").isNotNull().alias("ok"))).alias("f"))
    by = last.groupBy(F.col("f.lang").alias("language")).agg(F.count("*").alias("files_seen"), F.count_if("f.ok").alias("files_indexed"))
    return by.withColumn("basis_points", F.floor(F.col("files_indexed") * 10000 / F.col("files_seen")).cast("long"))
