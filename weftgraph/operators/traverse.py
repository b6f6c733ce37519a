"""Breadth-first traversals with the order of a queue walk, as joins level by level.

A queue walk over adjacency in insertion order finds each node by the least key (rank of the seed, seq of every edge on
the way) among its shortest ways. The key is an array, arrays compare part by part, so each hop is one join, a minimum
for each target and an anti-join; no global ranking is needed. Visited levels are staged tables.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import DEFAULT_IMPACT_TYPES, DEFAULT_PATH_TYPES, CodeGraph
from ..runtime import stage
from .lookup import resolve_ids

_LEVEL = "id string, key array<long>, depth int, via string"


def _seeds(spark: SparkSession, ids: list[str]) -> DataFrame:
    return spark.createDataFrame([(i, [k], 0, "") for k, i in enumerate(dict.fromkeys(ids))], _LEVEL)


def levels(steps: DataFrame, seeds: DataFrame, depth: int, most: int | None = None, until: DataFrame | None = None) -> DataFrame:
    """(id, key, depth, via) of all nodes within ``depth`` hops of the seeds (themselves at 0).

    steps: (near, far, type, seq). most: stop after the level that reaches so many nodes beside the seeds. until: (id),
    stop after the level that meets one. Small levels are broadcast by the planner, as staged tables have a size.
    """
    found = [stage(seeds, "bfs-0")]
    count = 0
    for d in range(1, depth + 1):
        if until is not None and not found[-1].join(until, "id", "left_semi").isEmpty():
            break
        near = found[-1].select(F.col("id").alias("near"), F.col("key").alias("before"))
        met = steps.join(near, "near").groupBy(F.col("far").alias("id")).agg(F.min(F.struct(F.concat("before", F.array("seq")).alias("key"), "type")).alias("m"))
        seen = reduce(DataFrame.unionByName, [x.select("id") for x in found])
        new = met.join(seen, "id", "left_anti").select("id", "m.key", F.lit(d).alias("depth"), F.col("m.type").alias("via"))
        new = stage(new, f"bfs-{d}")
        n = new.count()
        if not n:
            break
        found.append(new)
        count += n
        if most is not None and count >= most:
            break
    return reduce(DataFrame.unionByName, found)


def _typed(g: CodeGraph, types: Iterable[str] | None, default: Iterable[str]) -> DataFrame:
    chosen = sorted(set(types or ()) or set(default))
    return g.steps().filter(F.col("type").isin(chosen))


def forward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("near"), F.col("target").alias("far"), "type", "seq")


def backward(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("near"), F.col("source").alias("far"), "type", "seq")


def _described(g: CodeGraph, nodes: DataFrame) -> DataFrame:
    nodes = stage(nodes, "described")
    names = g.about(nodes.select("id").distinct()).select("id", "type", "name", "file")
    out = nodes.join(names, "id", "left")
    return out.withColumns({"type": F.coalesce("type", F.lit("unknown")), "name": F.coalesce("name", "id"), "file": F.coalesce("file", F.lit(""))})


def impact_of(g: CodeGraph, text: str, depth: int = 3, limit: int = 200, types: Iterable[str] | None = None) -> DataFrame:
    """(distance, via, id, type, name, file): what reaches the symbol within ``depth`` steps back. The first ``limit`` in
    order of discovery, then by (distance, type, id); via is the type of the edge of discovery."""
    ids = resolve_ids(g, text)
    reached = levels(backward(_typed(g, types, DEFAULT_IMPACT_TYPES)), _seeds(g.symbols.sparkSession, ids), depth, limit)
    first = reached.filter(F.col("depth") > 0).orderBy("depth", "key").limit(limit)
    rows = _described(g, first).select(F.col("depth").alias("distance"), "via", "id", "type", "name", "file")
    return rows.orderBy("distance", "type", "id")


def shortest_path(g: CodeGraph, source: str, target: str, types: Iterable[str] | None = None, max_depth: int = 12) -> DataFrame:
    """(step, edge, id, type, name, file) of the first shortest way from one of the sources to one of the targets; no
    rows without a way of at most ``max_depth`` edges. The source has an empty edge."""
    spark = g.symbols.sparkSession
    sources, targets = list(dict.fromkeys(resolve_ids(g, source))), resolve_ids(g, target)
    ends = spark.createDataFrame([(i,) for i in targets], "id string")
    edges = _typed(g, types, DEFAULT_PATH_TYPES)
    reached = levels(forward(edges), _seeds(spark, sources), max_depth, until=ends)
    best = reached.join(ends, "id", "left_semi").orderBy("depth", "key").limit(1)
    starts = spark.createDataFrame(list(enumerate(sources)), "seq long, id string")
    steps = best.select(F.posexplode("key").alias("step", "seq"))
    first = steps.filter("step = 0").join(starts, "seq").select("step", F.lit("").alias("edge"), "id")
    rest = edges.join(steps.filter("step > 0"), "seq").select("step", F.col("type").alias("edge"), F.col("target").alias("id")).distinct()
    return _described(g, first.unionByName(rest)).select("step", "edge", "id", "type", "name", "file").orderBy("step")


def undirected(edges: DataFrame) -> DataFrame:
    return forward(edges).unionByName(backward(edges))


def related_files(g: CodeGraph, file: str, depth: int = 2, limit: int = 100) -> DataFrame:
    """(file): files of symbols within ``depth`` steps of the file's symbols over edges of any type either way, the file
    itself too, in order of name; none for an unknown file."""
    seeds = g.where(F.col("file") == file).select("id", F.array(F.lit(0).cast("long")).alias("key"), F.lit(0).alias("depth"), F.lit("").alias("via"))
    reached = levels(undirected(g.steps()), seeds, max(0, depth))
    files = g.about(reached.select("id")).filter(F.length("file") > 0).select("file").distinct()
    return files.orderBy("file").limit(limit)


def neighbourhood(g: CodeGraph, text: str, depth: int = 2, limit: int = 120) -> tuple[DataFrame, DataFrame]:
    """Rows (id, label, type, file, language) and edges (source, target, type, confidence) about a symbol. The nearest
    ``limit`` nodes by (distance, id) count, seeds too; nodes without a symbol give no row; of parallel edges of a type the
    first stays."""
    ids = resolve_ids(g, text)
    reached = levels(undirected(g.steps()), _seeds(g.symbols.sparkSession, ids), depth, limit)
    near = stage(reached.orderBy("depth", "id").limit(limit).select("id"), "near")
    rows = g.about(near).select("id", F.col("name").alias("label"), "type", F.coalesce("file", F.lit("")).alias("file"), "language").orderBy("id")
    ends = g.steps().join(near.select(F.col("id").alias("source")), "source", "left_semi").join(near.select(F.col("id").alias("target")), "target", "left_semi")
    kept = ends.groupBy("source", "target", "type").agg(F.min(F.struct("seq", "confidence")).alias("m"))
    return rows, kept.select("source", "target", "type", F.col("m.confidence").alias("confidence"))
