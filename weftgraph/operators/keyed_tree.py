"""Per-key counts that no hot key can unbalance: a tree of partial states instead of one reducer for a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stage

#: Rows of an input chunk that is combined by itself, and states that are merged at a time.
CHUNK, FAN_IN = 1_000_000, 8
#: Keys of a summary: a key with more than 1 in SUMMARY + 1 of all rows is in it.
SUMMARY = 1000
#: Rows of a hot key that one task is to deduplicate.
LEAF = 200_000

_STATE = "slot long, k1 long, k2 long, n long, depth int"


def hash2(c: Column) -> tuple[Column, Column]:
    """Two hashes of 64 bits from different seeds; null for null."""
    return F.when(c.isNotNull(), F.xxhash64(c)), F.when(c.isNotNull(), F.xxhash64(F.lit(1), c))


def key_hash(cols: list[Column]) -> tuple[Column, Column]:
    """Two hashes of a key; a null part is a part like others."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)


def _summary(k1: np.ndarray, k2: np.ndarray, n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At most ``most`` counters (Misra and Gries): the sums less the greatest count that is left out, where above 0."""
    order = np.lexsort((k2, k1))
    k1, k2, n = k1[order], k2[order], n[order]
    at = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if len(k1) else np.zeros(0, int)
    n = np.add.reduceat(n, at) if len(at) else n
    k1, k2 = k1[at], k2[at]
    if len(n) > most:
        n = n - np.partition(n, len(n) - most - 1)[len(n) - most - 1]
    keep = n > 0
    return k1[keep], k2[keep], n[keep]


def frequent_keys(df: DataFrame, cols: list[Column], most: int = SUMMARY) -> DataFrame:
    """(k1, k2): hashes of at most ``most`` keys, among them each with more than 1 in ``most`` + 1 of all rows.

    Chunks of CHUNK input rows are summed up where they lie; their summaries of bounded size go up a tree of FAN_IN, so
    neither the number of keys nor a hot key burdens a task.
    """
    h1, h2 = key_hash(cols)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        rows = 0

        def out() -> pd.DataFrame:
            k1, k2 = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("k1", "k2"))
            k1, k2, n = _summary(k1, k2, np.ones(len(k1), dtype=np.int64), most)
            return pd.DataFrame({"slot": slot, "k1": k1, "k2": k2, "n": n, "depth": 0})

        slot = 0
        for b in batches:
            if not len(b):
                continue
            slot = int(b["part"].iloc[0])
            held.append(b)
            rows += len(b)
            if rows >= CHUNK:
                yield out()
                held, rows = [], 0
        if held:
            yield out()

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        k1, k2, n = _summary(part["k1"].to_numpy(), part["k2"].to_numpy(), part["n"].to_numpy(), most)
        return pd.DataFrame({"slot": part["slot"].iloc[0] // FAN_IN, "k1": k1, "k2": k2, "n": n, "depth": 0})

    parts = input_parts(df)
    state = df.select(h1.alias("k1"), h2.alias("k2"), F.spark_partition_id().cast("long").alias("part")).mapInPandas(leaves, _STATE)
    while True:
        state = state.groupBy(F.floor(F.col("slot") / FAN_IN)).applyInPandas(merge, _STATE)
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            return stage(state.select("k1", "k2"), "frequent-keys")


def input_parts(df: DataFrame) -> int:
    """Partitions of a scan, of which each is a chunk of bounded size (spark.sql.files.maxPartitionBytes)."""
    return max(1, df.rdd.getNumPartitions())


def _rounds(state: DataFrame, by: list[str], slots: int, sums: list[str], fan_in: int) -> DataFrame:
    """The sums of ``by`` from states in ``slot`` 0 to ``slots`` - 1, ``fan_in`` neighbours at a time."""
    while True:
        slots = -(-slots // fan_in)
        at = [F.floor(F.col("slot") / fan_in).alias("slot")] if slots > 1 else []
        state = state.groupBy(*by, *at).agg(*[F.sum(c).alias(c) for c in sums])
        if slots <= 1:
            return state


def counted(df: DataFrame, names: list[str], n: str, slots: int, fan_in: int = FAN_IN) -> DataFrame:
    """Rows of each key: every one of ``slots`` input partitions sums up its own rows, ``fan_in`` neighbours at a time merge."""
    return _rounds(df.select(*names, F.lit(1).cast("long").alias(n), F.spark_partition_id().alias("slot")), names, slots, [n], fan_in)


def keyed_counts(
    df: DataFrame,
    keys: dict[str, Column],
    distinct: dict[str, Column],
    count_as: str = "n_rows",
    chunks: int | None = None,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Rows and distinct values for each key, combined as a tree.

    Leaves: input partitions combine their own rows. A key with more than 1 in SUMMARY of all rows (found by
    frequent_keys) is split into ``chunks`` by the hash of the counted value, as many as make a leaf of about LEAF rows, so
    a value is in one chunk and distinct counts of chunks add up exactly; other keys are one chunk. Rounds: each merges
    the states of ``fan_in`` neighbouring chunks until one state for a key is left, so no reducer gets more than
    ``fan_in`` states of a key and upstream task. Only hashes of keys go through the tree; their text is joined at the end.

    keys: name and expression of the key's columns. distinct: name and expression of each value whose distinct non-null
    values are counted. A null key is a key of its own; null values count as rows, not as values; no rows give no keys.
    Keys and values are compared by 128 bits of hash.
    """
    if (chunks is not None and chunks < 1) or fan_in < 2:
        raise ValueError("chunks must be 1 or more and fan_in 2 or more")
    names = list(keys)
    cols = [keys[n] for n in names]
    if chunks is None:
        chunks = max(1, -(-df.count() // LEAF))
    k1, k2 = key_hash(cols)
    base = df.select(k1.alias("k1"), k2.alias("k2"), *[c.alias(f"v{i}") for i, c in enumerate(distinct.values())])
    facets = []
    for i in range(max(1, len(distinct))):
        h1, h2 = hash2(F.col(f"v{i}")) if distinct else (F.lit(None).cast("long"),) * 2
        facets.append(F.struct(F.lit(i).alias("facet"), h1.alias("h1"), h2.alias("h2"), F.lit(1 if i == 0 else 0).cast("long").alias("n")))
    rows = base.select("k1", "k2", F.explode(F.array(*facets)).alias("x")).select("k1", "k2", "x.*")
    by, sums = ["k1", "k2"], ["n", *[f"d{i}" for i in range(len(distinct))]]
    each = [F.when(F.col("facet") == i, F.col("d")).otherwise(0).alias(f"d{i}") for i in range(len(distinct))]

    def states(rows: DataFrame, *at: str) -> DataFrame:
        return rows.groupBy(*by, "facet", *at).agg(F.count_distinct("h1", "h2").alias("d"), F.sum("n").alias("n")).select(*by, *at, "n", *each)

    if chunks > 1:
        hot = F.broadcast(frequent_keys(df, cols))  # at most SUMMARY rows
        # a null value must not gather all rows of a key in one chunk, so such rows follow the input partition
        slot = F.pmod(F.coalesce(F.col("h1"), F.spark_partition_id().cast("long")), F.lit(chunks)).alias("slot")
        split = states(rows.join(hot, by, "left_semi").select("*", slot), "slot")
        out = states(rows.join(hot, by, "left_anti")).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums]).unionByName(_rounds(split, by, chunks, sums, fan_in))
    else:
        out = states(rows).groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
    text = df.select(k1.alias("k1"), k2.alias("k2"), *[c.alias(f"t{i}") for i, c in enumerate(cols)]).dropDuplicates(["k1", "k2"])
    out = out.join(text, by)
    return out.select(*[F.col(f"t{i}").alias(n) for i, n in enumerate(names)], F.col("n").alias(count_as), *[F.col(f"d{i}").alias(n) for i, n in enumerate(distinct)])


def edge_type(c: Column) -> Column:
    """An edge type as it is read: without white space around it, in upper case."""
    return F.upper(F.btrim(c, F.lit(" \t\r\n\x0b\x0c")))


def edge_key_counts(edges: DataFrame) -> DataFrame:
    """(type, target): n_edges, n_sources, n_files of ``edges``."""
    return keyed_counts(
        edges,
        {"type": edge_type(edges["type"]), "target": edges["target"]},
        {"n_sources": edges["source"], "n_files": edges["file"]},
        count_as="n_edges",
    )


def heavy_edge_keys(edges: DataFrame, percent: float = 1.0) -> DataFrame:
    """Keys (type, target) with a target and at least ``percent`` (above 0) of all rows of ``edges``. The total is read from
    the table's footers; the keys that can have so much come from the tree of summaries and are counted exactly by a tree."""
    if percent <= 0:
        raise ValueError("percent must be above 0")
    total = edges.count()
    cols = [edge_type(edges["type"]), edges["target"]]
    h1, h2 = key_hash(cols)
    may = frequent_keys(edges, cols, int(100 / percent) + 1)
    some = edges.select(h1.alias("k1"), h2.alias("k2"), *[c.alias(n) for c, n in zip(cols, ("type", "target"))]).filter(F.col("target").isNotNull())
    some = some.join(F.broadcast(may), ["k1", "k2"], "left_semi")  # at most 100 / percent + 1 rows
    n = counted(some, ["type", "target"], "n", input_parts(edges))
    return n.filter(F.col("n") * 100 >= F.lit(float(percent * total))).select("type", "target")
