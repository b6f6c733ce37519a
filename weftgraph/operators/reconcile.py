"""Differences between two copies of a table by set reconciliation, then field by field."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import field61 as gf
from ..functions.keys import with_call_ends
from ..runtime import stage

#: Points of every sketch that only verify a recovered difference; a wrong one passes with a chance of about 2**-120.
CHECKS = 2
#: Rows of one side that a bucket has on average.
BUCKET_ROWS = 48


def latest(df: DataFrame, key: Column, when: Column, tie: Column, fields: dict[str, Column]) -> DataFrame:
    """For each key its row with the greatest (when, tie): columns key and the fields. Nulls order first. Partial maxima
    are taken before the shuffle, so a key with many versions sends one row a task."""
    row = F.struct(when.alias("w"), tie.alias("t"), *[c.alias(f"f{i}") for i, c in enumerate(fields.values())])
    best = df.select(key.alias("key"), row.alias("row")).groupBy("key").agg(F.max("row").alias("row"))
    return best.select("key", *[F.col(f"row.f{i}").alias(n) for i, n in enumerate(fields)])


def _sketch(points: int):
    xs = np.arange(1, points + CHECKS + 1, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            b = b.sort_values(["bucket", "side"], kind="stable")
            code = b["bucket"].to_numpy() * 2 + b["side"].to_numpy()
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            e = gf.elements(b["h"].to_numpy())
            v = gf.sub(np.broadcast_to(xs, (len(e), len(xs))), np.broadcast_to(e[:, None], (len(e), len(xs))))
            prod = gf.products_by_group(v, starts)
            sizes = np.diff(np.append(starts, len(b)))
            yield pd.DataFrame({"bucket": code[starts] // 2, "side": code[starts] % 2, "n": sizes, "at": [row.view(np.int64) for row in prod]})

    return run


def _recover(points: int):
    width = points + CHECKS
    xs = list(range(1, width + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for bucket, sides, ns, ats in zip(b["bucket"], b["sides"], b["ns"], b["ats"]):
                n, at = [0, 0], [[1] * width, [1] * width]
                for s, k, a in zip(sides, ns, ats):
                    n[s] += int(k)
                    at[s] = [x * int(y) % gf.P for x, y in zip(at[s], a)]
                if at[0] == at[1] and n[0] == n[1]:
                    continue
                ratio = [x * pow(y, -1, gf.P) % gf.P for x, y in zip(*at)]
                pq = gf.rational(xs[:points], ratio[:points], n[0] - n[1], list(zip(xs[points:], ratio[points:])))
                p, q = pq or (None, None)
                out.append((bucket, pq is not None, p, q))
            yield pd.DataFrame(out, columns=["bucket", "done", "p", "q"])

    return run


def _roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if not len(b):
            yield b[["side", "key"]]
            continue
        lists = b["poly"].to_numpy()
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        c = np.zeros((len(b), size.max()), dtype=np.uint64)
        c[np.arange(size.max()) < size[:, None]] = np.concatenate(lists).astype(np.int64).view(np.uint64)
        zero = gf.horner(c, gf.elements(b["h"].to_numpy())) == 0
        yield b.loc[zero, ["side", "key"]]


def differing_keys(left: DataFrame, right: DataFrame, fields: list[str], first_bound: int = 8) -> DataFrame:
    """(side, key) of the rows of ``left`` (side 0) and ``right`` (side 1) that the other side hasn't as they are.

    Both have unique ``key`` and the ``fields``. A row is a hash, an element of a field of 2**61 - 1 elements; the rows
    of a bucket are a set, its sketch the values of its characteristic polynomial at fixed points. The quotient of both
    sides' sketches is a rational function whose zeros and poles are the differing rows: it is interpolated under a bound on
    its degree, verified at further points, and where that fails, the bound is doubled and only those buckets are
    sketched again. A bound of the bucket's rows always succeeds, so the rounds end. Buckets are by the hash of unique
    keys and about equal; their number grows with the rows. Rows of equal key have equal bucket.
    """
    spark = left.sparkSession
    both = left.select(F.lit(0).alias("side"), "key", *fields).unionByName(right.select(F.lit(1).alias("side"), "key", *fields))
    # nulls are told from values by a flag, as a hash skips them
    parts = [x for f in fields for x in (F.col(f).isNull(), F.col(f))]
    hashed = stage(both.select("side", "key", F.xxhash64("key", *parts).alias("h"), F.xxhash64("key").alias("b")), "reconcile-rows")
    rows = hashed.count()
    buckets = max(1, rows // (2 * BUCKET_ROWS))
    hashed = hashed.select("side", "key", "h", F.pmod("b", F.lit(buckets)).alias("bucket"))
    found, todo, bound = None, None, first_bound
    while True:
        part = hashed.select("bucket", "side", "h")
        if todo is not None:
            part = part.join(todo, "bucket", "left_semi")
        sketch = (
            part.repartition("bucket").sortWithinPartitions("bucket", "side").mapInPandas(_sketch(bound), "bucket long, side int, n long, at array<long>")
        )
        # a bucket may begin in one Arrow batch and end in the next: the products of its pieces are multiplied here
        merged = sketch.groupBy("bucket").agg(F.collect_list(F.struct("side", "n", "at")).alias("s"))
        merged = merged.select("bucket", F.col("s.side").alias("sides"), F.col("s.n").alias("ns"), F.col("s.at").alias("ats"))
        solved = stage(merged.mapInPandas(_recover(bound), "bucket long, done boolean, p array<long>, q array<long>"), "reconcile-polynomials")
        good = solved.filter("done").select("bucket", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("p").alias("poly")), F.struct(F.lit(1).alias("side"), F.col("q").alias("poly")))).alias("x")).select("bucket", "x.*").filter(F.size("poly") > 1)
        found = good if found is None else found.unionByName(good)
        open_ = solved.filter(~F.col("done")).select("bucket")
        if open_.isEmpty():
            break
        todo, bound = open_, bound * 2
    key_type = hashed.schema["key"].dataType.simpleString()
    return hashed.join(found, ["bucket", "side"]).select("side", "key", "h", "poly").mapInPandas(_roots, f"side int, key {key_type}")


def field_differences(left: DataFrame, right: DataFrame, fields: list[str], only_left: str, only_right: str) -> DataFrame:
    """(key, diff): each key of only one side with the name for that, and for keys of both sides each field that differs.
    Two nulls are equal, null and a value differ. Only rows whose hashes were recovered are fetched and compared."""
    keys = stage(differing_keys(left, right, fields), "reconcile-keys")
    some = keys.select("key").distinct()
    a = left.join(some, "key", "left_semi").select("key", F.struct(*fields).alias("a"))
    b = right.join(some, "key", "left_semi").select("key", F.struct(*fields).alias("b"))
    each = [F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]
    diff = F.when(F.col("b").isNull(), F.array(F.lit(only_left))).when(F.col("a").isNull(), F.array(F.lit(only_right))).otherwise(F.array_compact(F.array(*each)))
    return a.join(b, "key", "full_outer").select("key", F.explode(diff).alias("diff"))


def call_site_differences(observed: DataFrame, inferred: DataFrame) -> DataFrame:
    """(site_id, diff) between the current rows of two copies of call sites.

    diff: only_observed, only_inferred, caller, callee, file or line. The current row of a site has the greatest time,
    on ties the greatest number. Rows with a null site_id name no site and are left out.
    """

    def current(df: DataFrame, when: str, tie: str) -> DataFrame:
        # ends are read after the current rows are known: once a site, where the reading's parts are worked out once
        raw = latest(df.filter(df["site_id"].isNotNull()), df["site_id"], df[when], df[tie], {c: df[c] for c in ("caller", "callee", "file", "line")})
        return with_call_ends(raw, {"caller": True, "callee": False})

    a, b = stage(current(observed, "recorded_at", "obs_id"), "sites-a"), stage(current(inferred, "indexed_at", "edge_no"), "sites-b")
    return field_differences(a, b, ["caller", "callee", "file", "line"], "only_observed", "only_inferred").withColumnRenamed("key", "site_id")


def call_site_difference_counts(observed: DataFrame, inferred: DataFrame) -> DataFrame:
    """diff, n_sites."""
    return call_site_differences(observed, inferred).groupBy("diff").agg(F.count("*").alias("n_sites"))
