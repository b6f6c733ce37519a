"""Parent-child rows to whole hierarchies: root, depth, path and descendants of every node, and what cycles keep rootless."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import partitions_for, small_enough, stage
from .keyed_tree import edge_type

#: Nodes that one partition contracts at a time.
PART_NODES = 200_000
#: Nodes of a quotient that one task solves; above it the quotient is contracted again.
LAST_NODES = 200_000

_LOCAL = "id string, next string, entry string, frag long, exit string, hops long, st string, root string, depth long, up array<string>"


def _contract(paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = pd.concat(list(batches) or [pd.DataFrame()], ignore_index=True)
        n = len(b)
        if not n:
            return
        ids = b["id"].to_numpy()
        nxt = pd.Index(ids).get_indexer(pd.Index(b["next"].to_numpy(dtype=object)))
        nxt[b["next"].isna().to_numpy()] = -1
        stop = nxt < 0
        to = np.where(stop, np.arange(n), nxt)
        hops = np.where(stop, 0, b["w"].to_numpy())
        first = to.copy()
        for _ in range(max(1, int(n).bit_length())):
            hops = hops + hops[to]
            to = to[to]
        looped = ~stop[to]
        st = np.where(looped, "B", "X").astype(object)
        st[np.unique(to[looped])] = "C"  # after more steps than there are nodes exactly the nodes of cycles are reached
        ends = b["next"].isna().to_numpy()[to] & ~looped
        mark = b["mark"].to_numpy()[to] == 1
        st[ends & mark] = "B"
        st[ends & ~mark] = "T"
        done = st == "T"
        up: list = [None] * n
        if paths:
            order = np.argsort(np.where(looped, -1, hops), kind="stable")
            seg = b["seg"].to_numpy()
            for i in order:
                if looped[i]:
                    continue
                up[i] = (list(seg[i]) if ends[i] and seg[i] is not None else []) if stop[i] else [*seg[i], *up[first[i]]]
        yield pd.DataFrame(
            {
                "id": ids,
                "next": b["next"],
                "entry": b["entry"],
                "frag": b["frag"],
                "exit": np.where(looped, None, ids[to]),
                "hops": hops,
                "st": st,
                "root": np.where(done, b["root"].to_numpy()[to], None),
                "depth": np.where(done, hops + b["base"].to_numpy()[to], -1),
                "up": up,
            }
        )

    return run


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes on the local chains from marked nodes to their exits."""
    b = pd.concat(list(batches) or [pd.DataFrame()], ignore_index=True)
    if not len(b):
        return
    follow = dict(zip(b["id"], b["next"]))
    seen: set[str] = set()
    for x in b.loc[b["marked"], "id"]:
        while x is not None and x in follow and x not in seen:
            seen.add(x)
            x = follow[x]
    yield pd.DataFrame({"id": list(seen)}, dtype=object)


def _solve(nodes: DataFrame, rows: int, level: int, paths: bool) -> DataFrame:
    """(id, next, entry, st, root, depth, up) for the nodes of a functional graph; st: T has a root, C on a cycle, B below.

    nodes: as _NODE, unique id; next is null at the ends, which hold root, base (depth) and mark (below a cycle).
    """
    spark = nodes.sparkSession
    last = rows <= LAST_NODES
    parts = 1 if last else partitions_for(spark, rows, PART_NODES)
    # coarser fragments at every level: chains that left theirs before meet their parents again
    frag = F.lit(0).cast("long") if last else F.pmod(F.xxhash64(locality(F.col("id"), level)), F.lit(parts))
    if not last:  # pieces of a module that alone has more nodes than a partition should; there are at most rows / PART_NODES
        heavy = nodes.groupBy(locality(F.col("id"), level).alias("loc")).count().filter(F.col("count") > PART_NODES).select("loc", F.lit(True).alias("heavy"))
        heavy = F.broadcast(heavy) if small_enough(heavy) else heavy
        nodes = nodes.withColumn("loc", locality(F.col("id"), level)).join(heavy, "loc", "left").drop("loc")
        frag = F.when(F.col("heavy"), F.pmod(F.xxhash64("id", F.lit(level)), F.lit(parts))).otherwise(frag)
        nodes = nodes.withColumn("frag", frag).drop("heavy")
    else:
        nodes = nodes.withColumn("frag", frag)
    local = stage(nodes.repartitionById(parts, F.col("frag").cast("int")).mapInPandas(_contract(paths), _LOCAL), f"forest-{level}")
    pending = local.filter((F.col("st") == "X") & (F.col("id") == F.col("exit")))
    count = pending.count()
    known = local.filter(F.col("st") != "X").select("id", "next", "entry", "st", "root", "depth", "up")
    if not count:
        return known
    to = local.select(F.col("id").alias("next"), F.col("st").alias("pst"), F.col("exit").alias("pexit"), F.col("hops").alias("phops"), F.col("root").alias("proot"), F.col("depth").alias("pdepth"), F.col("up").alias("pup"))
    far = F.col("pst") == "X"
    seg = F.when(F.col("pup").isNotNull(), F.concat(F.array("next"), F.col("pup"))) if paths else F.lit(None).cast("array<string>")
    weight = nodes.select("id", "w", F.col("seg").alias("own"))
    if paths:
        seg = F.when(F.col("pup").isNotNull(), F.concat("own", "pup"))
    child = (
        pending.select("id", "next")
        .join(weight, "id")
        .join(to, "next")
        .select(
            "id",
            F.when(far, F.col("pexit")).alias("next"),
            F.when(far, F.col("w") + F.col("phops")).otherwise(0).alias("w"),
            F.col("proot").alias("root"),
            F.when(F.col("pst") == "T", F.col("w") + F.col("pdepth")).otherwise(-1).alias("base"),
            F.when(F.col("pst").isin("C", "B"), 1).otherwise(0).alias("mark"),
            F.when(far, F.col("next")).alias("entry"),
            seg.alias("seg"),
        )
    )
    child = stage(child, f"forest-quotient-{level}")
    if count > LAST_NODES and count > 0.8 * rows and level > 2:
        solved = _double(child, paths)
    else:
        solved = stage(_solve(child, count, level + 1, paths), f"forest-solved-{level}")
    s = solved.select(F.col("id").alias("exit"), F.col("st").alias("sst"), F.col("root").alias("sroot"), F.col("depth").alias("sdepth"), F.col("up").alias("sup"))
    open_ = local.filter(F.col("st") == "X").join(s, "exit")
    ring = solved.filter(F.col("st") == "C")
    on_ring = None
    if not ring.isEmpty():
        # a cycle runs through a fragment from the node that a ring exit before enters to the ring exit
        entries = ring.select(F.col("entry").alias("id")).withColumn("marked", F.lit(True))
        chains = open_.filter(F.col("sst") == "C").select("id", "next", "frag").join(entries.distinct(), "id", "left")
        chains = chains.withColumn("marked", F.coalesce("marked", F.lit(False)))
        on_ring = chains.repartitionById(parts, F.col("frag").cast("int")).mapInPandas(_walk, "id string").withColumn("ring", F.lit(True))
    up = F.concat("up", "sup") if paths else F.lit(None).cast("array<string>")
    opened = open_.join(on_ring, "id", "left") if on_ring is not None else open_.withColumn("ring", F.lit(None).cast("boolean"))
    opened = opened.select(
        "id", "next", "entry",
        F.when(F.col("sst") == "T", "T").when(F.col("ring"), "C").otherwise("B").alias("st"),
        F.col("sroot").alias("root"),
        F.when(F.col("sst") == "T", F.col("hops") + F.col("sdepth")).otherwise(-1).alias("depth"),
        F.when(F.col("sst") == "T", up).alias("up"),
    )
    return known.unionByName(opened)


def _double(nodes: DataFrame, paths: bool) -> DataFrame:
    """As _solve, by pointer doubling over joins, for graphs that fragments do not contract: each round halves what is left
    of every chain. Nodes still on their way after more steps than there are nodes hang on a cycle; those that are reached
    then are on it."""
    n = nodes.count()
    state = nodes.select("id", F.coalesce("next", "id").alias("to"), "w", F.col("next").isNull().alias("end"), F.col("seg").alias("up"))
    for k in range(n.bit_length() + 2):  # one more to see that the end is one
        o = state.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("w").alias("w2"), F.col("end").alias("end2"), F.col("up").alias("up2"))
        step = state.filter(~F.col("end")).join(o, "to")
        up = F.when(F.col("end2") & (F.col("to") == F.col("to2")), F.col("up")).otherwise(F.concat("up", "up2")) if paths else F.col("up")
        moved = step.select("id", F.col("to2").alias("to"), (F.col("w") + F.when(F.col("end2") & (F.col("to") == F.col("to2")), 0).otherwise(F.col("w2"))).alias("w"), (F.col("end2") & (F.col("to") == F.col("to2"))).alias("end"), up.alias("up"))
        state = stage(state.filter("end").unionByName(moved), f"forest-double-{k}")
        if state.filter(~F.col("end")).isEmpty():
            break
    ends = nodes.filter(F.col("next").isNull()).select(F.col("id").alias("to"), "root", "base", "mark", F.col("seg").alias("eseg"))
    ringed = state.filter(~F.col("end")).select(F.col("to").alias("id")).distinct().withColumn("ring", F.lit(True))
    out = state.join(ends, "to", "left").join(ringed, "id", "left").join(nodes.select("id", "next", "entry"), "id")
    good = F.col("end") & (F.col("mark") == 0)
    up = F.when(F.col("id") == F.col("to"), F.coalesce("eseg", F.array().cast("array<string>"))).otherwise(F.concat("up", F.coalesce("eseg", F.array().cast("array<string>")))) if paths else F.lit(None).cast("array<string>")
    return out.select("id", "next", "entry", F.when(good, "T").when(F.col("ring"), "C").otherwise("B").alias("st"), F.when(good, F.col("root")).alias("root"), F.when(good, F.when(F.col("id") == F.col("to"), 0).otherwise(F.col("w")) + F.col("base")).otherwise(-1).alias("depth"), F.when(good, up).alias("up"))


def locality(id_: Column, level: int) -> Column:
    """What fragments of a level go by: the module of an id, then ever fewer leading parts of it."""
    module = F.substring_index(F.substring_index(id_, "://", -1), ":", 1)
    return module if level == 0 else F.substring_index(module, ".", max(1, 4 - level))


def hierarchy(links: DataFrame, child: Column, parent: Column, order: list[Column], with_paths: bool = False) -> DataFrame:
    """Every node of parent-child rows: id, parent, root, depth (and path: ids from the root to the node).

    Rows with a null end are left out. A node's parent is that of its row with the greatest ``order``, on ties the
    greatest parent. Without a parent a node is its own root at depth 0. Nodes that never reach a root have an empty root,
    a null path and depth -1 on a cycle (a node that is its own parent too), -2 below one.

    Partition-local chains are contracted to the exits of their partition, the quotient forest of the exits is solved in
    the same way with coarser partitions until one task can hold it, then expanded. Fragments follow the ids' modules, so
    most chains are short of exits; a module beyond the partition size is cut by hash, and a quotient that does not
    shrink is solved by pointer doubling, so neither depth nor skew is limited.
    """
    ok = links.filter(child.isNotNull() & parent.isNotNull())
    up = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], parent.alias("parent"))
    pairs = ok.select(F.explode(F.array(F.struct(child.alias("id"), up.alias("up")), F.struct(parent.alias("id"), F.lit(None).cast(ok.select(up.alias("u")).schema["u"].dataType).alias("up")))).alias("x")).select("x.*")
    own = pairs.groupBy("id").agg(F.max("up").alias("up")).select("id", F.col("up.parent").alias("parent"))
    empty = F.lit(None).cast("array<string>")
    seg = F.when(F.col("parent").isNotNull(), F.array("parent")) if with_paths else empty
    nodes = stage(own.select("id", F.col("parent").alias("next"), F.lit(1).cast("long").alias("w"), F.when(F.col("parent").isNull(), F.col("id")).alias("root"), F.lit(0).cast("long").alias("base"), F.lit(0).alias("mark"), F.lit(None).cast("string").alias("entry"), seg.alias("seg")), "forest-nodes")
    solved = _solve(nodes, nodes.count(), 0, with_paths)
    t = F.col("st") == "T"
    out = [
        F.col("id"),
        F.col("next").alias("parent"),
        F.when(t, F.col("root")).otherwise("").alias("root"),
        F.when(t, F.col("depth")).when(F.col("st") == "C", -1).otherwise(-2).cast("int").alias("depth"),
    ]
    if with_paths:
        out.append(F.when(t, F.reverse(F.concat(F.array("id"), "up"))).alias("path"))
    return solved.select(*out)


def containment(edges: DataFrame, with_paths: bool = False) -> DataFrame:
    """The hierarchy of the CONTAINS rows of ``edges``; the latest row of a target names its parent."""
    rows = edges.filter(edge_type(edges["type"]) == "CONTAINS")
    return hierarchy(rows, edges["target"], edges["source"], [edges["indexed_at"], edges["edge_id"]], with_paths)


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of all rooted nodes; nodes: as hierarchy(with_paths=True) gives them."""
    x = nodes.filter(F.col("path").isNotNull()).select("id", "depth", F.posexplode("path").alias("at", "ancestor"))
    return x.filter(F.col("at") < F.col("depth")).select("ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))


def descendant_counts(nodes: DataFrame) -> DataFrame:
    """(id, root, depth, path, n_descendants) of all nodes; path joined by ' > ', null and 0 for rootless nodes."""
    # leaves are first counted at their parents, so only parents' paths are taken apart
    sizes = nodes.filter(F.col("path").isNotNull() & (F.col("depth") > 0)).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    n = nodes.join(sizes, "id").select(F.explode("path").alias("id"), "n").groupBy("id").agg(F.sum("n").alias("n_descendants"))
    return nodes.join(n, "id", "left").select("id", "root", "depth", F.array_join("path", " > ").alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))
