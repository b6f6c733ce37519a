"""References to rows that do not exist, do not exist any more or do not exist yet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bloom
from ..runtime import small_enough, stage
from .keyed_tree import frequent_keys, key_hash

#: Parts of the references of a hot id.
SALTS = 32
#: The end of what still lives, after all other times.
EVER = "9999-12-31 23:59:59.999999"


def references(df: DataFrame, table: str, row_id: Column, when: Column, fields: dict[str, Column]) -> DataFrame:
    """(tbl, row_id, field, ref, at): one row for each non-null reference in ``fields`` of each row."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), c.alias("ref")) for f, c in fields.items()])
    return (
        df.select(row_id.alias("row_id"), when.alias("at"), F.explode(each).alias("x"))
        .select(F.lit(table).alias("tbl"), "row_id", "x.field", "x.ref", "at")
        .filter(F.col("ref").isNotNull())
    )


def orphan_references(refs: DataFrame, parents: DataFrame, always: DataFrame) -> DataFrame:
    """(tbl, period, row_id, field, reason), distinct: the references ``refs`` that did not hold at their time.

    parents: (id, start, stop), a row for each time that a parent lived, stop exclusive, null while it lives. always: (id),
    parents that always live. reason: missing if no parent has the id, late if all of the id's rows start after the
    reference, else deleted. A reference of unknown time holds only for parents that always live; its reason is missing
    or deleted and its period null. Null ids of parents match nothing. Ids are compared by 128 bits of hash.

    Broadcast Bloom filters of all parent ids, as many as the ids need and each of bounded size, prove most orphans missing
    where they lie, hot ones too; each filter is a pass over the references of its slice of the hashes. What passes meets
    the lives by the exact id: references and lives of an id are sorted by time together and the latest end so far tells
    whether one lives, so no reference is compared with every life. Ids with more than 1 in SUMMARY of the references are
    split into SALTS parts, each with the id's lives.
    """
    spark = refs.sparkSession
    h1, h2 = bloom.hashes(F.col("ref"))
    refs = refs.select("tbl", "row_id", "field", "at", h1.alias("h1"), h2.alias("h2"))
    p1, p2 = bloom.hashes(F.col("id"))
    lives = parents.filter(F.col("id").isNotNull() & F.col("start").isNotNull()).select(p1.alias("h1"), p2.alias("h2"), "start", F.coalesce("stop", F.lit(EVER).cast(parents.schema["stop"].dataType)).alias("stop"))
    lives = stage(lives.groupBy("h1", "h2", "start").agg(F.max("stop").alias("stop")), "parents")
    fixed = always.filter(F.col("id").isNotNull()).select(p1.alias("h1"), p2.alias("h2")).distinct()
    open_ = refs.join(F.broadcast(fixed) if small_enough(fixed) else fixed, ["h1", "h2"], "left_anti")
    keys = lives.select("h1", "h2").distinct()
    rows = lives.count()  # at least as many as ids
    n = bloom.slices(rows)
    slice_ = F.pmod(F.shiftright("h1", 20), F.lit(n))
    passed, certain = [], []
    for k in range(n):
        words = bloom.build(keys.filter(slice_ == k), "h1", "h2", -(-rows // n))
        own = open_.filter(slice_ == k) if n > 1 else open_
        tested = own.withColumn("maybe", bloom.might_contain(spark.sparkContext.broadcast(words), F.col("h1"), F.col("h2")))
        passed.append(tested.filter("maybe").drop("maybe"))
        certain.append(tested.filter(~F.col("maybe")).select("tbl", "row_id", "field", "at", F.lit("missing").alias("reason")))
    passed, certain = reduce(DataFrame.unionByName, passed), reduce(DataFrame.unionByName, certain)

    hot = frequent_keys(refs, [F.col("h1"), F.col("h2")])  # at most SUMMARY rows
    k1, k2 = key_hash([F.col("h1"), F.col("h2")])
    hot = F.broadcast(hot.select(F.col("k1").alias("hot1"), F.col("k2").alias("hot2")))
    is_hot = (k1 == F.col("hot1")) & (k2 == F.col("hot2"))
    spread = passed.join(hot, is_hot, "left").withColumn("salt", F.when(F.col("hot1").isNotNull(), F.pmod(F.xxhash64("row_id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    salts = F.when(F.col("hot1").isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copies = lives.join(hot, is_hot, "left").withColumn("salt", F.explode(salts))
    events = spread.select("h1", "h2", "salt", "at", F.lit(None).cast(lives.schema["stop"].dataType).alias("stop"), "tbl", "row_id", "field").unionByName(
        copies.select("h1", "h2", "salt", F.col("start").alias("at"), "stop"), allowMissingColumns=True
    )
    # a life that begins at the very time of a reference goes before it; unknown times go first
    before = Window.partitionBy("h1", "h2", "salt").orderBy("at", F.col("stop").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = events.withColumn("until", F.max("stop").over(before)).filter(F.col("tbl").isNotNull())
    left = met.filter(F.col("until").isNull() | (F.col("at") >= F.col("until"))).select("tbl", "row_id", "field", "at", "h1", "h2", F.col("until").isNotNull().alias("once"))
    left = stage(left, "orphans")
    # those that met no life before: the id lives later, has only unknown times or was let pass by mistake
    known = keys.withColumn("known", F.lit(True))
    unmet = left.filter(~F.col("once")).join(known, ["h1", "h2"], "left")
    reason = F.when(F.col("known").isNull(), "missing").when(F.col("at").isNull(), "deleted").otherwise("late")
    verified = left.filter("once").select("tbl", "row_id", "field", "at", F.lit("deleted").alias("reason")).unionByName(unmet.select("tbl", "row_id", "field", "at", reason.alias("reason")))
    return certain.unionByName(verified).select("tbl", F.date_format("at", "yyyy-MM").alias("period"), "row_id", "field", "reason").distinct()


def graph_orphans(edges: DataFrame, inferred: DataFrame, symbols: DataFrame, external: DataFrame) -> DataFrame:
    """The orphan references of a code graph: both ends of edges and the callee of resolved inferred edges."""
    resolved = inferred.filter(inferred["resolved"])
    refs = references(edges, "edges", edges["edge_id"], edges["indexed_at"], {"source": edges["source"], "target": edges["target"]}).unionByName(
        references(resolved, "inferred_edges", resolved["edge_no"], resolved["indexed_at"], {"callee": resolved["callee"]})
    )
    parents = symbols.select("id", F.col("indexed_at").alias("start"), F.col("removed_at").alias("stop"))
    return orphan_references(refs, parents, external.select("id"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(tbl, period, field, reason, n_references): orphans for each table and month."""
    return orphans.groupBy("tbl", "period", "field", "reason").agg(F.count("*").alias("n_references"))
