"""How well inferred CALLS edges agree with observed calls and with hand labels: keyed joins, no row is compared by a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import strip_scheme, symbol_key, with_call_ends
from ..graph import CodeGraph


def defined_keys(symbols: DataFrame) -> DataFrame:
    """(key): distinct (module, qualname) of symbols that lie in a file."""
    return symbols.filter(F.col("file").isNotNull()).select(symbol_key(F.col("id")).alias("key")).filter(F.col("key").isNotNull()).distinct()


def split_calls(g: CodeGraph) -> DataFrame:
    """(seq, source, target, caller, callee, confidence, file, line, resolved) of every CALLS edge. resolved: both ends have
    a key and the callee is defined."""
    calls = g.edges.filter(F.col("type") == "CALLS")
    keyed = calls.select("seq", "source", "target", symbol_key(F.col("source")).alias("caller"), symbol_key(F.col("target")).alias("callee"), "confidence", "file", "line")
    known = defined_keys(g.symbols).select(F.col("key").alias("callee"), F.lit(True).alias("_known"))
    resolved = F.coalesce(F.col("_known") & F.col("caller").isNotNull(), F.lit(False))
    return keyed.join(known, "callee", "left").select("seq", "source", "target", "caller", "callee", "confidence", "file", "line", resolved.alias("resolved"))


def observed_pairs(observed: DataFrame) -> DataFrame:
    """(caller, callee): distinct pairs of keys that a trace saw; a caller within a nested scope counts as the scope about it."""
    pairs = with_call_ends(observed.select("caller", "callee"), {"caller": True, "callee": False})
    return pairs.filter(F.col("caller").isNotNull() & F.col("callee").isNotNull()).distinct()


def matched(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """Observed pairs that an edge names, with the last such edge: (caller, callee, seq, confidence, file, line). Edges whose
    callee is not defined can match too."""
    last = calls.filter(F.col("caller").isNotNull() & F.col("callee").isNotNull()).groupBy("caller", "callee").agg(F.max(F.struct("seq", "confidence", "file", "line")).alias("e"))
    return pairs.join(last, ["caller", "callee"]).select("caller", "callee", "e.*")


def unmatched(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """Observed pairs that no edge names."""
    return pairs.join(calls.select("caller", "callee"), ["caller", "callee"], "left_anti")


def unobserved(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """Resolved edges whose pair was never seen, each edge by itself."""
    return calls.filter("resolved").join(pairs, ["caller", "callee"], "left_anti")


def unresolved_only_callers(calls: DataFrame) -> DataFrame:
    """(caller): callers none of whose edges is resolved."""
    return calls.filter(F.col("caller").isNotNull()).groupBy("caller").agg(F.bool_or("resolved").alias("any")).filter(~F.col("any")).select("caller")


def declared_targets(calls: DataFrame) -> DataFrame:
    """(caller, method, qualnames): what the resolved edges of a caller name, by the last part of the callee's name."""
    method = F.substring_index("callee.qualname", ".", -1)
    return calls.filter("resolved").groupBy("caller", method.alias("method")).agg(F.sort_array(F.collect_set("callee.qualname")).alias("qualnames"))


def miss_classes(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """(class, n) of the observed pairs that no edge names. unresolved: the caller has edges but none resolved; override: an
    edge of the caller names the same method of another class; silent: the rest."""
    miss = unmatched(calls, pairs).withColumn("method", F.substring_index("callee.qualname", ".", -1))
    only = unresolved_only_callers(calls).withColumn("u", F.lit(True))
    names = calls.filter("resolved").select("caller", F.substring_index("callee.qualname", ".", -1).alias("method"), F.col("callee.qualname").alias("declared")).distinct()
    same = miss.join(names, ["caller", "method"]).groupBy("caller", "callee").agg(F.max(F.col("declared") != F.col("callee.qualname")).alias("o"))
    kind = F.when(F.col("u"), "unresolved").when(F.col("o"), "override").otherwise("silent")
    return miss.join(only, "caller", "left").join(same, ["caller", "callee"], "left").groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def summary(calls: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: n_observed, n_matched, n_inferred, n_unresolved, n_judgeable and precision in basis points, null where
    nothing was observed."""
    o = pairs.agg(F.count("*").alias("n_observed"))
    m = matched(calls, pairs).agg(F.count("*").alias("n_matched"))
    c = calls.agg(F.count("*").alias("n_inferred"), F.count_if(~F.col("resolved")).alias("n_unresolved"))
    k = F.lit(1).alias("k")  # three tables of one row each
    one = o.select(k, "*").join(m.select(k, "*"), "k").join(c.select(k, "*"), "k").drop("k")
    return one.withColumns({"n_judgeable": F.col("n_inferred") - F.col("n_unresolved"), "precision_bp": F.floor(F.try_divide(F.col("n_matched") * 10000, F.col("n_observed"))).cast("long")})


def sample_region(g: CodeGraph, labels: DataFrame) -> DataFrame:
    """(seq, caller_file, caller_qualname, callee, line, resolved): CALLS edges in labelled files as labels name them; the
    callee is its id without scheme, resolved if a symbol in a file has that id."""
    files = labels.select(F.col("caller_file").alias("file")).distinct()
    known = g.symbols.filter(F.col("file").isNotNull()).select(strip_scheme(F.col("id")).alias("callee"), F.lit(True).alias("_r")).distinct()
    edges = g.edges.filter((F.col("type") == "CALLS") & F.col("file").isNotNull()).join(files, "file", "left_semi")
    named = edges.select("seq", F.col("file").alias("caller_file"), symbol_key(F.col("source"))["qualname"].alias("caller_qualname"), strip_scheme(F.col("target")).alias("callee"), "line")
    return named.filter(F.col("caller_qualname").isNotNull()).join(known, "callee", "left").withColumn("resolved", F.coalesce("_r", F.lit(False))).drop("_r")


_KEY = ["caller_file", "caller_qualname", "callee"]


def sample_inferred(region: DataFrame) -> DataFrame:
    """The region's edges, one for each key: that of least line, then seq."""
    return region.groupBy(*_KEY).agg(F.min(F.struct(F.coalesce("line", F.lit(-1)).alias("line"), "seq", "resolved")).alias("e")).select(*_KEY, "e.line", "e.resolved")


def sample_confirmed(region: DataFrame, labels: DataFrame) -> DataFrame:
    return sample_inferred(region).join(labels.select(*_KEY).distinct(), _KEY, "left_semi").select(*_KEY)


def sample_unconfirmed(region: DataFrame, labels: DataFrame) -> DataFrame:
    return sample_inferred(region).join(labels.select(*_KEY).distinct(), _KEY, "left_anti").select(*_KEY)


def sample_missing(region: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels that no edge of the region has."""
    return labels.select(*_KEY).distinct().join(region, _KEY, "left_anti")


def sample_summary(region: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: n_confirmed, n_unconfirmed, n_unresolved and precision in basis points, 0 without edges."""
    own = labels.select(*_KEY).distinct().withColumn("l", F.lit(True))
    x = sample_inferred(region).join(own, _KEY, "left").agg(F.count_if(F.col("l")).alias("n_confirmed"), F.count_if(F.col("l").isNull()).alias("n_unconfirmed"), F.count_if(~F.col("resolved")).alias("n_unresolved"))
    return x.withColumn("precision_bp", F.coalesce(F.floor(F.try_divide(F.col("n_confirmed") * 10000, F.col("n_confirmed") + F.col("n_unconfirmed"))), F.lit(0)).cast("long"))


def ordered_files(labels: DataFrame) -> DataFrame:
    """(caller_file, first): labelled files by first mention."""
    return labels.groupBy("caller_file").agg(F.min("seq").alias("first")).orderBy("first")
