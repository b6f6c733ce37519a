"""Finding symbols, and the edges next to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import CodeGraph
from ..runtime import stage

RESOLVE_LIMIT = 25


def _holds(needle: str) -> Column:
    low = needle.lower()
    return F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("id"), F.lit(low))


def matching(g: CodeGraph, needle: str) -> DataFrame:
    """Symbols whose name or id has the needle, whatever the case; no character of it is a wildcard."""
    return g.where(_holds(needle))


def find_symbol(g: CodeGraph, needle: str, limit: int = 20) -> DataFrame:
    """(id, type, name, file) of the first matches by (type, id); a missing file is an empty string."""
    return matching(g, needle).orderBy("type", "id").limit(limit).select("id", "type", "name", F.coalesce("file", F.lit("")).alias("file"))


def probe(g: CodeGraph, needle: str) -> DataFrame:
    """(id): the first symbol in insertion order whose id or name has the needle, case included."""
    return g.where(F.contains("id", F.lit(needle)) | F.contains("name", F.lit(needle))).orderBy("ord").limit(1).select("id")


def symbols_by_name(g: CodeGraph, name: str) -> DataFrame:
    """(id, ord) of the symbols of exactly this name, by insertion; an empty name names nothing."""
    return g.named(name).orderBy("ord").select("id", "ord")


def file_symbols(g: CodeGraph, file: str) -> DataFrame:
    """(id) of the symbols of a file."""
    return g.where(F.col("file") == file).select("id")


def exact_ids(g: CodeGraph, text: str, limit: int | None = None) -> list[str]:
    """The id itself if a symbol has it, else the ids of all symbols of this name, by insertion."""
    if not g.symbols.filter(F.col("id") == text).isEmpty():
        return [text]
    named = symbols_by_name(g, text)
    return [r.id for r in (named.limit(limit) if limit else named).collect()]


def resolve_ids(g: CodeGraph, text: str, limit: int = RESOLVE_LIMIT) -> list[str]:
    """exact_ids, else the ids that hold the text by (type, id); at most ``limit``."""
    exact = exact_ids(g, text, limit)
    if exact:
        return exact[:limit]
    return [r.id for r in find_symbol(g, text, limit).select("id").collect()]


def edges_from(g: CodeGraph, id_: str) -> DataFrame:
    """Edges out of an id, in insertion order."""
    return g.edges.filter(F.col("source") == id_).orderBy("seq")


def edges_to(g: CodeGraph, id_: str) -> DataFrame:
    return g.edges.filter(F.col("target") == id_).orderBy("seq")


def edges_by_type(g: CodeGraph, type_: str) -> DataFrame:
    return g.edges.filter(F.col("type") == type_)


def _calls(g: CodeGraph, text: str, limit: int, here: str, there: str, out: str) -> DataFrame:
    ids = exact_ids(g, text) or [text]  # an end that no table holds has callers too
    hit = g.edges.filter((F.col("type") == "CALLS") & F.col(here).isin(ids))
    top = hit.orderBy(F.coalesce("confidence", F.lit("")), there, "seq").limit(limit)
    top = stage(top, "calls")
    names = g.about(top.select(F.col(there).alias("id")).distinct()).select(F.col("id").alias(there), "name")
    return top.join(names, there, "left").select(
        F.col(there).alias(out), F.coalesce("name", there).alias(f"{out}_name"), "line", "confidence", "seq"
    ).orderBy(F.coalesce("confidence", F.lit("")), out, "seq")


def callers_of(g: CodeGraph, text: str, limit: int = 50) -> DataFrame:
    """(caller, caller_name, line, confidence, seq): a row for each CALLS edge into the symbol, by (confidence, caller)."""
    return _calls(g, text, limit, "target", "source", "caller")


def callees_of(g: CodeGraph, text: str, limit: int = 50) -> DataFrame:
    """(callee, callee_name, line, confidence, seq): a row for each CALLS edge out of the symbol."""
    return _calls(g, text, limit, "source", "target", "callee")
