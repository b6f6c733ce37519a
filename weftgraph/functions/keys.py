"""Column expressions over symbol ids: reading a call's ends, splitting an id, paths and suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEME = "python://"


def strip_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _bare(c: Column) -> Column:
    bare = F.btrim(c, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare.startswith(SCHEME), F.substr(bare, F.lit(len(SCHEME) + 1))).otherwise(bare)


def _module(s: Column, colon: Column) -> Column:
    last = F.substring_index(s, ".", -1)
    return F.when(colon > 0, F.substring_index(s, ":", 1)).otherwise(F.left(s, F.greatest(F.lit(0), F.length(s) - F.length(last) - 1)))


def call_end(c: Column, caller: bool) -> Column:
    """struct(module, qualname) of a caller or callee in any of its spellings; null for null.

    Reads: white space at the ends and the scheme go; the first ``:`` parts module and qualname, without one the last
    ``.``; without either the module is empty. A last ``.__init__`` of the module goes. A caller's qualname ends before
    its first dotted part with ``<``. For columns of a frame with_call_ends() is cheaper.
    """
    s = _bare(c)
    colon = F.instr(s, ":")
    module = F.regexp_replace(_module(s, colon), r"\.__init__$", "")
    qual = F.when(colon > 0, F.substr(s, colon + 1)).otherwise(F.substring_index(s, ".", -1))
    return F.when(c.isNotNull(), F.struct(module.alias("module"), (enclosing_scope(qual) if caller else qual).alias("qualname")))


def with_call_ends(df: DataFrame, ends: dict[str, bool]) -> DataFrame:
    """``df`` with the columns of ``ends`` (name, whether it is a caller) read by call_end(). Every step is a projection of its
    own, so no part is worked out twice and the generated code stays small enough to be compiled."""
    kept = df.columns
    names = {e: f"_{e}" for e in ends}
    df = df.withColumns({f"{n}_s": _bare(F.col(e)) for e, n in names.items()})
    df = df.withColumns({f"{n}_c": F.instr(f"{n}_s", ":") for n in names.values()})
    df = df.withColumns({f"{n}_m": _module(F.col(f"{n}_s"), F.col(f"{n}_c")) for n in names.values()})
    df = df.withColumns({f"{n}_q": F.when(F.col(f"{n}_c") > 0, F.substr(F.col(f"{n}_s"), F.col(f"{n}_c") + 1)).otherwise(F.substring_index(f"{n}_s", ".", -1)) for n in names.values()})

    def end(e: str, n: str) -> Column:
        m, q = F.col(f"{n}_m"), F.col(f"{n}_q")
        module = F.when(m.endswith(".__init__"), F.left(m, F.length(m) - 9)).otherwise(m)
        qual = F.when(F.contains(q, F.lit("<")), enclosing_scope(q)).otherwise(q) if ends[e] else q
        return F.when(F.col(e).isNotNull(), F.struct(module.alias("module"), qual.alias("qualname"))).alias(e)

    return df.select(*[end(c, names[c]) if c in ends else c for c in kept])


def enclosing_scope(qual: Column) -> Column:
    """A qualname up to, without, its first dotted part that contains ``<``."""
    return F.regexp_replace(qual, r"(?s)(^|\.)[^.<]*<.*$", "")


def symbol_key(c: Column) -> Column:
    """struct(module, qualname) of a ``python://`` id; null for other schemes and where either part would be empty."""
    rest = c.substr(F.lit(len(SCHEME) + 1), F.length(c))
    colon = F.instr(rest, ":")
    module = F.when(colon > 0, F.substring_index(rest, ":", 1)).otherwise(F.regexp_extract(rest, r"(?s)^(.*)\.[^.]*$", 1))
    qual = F.when(colon > 0, rest.substr(colon + 1, F.length(rest))).otherwise(F.substring_index(rest, ".", -1))
    good = c.startswith(SCHEME) & (F.length(module) > 0) & (F.length(qual) > 0)
    return F.when(good, F.struct(module.alias("module"), qual.alias("qualname")))


def strip_scheme(c: Column) -> Column:
    """An id without its ``<scheme>://``."""
    return F.regexp_replace(c, r"^[^:/]*://", "")


def path_parts(rel: Column) -> Column:
    """A path as an array of its parts; arrays order as paths do, part by part."""
    return F.split(rel, "/")
