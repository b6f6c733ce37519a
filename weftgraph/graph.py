"""A code graph: symbols, edges and metadata as DataFrames, and the rules of identity that hold for them."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.keyed_tree import edge_type
from .runtime import read_table

SYMBOL = T.StructType(
    [T.StructField(n, T.StringType(), n in ("file", "metadata")) for n in ("id", "type", "language", "name", "file")]
    + [T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("metadata", T.StringType())]
)
EDGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("type", "source", "target", "language", "confidence", "file")]
    + [T.StructField("line", T.IntegerType()), T.StructField("column", T.IntegerType()), T.StructField("metadata", T.StringType())]
)
DEFAULT_PATH_TYPES = ("CALLS", "IMPORTS", "CONTAINS", "INHERITS")
DEFAULT_IMPACT_TYPES = ("CALLS", "IMPORTS", "CONTAINS")


@dataclass
class CodeGraph:
    """symbols: unique id, ``ord`` its insertion rank. edges: a bag, ``seq`` the insertion rank. Ends of edges need no symbol."""

    symbols: DataFrame
    edges: DataFrame
    meta: dict[str, Any] = field(default_factory=dict)
    #: Rows of symbols before the first of an id was chosen, and of edges before repeats went, if the graph comes from such.
    all_symbols: DataFrame | None = None
    all_edges: DataFrame | None = None

    def about(self, ids: DataFrame) -> DataFrame:
        """The symbols of (id): only their rows are gathered, not those of the whole graph."""
        if self.all_symbols is None:
            return self.symbols.join(ids, "id", "left_semi")
        return first_wins(self.all_symbols.join(ids, "id", "left_semi"))

    def where(self, condition: Column) -> DataFrame:
        """The symbols for which the condition holds. It goes to the scan first: only ids that meet it in any of their rows are
        gathered, then the first row of each decides."""
        rows = self.symbols
        if self.all_symbols is not None:
            rows = self.about(self.all_symbols.filter(condition).select("id").distinct())
        return rows.filter(condition)

    def named(self, name: str) -> DataFrame:
        """The symbols of exactly this name."""
        return self.where((F.col("name") == name) & (F.length("name") > 0))

    def steps(self) -> DataFrame:
        """Edges, some perhaps more than once, for what repeats do not matter to; a filter or join goes straight to the scan."""
        return self.edges if self.all_edges is None else self.all_edges

    def views(self, prefix: str = "") -> None:
        """Temporary views ``symbols`` and ``edges`` for SQL."""
        self.symbols.createOrReplaceTempView(f"{prefix}symbols")
        self.edges.createOrReplaceTempView(f"{prefix}edges")

    def cache(self) -> CodeGraph:
        """Kept in memory for many queries on one graph."""
        return CodeGraph(self.symbols.cache(), self.edges.cache(), self.meta)


def first_wins(rows: DataFrame, rank: str = "ord", keep: str = "first") -> DataFrame:
    """One row for each id: that of least ``rank``, whole. keep="definition": a row with a file goes before one without.
    Null ids are left out. One shuffle on the id, with partial minima before it."""
    others = [c for c in rows.columns if c not in ("id", rank)]
    placeholder = F.col("file").isNull() if keep == "definition" else F.lit(False)
    best = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct(placeholder.alias("_p"), F.col(rank), *others)).alias("_row"))
    return best.select(*[F.col("id") if c == "id" else F.col(f"_row.{c}") for c in rows.columns])


def from_tables(spark: SparkSession, folder: str) -> CodeGraph:
    """The graph of the tables symbols and edges: first symbol of an id wins, an edge that was delivered again counts
    once, edges without both ends are left out."""
    s = read_table(spark, folder, "symbols").select("ord", "id", "type", "language", "name", "file", "line", "metadata")
    e = read_table(spark, folder, "edges").select("edge_id", "type", "source", "target", "language", "confidence", "file", "line")
    rows = e.filter(F.col("source").isNotNull() & F.col("target").isNotNull()).select(
        F.col("edge_id").alias("seq"), edge_type(F.col("type")).alias("type"), "source", "target", "language", "confidence", "file", "line"
    )
    # a repeat is a whole row, so the columns are the key and filters pass below the deduplication
    return CodeGraph(first_wins(s), rows.distinct(), all_symbols=s, all_edges=rows)
