"""Recorded calls as a stream: a folder of trace files compared with a graph as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def call_stream(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """(caller, callee): calls of new lines of calls-*.jsonl files, as structs of module and qualname."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_a_trigger).option("pathGlobFilter", "calls-*.jsonl").load(folder)
    a = lines.select(F.from_json("value", "array<string>").alias("a")).filter(F.size("a") == 4)
    end = lambda i: F.struct(F.col("a")[i].alias("module"), F.col("a")[i + 1].alias("qualname"))
    return a.select(end(0).alias("caller"), end(2).alias("callee"))


def edge_counts(edges: DataFrame, late: str = "2 hours", window: str = "1 day") -> DataFrame:
    """(window, type, n): edges of a stream with indexed_at by event time; rows later than ``late`` are left out."""
    timed = edges.withColumn("at", F.col("indexed_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), F.upper(F.trim("type")).alias("type")).agg(F.count("*").alias("n"))
