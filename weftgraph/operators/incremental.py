"""What of a scan can be reused from the state of an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes, in hexadecimal digits."""
    return F.sha2(content, 256)


def reuse(scan: DataFrame, state: DataFrame) -> DataFrame:
    """(rel, action) for every file of the scan or the state. reused: the state has it with equal language, time and hash;
    changed: it has it otherwise; added: it has it not; removed: the scan has it not any more.

    scan and state: (rel, lang, hash, mtime_ns), unique rel. Nulls are equal.
    """
    a = scan.select("rel", F.struct("lang", "hash", "mtime_ns").alias("a"))
    b = state.select("rel", F.struct("lang", "hash", "mtime_ns").alias("b"))
    action = F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").when(F.col("a").eqNullSafe(F.col("b")), "reused").otherwise("changed")
    return a.join(b, "rel", "full_outer").select("rel", action.alias("action"))


def newest_files(files: DataFrame) -> DataFrame:
    """Each file's newest row (greatest mtime_ns, then file_seq): rel, lang, hash, mtime_ns, status, file_seq."""
    row = F.struct("mtime_ns", "file_seq", "lang", "hash", "status")
    return files.filter(F.col("rel").isNotNull()).groupBy("rel").agg(F.max(row).alias("f")).select("rel", "f.lang", "f.hash", "f.mtime_ns", "f.status", "f.file_seq")


def unique_contents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(hash, key, n): the first row of each distinct non-null text, by least key, and how many have it."""
    d = docs.filter(F.col(text).isNotNull()).select(F.sha2(F.col(text).cast("binary"), 256).alias("hash"), key)
    return d.groupBy("hash").agg(F.min(key).alias(key), F.count("*").alias("n"))
