"""Session-level helpers: table access, staged tables, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is broadcast by hint only up to this many rows; beyond it the planner chooses.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` of the folder ``root`` (a Parquet file or folder)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Where it is unset: on a local master a temporary folder that goes with the process, on a cluster a folder under
    the SQL warehouse if that is no machine's own; without either, a ValueError asks for the setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        named = tempfile.mkdtemp(prefix="weftgraph-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    else:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if warehouse.startswith("file:") or "://" not in warehouse:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{warehouse}/_staged"
    spark.sparkContext.setCheckpointDir(named)
    return named


#: Sessions and paths of the tables that stage() wrote.
_STAGED: list[tuple[SparkSession, str]] = []


def _remove_staged() -> None:
    """Removes the staged tables, by the file system that holds them; after the session's end only those of local paths."""
    alive = True
    for spark, path in _STAGED:
        try:
            if alive:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session is gone
            alive = False
        if not alive and "://" not in path:
            shutil.rmtree(local_path(path), ignore_errors=True)
    _STAGED.clear()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table in the shared folder and read that back.

    The written table outlives lost executors and is removed when the driver ends. A column of an own schema is kept, also
    for no rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _STAGED:
        atexit.register(_remove_staged)
    _STAGED.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions so that each holds about ``rows_each`` rows, at least two a core."""
    least = max(2, spark.sparkContext.defaultParallelism)
    return int(max(least, -(-rows // max(1, rows_each))))


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than is needed to tell."""
    return df.limit(rows + 1).count() <= rows


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_weftgraph_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="weftgraph-zip-")  # read by the driver only, which serves the file to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(os.path.join(folder, "weftgraph.zip"), "w") as z:
        for at, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("weftgraph", os.path.relpath(full, here)))
    sc.addPyFile(os.path.join(folder, "weftgraph.zip"))
    sc._weftgraph_shipped = True


def local_path(uri: str) -> str:
    """The path of a ``file:`` URI, other strings as they are."""
    return uri[5:].replace("///", "/", 1) if uri.startswith("file:") else os.fspath(uri)
