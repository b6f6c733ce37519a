"""Source trees: local folders and hosted repositories, scanned into a table of files."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import EXCLUDED, LANGUAGES, hosted
from ..runtime import partitions_for


@contextmanager
def open_source(source: str) -> Iterator[tuple[str, str]]:
    """(folder, kind) of a local folder or, as a shallow clone that is removed afterwards, of a hosted repository."""
    address = hosted(source)
    if address is None:
        if source.lower().startswith(("http://", "https://")):
            raise ValueError(f"not the address of a repository: {source}")
        folder = os.path.realpath(os.path.expanduser(source))
        if not os.path.isdir(folder):
            raise FileNotFoundError(source)
        yield folder, "local"
        return
    place = tempfile.mkdtemp(prefix="weftgraph-clone-")
    try:
        done = subprocess.run(["git", "clone", "--depth", "1", address, f"{place}/tree"], capture_output=True, text=True)
        if done.returncode:
            raise RuntimeError(f"git clone failed: {done.stderr.strip()}")
        yield f"{place}/tree", "github"
    finally:
        shutil.rmtree(place, ignore_errors=True)


def list_files(root: str, exclude: Iterable[str] = ()) -> list[tuple[int, str, str, int]]:
    """(file_seq, rel, lang, mtime_ns) of the files of known languages, ordered part by part of their paths."""
    names = set(exclude) or set(EXCLUDED)
    found = []
    for at, dirs, files in os.walk(root):
        dirs[:] = [d for d in dirs if d not in names]
        for f in files:
            full = os.path.join(at, f)
            suffix = os.path.splitext(f)[1].lower()
            if f not in names and suffix in LANGUAGES and os.path.isfile(full):
                rel = os.path.relpath(full, root).replace(os.sep, "/")
                found.append((rel.split("/"), rel, LANGUAGES[suffix], os.stat(full).st_mtime_ns))
    return [(k, rel, lang, m) for k, (_, rel, lang, m) in enumerate(sorted(found))]


def scan(spark: SparkSession, root: str, exclude: Iterable[str] = ()) -> DataFrame:
    """(rel, file_seq, lang, mtime_ns, content, hash): the driver lists names and times; contents are read and hashed by
    executors, so the folder must be one that they share. Spark's own file source rounds times and passes over names that
    begin with an underscore. A file that cannot be read has null content."""
    names = spark.createDataFrame(list_files(root, exclude), "file_seq long, rel string, lang string, mtime_ns long")
    base = os.path.realpath(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.iloc[i : i + 64]
                out = []
                for rel in part["rel"]:
                    try:
                        with open(f"{base}/{rel}", "rb") as f:
                            out.append(f.read())
                    except OSError:
                        out.append(None)
                yield part.assign(content=out)

    files = names.repartition(partitions_for(spark, names.count(), 500), "rel").select("rel", "file_seq", "lang", "mtime_ns")
    got = files.mapInPandas(read, "rel string, file_seq long, lang string, mtime_ns long, content binary")
    return got.withColumn("hash", F.sha2("content", 256))
