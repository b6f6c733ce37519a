"""Graphs as one JSON document and as Parquet folders."""

from __future__ import annotations

import bisect
import functools
import gzip
import json
import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import SCHEMA_VERSION
from ..graph import EDGE, SYMBOL, CodeGraph
from ..runtime import local_path, partitions_for, shared_dir, ship, stage

_FREE = {"metadata": T.VariantType()}
#: Bytes of text that are scanned and parsed at a time, and rows that are written at a time.
BLOCK, BATCH = 1 << 20, 3_000
#: Of the compression of documents.
LEVEL = 6
#: A compressed document with members of more text than so many blocks is packed anew, as each of its pieces is read from the
#: start of a member.
MEMBER_BLOCKS = 16


def _with(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, _FREE.get(f.name, f.dataType)) for f in schema])


class InvalidGraph(ValueError):
    """The document is no graph of this version."""


def _pretty(x: object, depth: int) -> str:
    return json.dumps(x, indent=2, sort_keys=True, ensure_ascii=False).replace("\n", "\n" + "  " * depth)


def _cells(a: pa.Array, name: str) -> pa.Array:
    """JSON of the values of a column."""
    if name == "metadata":
        return pa.array([_metadata(m) if m else "null" for m in a.to_pylist()], pa.string())
    if not pa.types.is_string(a.type):
        return pc.fill_null(pc.cast(a, pa.string()), "null")
    if pc.any(pc.match_substring_regex(a, '["\\\\\\x00-\\x1f]')).as_py():
        quote = json.encoder.encode_basestring
        return pa.array(["null" if v is None else quote(v) for v in a.to_pylist()], pa.string())
    return pc.fill_null(pc.binary_join_element_wise('"', a, '"', ""), "null")


@functools.lru_cache(4096)
def _metadata(text: str) -> str:
    return _pretty(json.loads(text), 3)


def _write_rows(df: DataFrame, schema: T.StructType, place: str) -> list[str]:
    """Files of the elements of a sorted table, in the order of its partitions: executors write them, packed."""
    names = sorted(schema.fieldNames())
    have = [n for n in names if n in df.columns]

    def text(b: pa.RecordBatch) -> bytes:
        """The elements, each after a comma."""
        cells, before = [], ",\n    {"
        for k, n in enumerate(names):
            before += ("," if k else "") + f'\n      "{n}": '
            if n in have:
                cells += [before, _cells(b.column(n), n)]
                before = ""
            else:
                before += "null"
        rows = pc.binary_join_element_wise(*cells, before + "\n    }", "")
        ends = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset :]
        return rows.buffers()[2][ends[0] : ends[len(rows)]].to_pybytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, some = uuid.uuid4().hex, False
        with open(f"{place}/{name}", "wb") as f:
            for b in batches:
                for k in range(0, b.num_rows, BATCH):
                    f.write(gzip.compress(text(b.slice(k, BATCH))[0 if some else 2 :], LEVEL, mtime=0))
                    some = True
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": pa.array([name if some else None], pa.string())})

    files = df.select(*have).mapInArrow(write, "part long, name string").collect()
    return [r.name for r in sorted(files) if r.name]


def _sorted(df: DataFrame, schema: T.StructType, rank: str, repeats: bool = False) -> DataFrame:
    """By rank, then by all columns. repeats: whole rows count once, which needs no other exchange than that by rank."""
    parts = df.repartitionByRange(rank)
    return (parts.distinct() if repeats else parts).sortWithinPartitions(rank, *[c for c in schema.fieldNames() if c in df.columns])


def write_json(g: CodeGraph, path: str) -> None:
    """One pretty document with sorted keys, parents made; compressed by gzip if the path ends in .gz. Executors write the
    elements beside it, so they must share its folder, and the driver joins what they wrote block by block."""
    ship(g.symbols.sparkSession)
    path = os.path.abspath(path)
    place = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(place)
    packed = path.endswith(".gz")
    try:
        with open(f"{place}/document", "wb") as f:

            def say(text: str) -> None:
                f.write(gzip.compress(text.encode(), LEVEL, mtime=0) if packed else text.encode())

            def table(df: DataFrame, schema: T.StructType) -> None:
                names = _write_rows(df, schema, place)
                for k, name in enumerate(names):
                    say(",\n" if k else "[\n")
                    with (open if packed else gzip.open)(f"{place}/{name}", "rb") as part:
                        shutil.copyfileobj(part, f, BLOCK)
                    os.remove(f"{place}/{name}")
                say("\n  ]" if names else "[]")

            say('{\n  "edges": ')
            table(_sorted(g.edges, EDGE, "seq") if g.all_edges is None else _sorted(g.all_edges, EDGE, "seq", True), EDGE)
            say(f',\n  "metadata": {_pretty(g.meta, 1)},\n  "schema_version": {json.dumps(SCHEMA_VERSION)},\n  "symbols": ')
            table(_sorted(g.symbols, SYMBOL, "ord"), SYMBOL)
            say("\n}")
        os.replace(f"{place}/document", path)
    finally:
        shutil.rmtree(place, ignore_errors=True)


def _packed(path: str) -> bool:
    with open(path, "rb") as f:
        return f.read(2) == b"\x1f\x8b"


def _text(path: str, at: int, members: list[tuple[int, int]] | None = None) -> Iterator[bytes]:
    """The document's bytes from ``at`` on, which in a compressed one is the start of a member. Puts into ``members`` where
    members start and where the last ends, in bytes of text and of the file."""
    packed, n, unpack = _packed(path), 0, None
    with open(path, "rb") as f:
        f.seek(at)
        while data := f.read(BLOCK):
            if not packed:
                yield data
                continue
            while data:
                if unpack is None:
                    unpack = zlib.decompressobj(31)
                    if members is not None:
                        members.append((n, at))
                text = unpack.decompress(data, BLOCK)
                rest = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                at, data, n = at + len(data) - len(rest), rest, n + len(text)
                if unpack.eof:
                    unpack = None
                if text:
                    yield text
    if unpack is not None:
        raise zlib.error("it is cut off")
    if packed and members is not None:
        members.append((n, at))


def _blocks(texts: Iterable[bytes]) -> Iterator[bytes]:
    """The same in blocks of at least BLOCK bytes, but for the last."""
    have = bytearray()
    for x in texts:
        have += x
        if len(have) >= BLOCK:
            yield bytes(have)
            have.clear()
    yield bytes(have)


_KIND = np.zeros(256, np.uint8)
_KIND[list(b'"')], _KIND[list(b"[{")], _KIND[list(b"]}")] = 1, 2, 3


def _outline(blocks: Iterable[bytes]) -> tuple[bytes, dict[str, list[tuple[int, int, int, int]]]]:
    """The document without the elements of symbols and edges, and of each of these pieces that end with an element: (start,
    length, rank of the first, elements). One pass that holds a block at a time."""
    outer, pieces = bytearray(), {"symbols": [], "edges": []}
    base = depth = 0
    start = rank = rows = quoted = 0
    escaped, part = False, None

    def piece(upto: int) -> None:
        nonlocal start, rank, rows
        if upto > start:
            pieces[part].append((start, upto - start, rank, rows))
        start, rank, rows = upto, rank + rows, 0

    for block in blocks:
        plain = block
        if escaped:
            plain = b" " + plain[1:]
        escaped = False
        if b"\\" in plain:
            ends = len(plain) - len(plain.rstrip(b"\\"))
            escaped = bool(ends % 2)
            plain = re.sub(rb"\\[\s\S]?", lambda m: b" " * len(m[0]), plain)
        kinds = _KIND[np.frombuffer(plain, np.uint8)]
        at = np.flatnonzero(kinds)
        kinds = kinds[at]
        inside = (np.cumsum(kinds == 1) + quoted) & 1
        if len(inside):
            quoted = int(inside[-1])
        keep = (kinds > 1) & (inside == 0)
        at, opens = at[keep], kinds[keep] == 2
        levels = depth + np.cumsum(np.where(opens, 1, -1))
        if len(levels):
            depth = int(levels[-1])
        ends, c = at[~opens & (levels == 2)], 0
        for k in np.flatnonzero((levels <= 1) | opens & (levels == 2)):
            p = int(at[k])
            if part is None and opens[k] and levels[k] == 2 and block[p] == 91:
                outer += block[c : p + 1]
                c = p + 1
                key = outer[-4096:-1].rstrip()
                key = re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\Z', key)
                name = json.loads(b'"%s"' % key[1]) if key else None
                if name in pieces:
                    part, pieces[name], start, rank, rows = name, [], base + c, 0, 0
            elif part is not None and levels[k] <= 1:
                rows += int(((ends >= c) & (ends < p)).sum())
                piece(base + p)
                part, c = None, p
        if part is None:
            outer += block[c:]
        elif len(own := ends[ends >= c]):
            rows += len(own)
            piece(base + int(own[-1]) + 1)
        base += len(block)
    if part is not None:
        raise ValueError(f"{part} have no end")
    return bytes(outer), pieces


def _repack(path: str, to: str) -> None:
    with open(to, "wb") as f:
        for block in _blocks(_text(path, 0)):
            f.write(gzip.compress(block, 1, mtime=0))


def _parsed(spark: SparkSession, path: str, part: str, schema: T.StructType, rank: str, pieces: list[tuple], members: list[tuple[int, int]]) -> DataFrame:
    """The staged rows of a table of the document."""
    known = set(schema.fieldNames())
    starts = [m[0] for m in members]

    def place(start: int) -> tuple[int, int]:
        if not members:
            return start, 0
        n, at = members[bisect.bisect_right(starts, start) - 1]
        return at, start - n

    def take(at: int, skip: int, length: int) -> bytes:
        have = bytearray()
        for x in _text(path, at):
            have += x
            if len(have) >= skip + length:
                break
        return bytes(have[skip : skip + length])

    def check(text: str, first: bool, n: int) -> tuple[str | None, str | None]:
        body = text.strip(" \t\r\n")
        if not body and not n:
            return "[]", None
        if not first:
            if body[:1] != ",":
                return None, f"not a JSON document: {part} have no comma between elements"
            body = body[1:]
            if not body.strip(" \t\r\n"):
                return None, f"not a JSON document: {part} end with a comma"
        body = f"[{body}]"
        try:
            rows = json.loads(body)
        except ValueError as e:
            return None, f"not a JSON document: in a part of {part}: {e}"
        for row in rows:
            if not isinstance(row, dict) or not row.keys() <= known:
                return None, f"{part} have unknown fields: {sorted(set(row) - known) if isinstance(row, dict) else row!r}"
        return (body, None) if len(rows) == n else (None, f"not a JSON document: {part} have {len(rows)} elements where {n} end")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, skip, length, n0, n in b.itertuples(index=False):
                try:
                    text, error = check(take(at, skip, length).decode(), n0 == 0, n)
                except UnicodeDecodeError as e:
                    text, error = None, f"not a JSON document: {e}"
                yield pd.DataFrame({"n0": [n0], "text": [text], "error": [error]})

    rows = spark.createDataFrame([(*place(s), n, n0, k) for s, n, n0, k in pieces], "at long, skip long, length long, n0 long, n long")
    texts = rows.repartition(partitions_for(spark, len(pieces), 16), "at", "skip").mapInPandas(read, "n0 long, text string, error string")
    got = texts.select("n0", "error", F.from_json("text", T.ArrayType(_with(schema))).alias("a"))
    got = got.withColumn("error", F.coalesce("error", F.when(F.col("a").isNull(), F.lit(f"{part} cannot be read"))))
    got = got.filter(F.col("error").isNotNull() | (F.size("a") > 0)).select("n0", "error", F.posexplode_outer("a").alias("k", "r"))
    table = got.select((F.col("n0") + F.col("k")).alias(rank), "r.*", "error").withColumn("metadata", F.when(F.col("metadata").isNotNull(), F.to_json("metadata")))
    table = stage(table, f"json-{part}")
    wrong = table.filter(F.col("error").isNotNull()).first()
    if wrong:
        raise InvalidGraph(wrong.error)
    return table.drop("error")


def read_json(spark: SparkSession, path: str) -> CodeGraph:
    """The graph of a document, which may be compressed by gzip; its arrays' order is the insertion order. InvalidGraph if it is no
    JSON, of another version, or has fields that the schema has not.

    The driver passes over the text once, a block at a time, for where elements end; executors, which must share the file, parse
    and check the pieces, and their rows are staged."""
    ship(spark)
    path, spool, members = os.path.abspath(local_path(path)), None, []
    try:
        try:
            outer, pieces = _outline(_blocks(_text(path, 0, members)))
            if any(b[0] - a[0] > MEMBER_BLOCKS * BLOCK for a, b in zip(members, members[1:])):
                spool = f"{local_path(shared_dir(spark)).rstrip('/')}/document-{uuid.uuid4().hex}"
                _repack(path, spool)
                path, members = spool, []
                outer, pieces = _outline(_blocks(_text(path, 0, members)))
            doc = json.loads(outer.decode())
        except (ValueError, zlib.error) as e:
            raise InvalidGraph(f"not a JSON document: {e}") from None
        if not isinstance(doc, dict) or doc.get("schema_version") != SCHEMA_VERSION:
            found = doc.get("schema_version") if isinstance(doc, dict) else None
            raise InvalidGraph(f"schema version {found!r}, expected {SCHEMA_VERSION!r}; index the source again")
        for part in pieces:
            if doc.get(part):
                raise InvalidGraph(f"{part} are no array under a plain key")
        symbols = _parsed(spark, path, "symbols", SYMBOL, "ord", pieces["symbols"], members)
        edges = _parsed(spark, path, "edges", EDGE, "seq", pieces["edges"], members)
    finally:
        if spool and os.path.exists(spool):
            os.remove(spool)

    from ..graph import first_wins

    return CodeGraph(first_wins(symbols), edges, doc.get("metadata") or {})


def write_parquet(g: CodeGraph, folder: str) -> None:
    """symbols, edges by type, and the metadata, each a folder of ``folder``."""
    g.symbols.write.mode("overwrite").parquet(f"{folder}/symbols")
    g.edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")
    meta = g.symbols.sparkSession.createDataFrame([(SCHEMA_VERSION, json.dumps(g.meta))], "schema_version string, metadata string")
    meta.write.mode("overwrite").parquet(f"{folder}/meta")


def read_parquet(spark: SparkSession, folder: str) -> CodeGraph:
    version, meta = spark.read.parquet(f"{folder}/meta").first()
    if version != SCHEMA_VERSION:
        raise InvalidGraph(f"schema version {version!r}, expected {SCHEMA_VERSION!r}; index the source again")
    return CodeGraph(spark.read.parquet(f"{folder}/symbols"), spark.read.parquet(f"{folder}/edges"), json.loads(meta))
