"""Encoding of a corpus by a byte-level BPE vocabulary, by merges through a segment tree."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Where the vocabularies of public tokenizers are; a parameter of every function here.
TOKENIZERS = "/opt/tokenizers"
# Fixed value of the vocabulary: the pattern that splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker keeps.
CACHE = 200_000

_NONE = 1 << 60


def load_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Token and id of a rank file; an id is the rank of the merge that makes the token."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ids of texts. Strings that look like special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int]):
        import regex

        self.ranks, self.split, self.known = ranks, regex.compile(PATTERN).findall, {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece. The leaves of a segment tree are the ranks of adjacent pairs; the root is the least of them,
        reached leftmost first. A merge changes three leaves and their ancestors; the end is a root without a merge."""
        ranks, n = self.ranks, len(piece)
        if n == 1:
            return [ranks[piece]]
        size = 1
        while size < n - 1:
            size *= 2
        tree = [_NONE] * (2 * size)
        get = ranks.get
        for i in range(n - 1):
            tree[size + i] = get(piece[i : i + 2], _NONE)
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b
        # part i covers piece[i:end[i]]; before[i] is the part that ends at i
        end, before = list(range(1, n + 1)), list(range(-1, n))
        while tree[1] != _NONE:
            least, k = tree[1], 1
            while k < size:
                k = 2 * k if tree[2 * k] == least else 2 * k + 1
            i = k - size
            j = end[i]
            e = end[i] = end[j]
            before[e] = i
            changed = [(i, get(piece[i : end[e]], _NONE) if e < n else _NONE), (j, _NONE)]
            if i:
                h = before[i]
                changed.append((h, get(piece[h:e], _NONE)))
            for at, rank in changed:
                if at >= n - 1:
                    continue
                k = size + at
                tree[k] = rank
                while k > 1:
                    k >>= 1
                    a, b = tree[2 * k], tree[2 * k + 1]
                    new = a if a <= b else b
                    if tree[k] == new:
                        break
                    tree[k] = new
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> list[int]:
        known, out = self.known, []
        for s in self.split(text):
            ids = known.get(s)
            if ids is None:
                if len(known) >= CACHE:
                    known.clear()
                ids = self.merge(s.encode("utf-8"))
                if len(s) <= 64:
                    known[s] = ids
            out.append(ids)
        return list(chain.from_iterable(out))


#: One for each vocabulary and worker process.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encode(df: DataFrame, key: Column, text: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids): the ids of each row's text. Null and empty texts give an empty list, null keys stay.

    A map over the scan: no shuffle; texts reach Python in Arrow batches, the vocabulary (a fixed 1 MB) by broadcast. Texts
    are encoded whole; a piece of n bytes takes O(n log n).
    """
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(name, folder))
    rows = df.select(key.cast("long").alias("doc_id"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get((folder, name))
        if encoder is None:
            encoder = _ENCODERS[folder, name] = Encoder(ranks.value)
        for b in batches:
            lists = [encoder.encode(t) if t else [] for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>")
