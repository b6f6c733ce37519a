"""Evaluation texts inside training texts: shared-token seeds, greedy string tiling, coverage of test windows."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiling import tiles

#: Words of an item that a document must hold.
WINDOW = 24
#: Words of a window that tiles must cover: one in six may be changed and one in six may have lost its neighbours.
COVERED = 16
#: Share of a window's information (rarer words hold more) that tiles must cover.
INFORMATION = 0.55
#: Seeds that a stretch of a document must share with an item before it is tiled: WINDOW words with a change in every six
#: keep at least this many of their runs of three tokens.
SEEDS = 6
#: Words in common that are no case; shorter items cannot leak.
NO_CASE = 7
#: Tokens between seeds of one stretch.
GAP = 40
#: Most items that are broadcast, and most characters of their texts; they are a held-out test set, of a fixed size.
MOST_ITEMS, MOST_CHARACTERS = 200_000, 64_000_000

_BREAK = re.compile("[-\u2010\u2011\u00ad][ \\t]*\\r?\\n[ \\t]*(?://+|#+|\\*+|>+|--|;+|%+)?[ \\t]*")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff\\\\_]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_TOKEN = re.compile(r"\w+")


def plain(text: str) -> str:
    """A text without what layout, markup and typography add: entities, tags, breaks within words, hidden signs, case."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _HIDDEN.sub("", _BREAK.sub("", text))
    return text.casefold() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()


def words(text: str) -> list[list[str]]:
    """Tokens of each white-space separated word that has any."""
    return [t for t in (_TOKEN.findall(w) for w in plain(text).split()) if t]


_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x632BE59BD9B4E019)


def _code(run: list[int]) -> int:
    """A hash of a run of token numbers, as candidates() makes it of whole texts; tiles compare the tokens themselves."""
    h = run[0]
    for x in run[1:]:
        h = ((h + int(_ODD)) * int(_MIX) + x) % (1 << 64)
    return h


def _least(n_words: int, n_tokens: int) -> int:
    """Seeds that an item of so many words keeps at least with a change in every six words."""
    if n_words >= WINDOW:
        return SEEDS
    # a change takes away the two runs of two that hold it; of few words one in six, rounded up, may change
    return max(1, n_tokens - 1 - 2 * max(1, math.ceil(n_words / 6)) - (n_tokens - n_words))


class Items:
    """Test items as token numbers, with the index of their seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.tokens, self.word_of, self.numbers = [], [], [], {}
        for item, text in rows:
            ws = words(text or "")
            if len(ws) <= NO_CASE:
                continue
            self.ids.append(item)
            self.tokens.append([self.numbers.setdefault(t, len(self.numbers)) for w in ws for t in w])
            self.word_of.append([k for k, w in enumerate(ws) for _ in w])
        n = max(2, len(self.ids))
        df = Counter(t for x in self.tokens for t in set(x))
        self.weight = [math.log((n + 1) / df[t]) + 0.02 if t in df else 0.0 for t in range(len(self.numbers))]
        seeds, width = defaultdict(set), []
        for k, x in enumerate(self.tokens):
            # a short item may keep few of its runs of three, or none: then runs of two are its seeds, and fewer are asked for
            short = self.word_of[k][-1] + 1 < WINDOW
            w = 2 if short else 3
            width.append(w)
            for i in range(max(0, len(x) - w + 1)):
                seeds[_code(x[i : i + w])].add(k)
        self.least = np.array([_least(w[-1] + 1, len(w)) for w in self.word_of], dtype=np.int64)
        self.codes = np.array(sorted(seeds), dtype=np.uint64)
        lists = [sorted(seeds[c]) for c in self.codes.tolist()]
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.members = np.array([k for x in lists for k in x], dtype=np.int64)

    def candidates(self, tokens: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, first, last): stretches of the document with enough seeds of the item."""
        if len(tokens) < 2 or not len(self.codes):
            return
        t, known = tokens.astype(np.uint64), tokens >= 0
        two = (t[:-1] + _ODD) * _MIX + t[1:]
        three = np.append((two[:-1] + _ODD) * _MIX + t[2:], _ODD)  # the last has no third
        whole = np.append(known[:-2] & known[1:-1] & known[2:], False)
        code, good = np.concatenate([two, three]), np.concatenate([known[:-1] & known[1:], whole])
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        where = np.flatnonzero(good & (self.codes[at] == code))
        if not len(where):
            return
        lo, n = self.starts[at[where]], self.starts[at[where] + 1] - self.starts[at[where]]
        where = where % len(two)
        pos = np.repeat(where, n)
        member = self.members[np.repeat(lo - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
        order = np.lexsort((pos, member))
        member, pos = member[order], pos[order]
        cut = np.flatnonzero((member[1:] != member[:-1]) | (pos[1:] - pos[:-1] > GAP)) + 1
        bounds = np.concatenate([[0], cut, [len(member)]])
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= self.least[member[a]]:
                yield int(member[a]), int(pos[a]), int(pos[b - 1]) + 3

    def _may_hold(self, k: int, stretch: list[int]) -> bool:
        """False if the tokens that the stretch has at all are too little for every window of the item."""
        x, word, have = self.tokens[k], self.word_of[k], set(stretch)
        win = min(WINDOW, word[-1] + 1)
        total, held = [0.0] * (word[-1] + 2), [0.0] * (word[-1] + 2)
        for t, w in zip(x, word):
            total[w + 1] += self.weight[t]
            if t in have:
                held[w + 1] += self.weight[t]
        for w in range(len(total) - 1):
            total[w + 1] += total[w]
            held[w + 1] += held[w]
        return any(held[w + win] - held[w] >= INFORMATION * (total[w + win] - total[w]) - 1e-9 for w in range(len(total) - win))

    def leaked(self, k: int, stretch: list[int]) -> bool:
        """Whether the stretch holds the item or a window of it: of WINDOW words, or all of a shorter item, enough are
        covered by tiles near each other, in whatever order, and enough of their information is."""
        x, word = self.tokens[k], self.word_of[k]
        if not self._may_hold(k, stretch):
            return False
        at = [-1] * len(x)
        for i, j, n in tiles(x, stretch):
            at[i : i + n] = range(j, j + n)
        n_words = word[-1] + 1
        win = min(WINDOW, n_words)
        need = math.ceil(COVERED * win / WINDOW)
        if len({w for w, p in zip(word, at) if p >= 0}) < need:
            return False
        first = [0] * (n_words + 1)
        for w in word:
            first[w + 1] += 1
        for w in range(n_words):
            first[w + 1] += first[w]
        for w in range(n_words - win + 1):
            lo, hi = first[w], first[w + win]
            total = sum(self.weight[x[i]] for i in range(lo, hi))
            hits = sorted((at[i], i) for i in range(lo, hi) if at[i] >= 0)
            if len({word[i] for _, i in hits}) < need:
                continue
            span, a, held = int(1.6 * (hi - lo)) + 6, 0, 0.0
            inside: Counter = Counter()
            for p, i in hits:
                inside[word[i]] += 1
                held += self.weight[x[i]]
                while p - hits[a][0] >= span:
                    q = hits[a][1]
                    held -= self.weight[x[q]]
                    inside[word[q]] -= 1
                    if not inside[word[q]]:
                        del inside[word[q]]
                    a += 1
                if len(inside) >= need and held >= INFORMATION * total:
                    return True
        return False

    def find(self, text: str) -> list[int]:
        """Ids of the items that a text leaks, each once."""
        get = self.numbers.get
        t = [get(w, -1) for w in _TOKEN.findall(plain(text))]
        tokens, out = np.array(t, dtype=np.int64), set()
        for k, a, b in self.candidates(tokens):
            if self.ids[k] not in out and self.leaked(k, t[max(0, a - 12) : b + 12]):
                out.add(self.ids[k])
        return sorted(out)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), distinct: documents that hold an item, or a window of at least WINDOW of its words.

    Differences in layout, case, punctuation, markup and typography do not matter, nor interruptions or words changed,
    dropped or added up to about one in six. Items of up to NO_CASE words are no case. Null and empty texts leak nothing.
    Documents are read whole.

    The test items, a fixed set whose size is checked, are broadcast with the index of their seeds, so the join on shared
    seeds is a map over the corpus without a shuffle; only stretches with enough seeds are tiled.
    """
    spark = documents.sparkSession
    asked = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    if size.n > MOST_ITEMS or size.chars > MOST_CHARACTERS:
        raise ValueError(f"more than {MOST_ITEMS} test items or {MOST_CHARACTERS} characters; give them in parts")
    rows = asked.collect()
    index = spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in rows]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = index.value
        for b in batches:
            out = [(d, i) for d, t in zip(b["doc_id"], b["text"]) for i in known.find(t)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    docs = documents.select("doc_id", "text").filter(F.length("text") > 0)
    return docs.mapInPandas(run, "doc_id long, item_id long").distinct()


def leak_report(found: DataFrame, documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, kind, split, n_documents, n_sources): what leaked how far; items that leaked nowhere have 0."""
    d = found.join(documents.select("doc_id", "source"), "doc_id").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("source").alias("n_sources"))
    return items.select("item_id", "kind", "split").join(d, "item_id", "left").fillna(0, ["n_documents", "n_sources"])
