"""Personal information inside free text: found by a character tagger, its ends checked exactly, replaced by placeholders."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import partitions_for
from . import tagger
from .tagger import KINDS

#: Weights that train_pii writes.
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")
#: Characters that are tagged at a time.
CHUNK = 1_000_000
#: Rows of a partition.
ROWS = 2500

_AT = r"(?:[ \t]?@[ \t]?|[ \t]?[\[({][ \t]?at[ \t]?[\])}][ \t]?|[ \t]+at[ \t]+)"
_DOT = r"(?:\.|[ \t]?[\[({][ \t]?dot[ \t]?[\])}][ \t]?|[ \t]+dot[ \t]+)"
_EMAIL = re.compile(rf"[\w.%+\-]*[\w%+\-]{_AT}[\w\-]+(?:{_DOT}[\w\-]+)*{_DOT}[A-Za-z]{{2,}}", re.I)
_GROUP = r"(?:\(\d{1,4}\)|\d+)"
_PHONE = re.compile(rf"(?<![\w.+])\+?{_GROUP}(?:[  \-‐‑‒–./]{{0,2}}{_GROUP})+(?!\w)")
_PHONE_BROKEN = re.compile(rf"(?<![\w.+])\+?{_GROUP}(?:[\s\-‐‑‒–./]{{0,3}}{_GROUP})+(?!\w)")
_ID = re.compile(
    r"(?<!\w)(?:[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-Z]|[A-Z]{1,2}\d{6,8}[A-Z]?|\d{7,9}\s?-?\s?[A-Z]|\d{4}[ -]\d{4}[ -]\d{4}|\d{3}[-\s]\d{2}[-\s]\d{4}|\d{2,3}/\d{3}/\d{4,5}|\d{2}\s\d{3}\s\d{3}\s\d{3}|\d{9,12})(?!\w)"
)
#: Groups of 3, 2 and 4 or of three times 4 digits, or parted by two strokes, are written for identity numbers alone; of 3, 3 and
#: 4 for phones.
_NO_PHONE = re.compile(r"\d{3}[-\s]\d{2}[-\s]\d{4}|\d{4}[-\s]\d{4}[-\s]\d{4}|\d{2,3}/\d{3}/\d{4,5}")
_NO_ID = re.compile(r"\d{3}[.\u2011-]\d{3}[.\u2011-]\d{4}")
_PLACE = r"[A-ZÀ-Þ][\w'’]+(?:-[A-ZÀ-Þ]?[\w'’]+)*"
_WAY = r"(?:Street|Road|Lane|Avenue|Close|Court|Row|Way|Drive|Place|Terrace|Square|Crescent|Boulevard|Hill|St|Rd|Ave|Ln|Dr|Ct|Blvd)\b\.?"
_ADDRESS = [
    re.compile(
        rf"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.?\s?\w+\s*,?\s+)?\d+[A-Za-z]?,?\s+(?:[A-ZÀ-Þ][\w'’\-]+\s+){{1,3}}{_WAY}(?:\s*,\s*|\s+){_PLACE}(?:\s*,?\s+(?:\d{{5}}(?:-\d{{4}})?|[A-Z]{{1,2}}\d{{1,2}}[A-Z]?\s?\d[A-Z]{{2}})\b)?"
    ),
    re.compile(rf"[A-ZÀ-Þ][\w.\-]*\s\d+(?:\s?[a-z])?\s*,?\s+(?:[A-Z]{{1,2}}-)?\d{{4,5}}\s+{_PLACE}"),
    re.compile(
        rf"\d+(?:\s?(?:bis|ter|quater)\b)?\s*,?\s+(?:rue|avenue|chemin|boulevard|impasse|place|quai|allée|route|cours)\s[^,\n;]{{2,40}}?(?:\s*,\s*|\s+[-–]\s+|\s*\n\s*)\d{{5}}\s+{_PLACE}",
        re.I,
    ),
    re.compile(rf"(?:C/|Calle|Avda\.?|Avenida|Plaza|Paseo|Camino)\s?(?:[\w'’]+\s+){{1,5}}\d+(?:\s?[a-z]\b)?\s*,?\s+\d{{5}}\s+{_PLACE}"),
]
_TITLE = re.compile(r"^(?:(?:Frau|Herrn?|Mrs?|Ms|Dr|Prof|Sir|Madame|Mme|Monsieur|Señora?|Sra?|Don|Doña)\b\.?\s+)+", re.I)
_PARTICLES = {"van", "von", "de", "del", "della", "der", "den", "di", "da", "do", "dos", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "ten", "zu", "y", "e"}
_GAP = np.zeros(1, dtype=np.uint8)
_EDGE = " \t\r\n,;:.!?\"'()[]{}<>|/*#=-–"


def _best(patterns: list[re.Pattern], text: str, a: int, b: int, reach: int) -> tuple[int, int] | None:
    """The match that shares most with [a, b), if it shares half of itself or of the span."""
    lo, hi = max(0, a - reach), min(len(text), b + reach)
    best, most = None, 0
    for p in patterns:
        at = lo
        while at < b and (m := p.search(text, at, hi)) and m.start() < b:
            shared = min(b, m.end()) - max(a, m.start())
            if shared > most and 2 * shared >= min(b - a, m.end() - m.start()):
                best, most = m.span(), shared
            # a match may hide a better one that begins within it, but not within the same word
            at = m.end() if m.start() >= a else m.start() + 1
            while at < b and at > lo and text[at - 1].isalnum() and text[at].isalnum():
                at += 1
    return best


def _words(text: str, a: int, b: int) -> tuple[int, int]:
    """The span, out to whole words, in from signs at its ends."""
    while a > 0 and text[a - 1].isalpha() and text[a].isalpha():
        a -= 1
    while b < len(text) and text[b].isalpha() and text[b - 1].isalpha():
        b += 1
    while a < b and text[a] in _EDGE:
        a += 1
    while a < b and text[b - 1] in _EDGE:
        b -= 1
    return a, b


def checked(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The exact ends of what the tagger saw at [a, b), or None if it cannot be of its kind. Patterns mend the ends of the usual
    forms; other forms keep the tagger's ends, out to whole words."""
    if kind == "email":
        span = _best([_EMAIL], text, a, b, 60)
        if span:
            return span
        a, b = _words(text, a, b)
        return (a, b) if b - a >= 6 and re.search(r"@|\bat\b", text[a:b], re.I) and not re.search(r"[/:;,]", text[a:b]) else None
    if kind == "phone":
        span = _best([_PHONE_BROKEN if "\n" in text[a:b].strip() else _PHONE], text, a, b, 24) or _words(text, a, b)
        own = text[span[0] : span[1]]
        return span if 7 <= sum(c.isdigit() for c in own) <= 15 and not re.search(r"[A-Za-z_:]{2}|[=<>{}]", own) else None
    if kind == "id_number":
        span = _best([_ID], text, a, b, 16)
        if span:
            return span
        a, b = _words(text, a, b)
        return (a, b) if sum(c.isdigit() for c in text[a:b]) >= 5 else None
    if kind == "address":
        span = _best(_ADDRESS, text, a, b, 80)
        if span:
            return span
        a, b = _words(text, a, b)
        own = text[a:b]
        return (a, b) if b - a >= 10 and len(own.split()) >= 3 and any(c.isdigit() for c in own) and not re.search(r"[(){}=<>@_]|://", own) else None
    a, b = _words(text, a, b)
    # a name goes on over hyphens and apostrophes within its words
    while b + 1 < len(text) and text[b] in "-'’" and text[b + 1].isalpha() and not re.match(r"['’][sS]\b", text[b:]):
        b = _words(text, a, b + 2)[1]
    while a > 1 and text[a - 1] in "-'’" and text[a - 2].isalpha():
        a = _words(text, a - 2, b)[0]
    if m := _TITLE.match(text[a:b]):
        a += m.end()
    if text[a:b].endswith(("'s", "’s")):
        b -= 2
    words = [w for w in re.split(r"[\s,]+", text[a:b]) if w]
    if re.match(rf"{_WAY},", text[a:b]):
        return None  # the end of an address
    # a name has capitals in all its words, or in none; particles aside
    cases = {w[0].isupper() for w in words if w.lower() not in _PARTICLES and (w[0].isupper() or w[0].islower())}
    good = len(words) >= 2 and len(cases) == 1 and all(w[0].isalpha() for w in words) and sum(len(w.strip(".")) > 1 for w in words) >= 1
    return (a, b) if good and not re.search(r"[\d@_/=:;|<>(){}]", text[a:b]) and len(words) <= 6 else None


def find(weights: dict, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) in each text, in order, without overlap: of two that overlap the longer, then the first.

    A small network of the same kind, four characters a step, screens the whole of every text; what it keeps is cut into
    overlapping windows, each decoded by itself, and what they say is reconciled over the whole text. What is found in a
    text does not depend on the texts beside it.
    """
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    k = 0
    while k < len(texts):
        first, size, parts, begins = k, 0, [], []
        while k < len(texts) and (size == 0 or size + len(texts[k]) < CHUNK):
            begins.append(size)
            parts += [tagger.codes(texts[k]), _GAP]
            size += len(texts[k]) + 1
            k += 1
        stream, at = np.concatenate(parts), np.array(begins)
        kept = tagger.stretches(weights, stream, at, np.append(at[1:], size) - 1)
        for a, b, kind in tagger.spans(tagger.tag(weights, stream, *kept)):
            i = int(np.searchsorted(at, a, side="right")) - 1
            text = texts[first + i]
            if span := checked(text, a - begins[i], b - begins[i], KINDS[kind]):
                name = KINDS[kind]
                if name == "phone" and _NO_PHONE.fullmatch(text, *span):
                    name = "id_number"
                elif name == "id_number" and _NO_ID.fullmatch(text, *span):
                    name = "phone"
                out[first + i].append((*span, name))
    return [_apart(x) for x in out]


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    kept: list[tuple[int, int, str]] = []
    for s in sorted(set(found), key=lambda x: (x[0] - x[1], x[0])):
        if all(s[1] <= o[0] or s[0] >= o[1] for o in kept):
            kept.append(s)
    return sorted(kept)


def load(path: str = WEIGHTS) -> dict:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


def _spread(documents: DataFrame) -> DataFrame:
    docs = documents.select("doc_id", "text")
    return docs.repartition(partitions_for(docs.sparkSession, docs.count(), ROWS))


def personal(documents: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, kind, found), distinct: what each text has of personal information.

    kind: email, phone, id_number, address or name; found: the exact piece of the text. Texts are read whole; null and
    empty ones have nothing. Rows are spread by turns, so no hot key and no long texts side by side make a slow task; the
    weights, of fixed size, are broadcast.
    """
    w = documents.sparkSession.sparkContext.broadcast(load(weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            out = [(d, kind, t[x:y]) for d, t, spans in zip(b["doc_id"], texts, find(w.value, texts)) for x, y, kind in spans]
            yield pd.DataFrame(out, columns=["doc_id", "kind", "found"]).drop_duplicates()

    rows = _spread(documents.filter(F.length("text") > 0))
    return rows.mapInPandas(run, "doc_id long, kind string, found string").distinct()


def redacted(documents: DataFrame, weights: str = WEIGHTS) -> DataFrame:
    """(doc_id, text, n_found): every document with a placeholder like <EMAIL> for each piece found and the rest unchanged;
    null texts stay null."""
    w = documents.sparkSession.sparkContext.broadcast(load(weights))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, n = [], []
            for t, spans in zip(b["text"], find(w.value, [t or "" for t in b["text"]])):
                n.append(len(spans))
                for x, y, kind in reversed(spans):
                    t = f"{t[:x]}<{kind.upper()}>{t[y:]}"
                out.append(t)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": out, "n_found": n})

    return _spread(documents).mapInPandas(run, "doc_id long, text string, n_found int")
