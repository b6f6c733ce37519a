"""Extraction of symbols and edges from files, one function for each language, run by Python workers over scanned files."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .rows import SCHEMA, Sink

Extractor = Callable[[str, bytes], Sink]
#: Module and function of each language's extractor, (path, bytes) to rows; a module is loaded when its language is first met.
PLACES = {"python": ("python_source", "extract"), "typescript": ("typescript_source", "extract"), "go": ("go_java_source", "extract_go"), "java": ("go_java_source", "extract_java")}


class ExtractorUnavailable(RuntimeError):
    """A language's extractor is unknown or cannot be loaded; other languages are not touched by it."""


class _Registry(dict):
    def __missing__(self, language: str) -> Extractor:
        if language not in PLACES:
            raise ExtractorUnavailable(f"no extractor for {language!r}")
        module, name = PLACES[language]
        try:
            self[language] = getattr(importlib.import_module(f".{module}", __name__), name)
        except (ImportError, AttributeError) as e:
            raise ExtractorUnavailable(f"the extractor for {language!r} cannot be loaded: {e}") from e
        return self[language]


EXTRACTORS: dict[str, Extractor] = _Registry()


def extract_file(rel: str, language: str, content: bytes) -> Sink | None:
    """Rows of one file; None if its language is unknown or its extractor fails, as one file must not stop a run."""
    try:
        return EXTRACTORS[language](rel, content)
    except Exception:  # noqa: BLE001
        return None


def extract_all(files: DataFrame) -> DataFrame:
    """Rows (see rows.SCHEMA) of all files: (rel, file_seq, lang, content), content binary. A file that fails gives one row of
    kind x; every other gives at least its module."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            out = []
            for rel, seq, lang, content in zip(b["rel"], b["file_seq"], b["lang"], b["content"]):
                sink = extract_file(rel, lang, bytes(content) if content is not None else b"")
                if sink is None:
                    out.append((rel, seq, "x", 0, *[None] * 10))
                else:
                    out += [(rel, seq, *r) for r in sink.rows]
            yield pd.DataFrame(out, columns=names, dtype=object)

    return files.select("rel", "file_seq", "lang", "content").mapInPandas(run, SCHEMA)
