"""Rows that extraction of one file gives, in the order in which they are found."""

from __future__ import annotations

import json

#: One table for both kinds, so that a file is read once: kind is s for a symbol, e for an edge.
SCHEMA = "rel string, file_seq long, kind string, emit long, id string, type string, source string, target string, language string, name string, confidence string, file string, line int, metadata string"


class Sink:
    """Collects the symbols and edges of one file; of equal ids only the first symbol stays."""

    def __init__(self, rel: str, language: str):
        self.rel, self.language, self.rows, self.ids = rel, language, [], set()

    def symbol(self, id_: str, type_: str, name: str, line: int | None = None, here: bool = False, metadata: dict | None = None) -> None:
        if id_ not in self.ids:
            self.ids.add(id_)
            text = None if metadata is None else json.dumps(metadata, sort_keys=True)
            self.rows.append(("s", len(self.rows), id_, type_, None, None, self.language, name, None, self.rel if here else None, line, text))

    def edge(self, type_: str, source: str, target: str, confidence: str, line: int | None) -> None:
        self.rows.append(("e", len(self.rows), None, type_, source, target, self.language, None, confidence, self.rel, line, None))

    def define(self, parent: str, id_: str, type_: str, name: str, line: int, metadata: dict | None = None) -> None:
        """A definition in this file, and that its parent contains it."""
        self.symbol(id_, type_, name, line, True, metadata)
        self.edge("CONTAINS", parent, id_, "high", line)

    def refer(self, type_: str, source: str, target: str, as_type: str, name: str, confidence: str, line: int | None) -> None:
        """A reference; its target is a placeholder unless it is known by then."""
        self.symbol(target, as_type, name)
        self.edge(type_, source, target, confidence, line)
