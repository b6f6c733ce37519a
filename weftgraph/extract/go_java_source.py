"""Symbols and edges of Go and Java files. All calls of a file count for its first function, or its module without one."""

from __future__ import annotations

from .lexer import Source, calls, first_name
from .rows import Sink

_PRIMITIVE = {"int", "long", "short", "byte", "char", "float", "double", "boolean", "void"}
_NOT_TYPES = {"return", "new", "else", "throw", "case", "assert", "yield", "instanceof", "do", "package", "import", "extends", "implements", "throws"} | {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp", "transient", "volatile"}


def _module(rel: str, language: str) -> tuple[Sink, str, str]:
    sink = Sink(rel, language)
    name = rel.rsplit(".", 1)[0].replace("/", ".")
    sink.symbol(f"{language}://{name}", "module", name, 1, True)
    return sink, f"{language}://{name}", name


def _calls(sink: Sink, s: Source, module: str, local: dict[str, str], declared: set[int], ctor: str, skip: set[str]) -> None:
    caller = next(iter(local.values()), module)
    for c in calls(s, ctor):
        if c.open in declared:
            continue
        made = s.at(c.first - 1) == "new"  # the name of a type is passed over
        name = first_name(s, c.first + made, s.partner.get(c.open, c.open), skip)
        if name:
            target = local.get(name, f"{sink.language}://{name}")
            sink.refer("CALLS", caller, target, "symbol", name, "medium" if name in local else "low", c.line)


def extract_go(rel: str, content: bytes) -> Sink:
    sink, module, _ = _module(rel, "go")
    s = Source(content)
    local: dict[str, str] = {}
    declared: set[int] = set()
    for i, t in enumerate(s.tokens):
        if t.kind != "name" or s.depth[i]:
            continue
        if t.text == "import":
            specs = range(i + 2, s.partner.get(i + 1, i + 1)) if s.at(i + 1) == "(" else range(i + 1, i + 3)
            for k in specs:
                if s.is_text(k) and s.string(k):
                    # a spec begins at its alias
                    line = s.tokens[k - 1 if (s.is_name(k - 1) and s.at(k - 1) != "import") or s.at(k - 1) == "." else k].line
                    sink.refer("IMPORTS", module, f"go://{s.string(k).replace('/', '.')}", "module", s.string(k), "high", line)
                    if s.at(i + 1) != "(":
                        break
        elif t.text == "func":
            if s.is_name(i + 1):
                local[s.at(i + 1)] = f"{module}:{s.at(i + 1)}"
                sink.define(module, f"{module}:{s.at(i + 1)}", "function", s.at(i + 1), t.line)
                k = i + 2
                declared.add(s.partner.get(k, k) + 1 if s.at(k) == "[" else k)
            elif s.at(i + 1) == "(":  # a method: no symbol, and its brackets are no call
                k = s.partner.get(i + 1, i + 1)
                declared.update((i + 1, k + 2))
                if s.at(k + 2) == "[":
                    declared.add(s.partner.get(k + 2, k + 2) + 1)
                end = s.partner.get(k + 2, k + 2)
                declared.add(end + 1)
    declared |= {i + 1 for i, t in enumerate(s.tokens) if t.text == "func"}
    for k in list(declared):  # several results in brackets
        if s.at(k) == "(" and s.at(s.partner.get(k, k) + 1) == "(":
            declared.add(s.partner[k] + 1)
    _calls(sink, s, module, local, declared, "", set())
    return sink


def extract_java(rel: str, content: bytes) -> Sink:
    sink, module, _ = _module(rel, "java")
    s = Source(content)
    local: dict[str, str] = {}
    declared: set[int] = set()
    for i, t in enumerate(s.tokens):
        if t.kind == "name" and t.text == "import" and not s.depth[i]:
            k = i + 2 if s.at(i + 1) == "static" else i + 1
            parts = []
            while s.is_name(k):
                parts.append(s.at(k))
                k += 2 if s.at(k + 1) == "." else 1
                if s.at(k - 1) != ".":
                    break
            if parts:
                name = ".".join(parts)
                sink.refer("IMPORTS", module, f"java://{name}", "module", name, "high", t.line)
        elif t.text == "(" and t.kind == "sign" and s.is_name(i - 1) and _typed(s, i - 2) and _bodied(s, i):
            first, name = _declaration(s, i)
            declared.add(i)
            local[name] = f"{module}:{name}"
            sink.define(module, f"{module}:{name}", "method", name, s.tokens[first].line)
    declared |= {i for i in range(1, len(s.tokens)) if s.at(i) == "(" and s.is_name(i - 1) and (s.at(i - 2) == "@" or s.at(i - 1) in ("this", "super") and s.at(i - 2) != "." or _constructor(s, i))}
    _calls(sink, s, module, local, declared, "new", _PRIMITIVE | {"this", "super"})
    return sink


def _typed(s: Source, i: int) -> bool:
    """Whether a type ends at token i."""
    return s.at(i) in _PRIMITIVE or s.at(i) in (">", "]") or (s.is_name(i) and s.at(i) not in _NOT_TYPES)


def _bodied(s: Source, i: int) -> bool:
    k = s.partner.get(i, i) + 1
    while s.is_name(k) or s.at(k) in (".", ",", "[", "]"):  # throws clauses, array results
        k += 1
    return s.at(k) in ("{", ";")


def _constructor(s: Source, i: int) -> bool:
    return s.at(i - 2) in ("public", "private", "protected", "{", "}", ";") and s.at(s.partner.get(i, i) + 1) == "{"


def _declaration(s: Source, i: int) -> tuple[int, str]:
    """First token of the method declaration whose brackets open at i, and its name: the first name that is no type or
    modifier, which is an annotation's where there is one."""
    k = i - 1
    while k > 0 and s.at(k - 1) not in (";", "{", "}") and not (s.at(k - 1) == ")" and s.at(s.partner.get(k - 1, 0) - 2) != "@"):
        k -= 1
    for j in range(k, i):
        if s.at(j) == "@" and s.is_name(j + 1):
            return k, s.at(j + 1)
    return k, s.at(i - 1)
