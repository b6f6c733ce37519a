"""Symbols and edges of TypeScript and JavaScript files."""

from __future__ import annotations

from .go_java_source import _module
from .lexer import Source, calls
from .rows import Sink

_BEFORE_EXPRESSION = {"=", "(", ",", ":", "return", "?", "&&", "||", "=>", "!", "[", "new", "=="}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "async", "get", "set", "abstract", "override", "declare", "*"}


class _File:
    def __init__(self, rel: str, content: bytes):
        self.sink, self.module, _ = _module(rel, "typescript")
        self.s = Source(content)
        self.local: dict[str, str] = {}
        self.members: dict[str, dict[str, str]] = {}
        self.imports: dict[str, str] = {}
        #: first and last token and name of what a call can lie in
        self.scopes: list[tuple[int, int, str]] = []

    def end(self, i: int) -> int:
        """Last token of the statement that token i is in: at a semicolon, or where a line ends outside brackets."""
        s, k = self.s, i
        while k < len(s.tokens):
            if s.at(k) in ("(", "[", "{") and k in s.partner:
                k = s.partner[k]
            if s.at(k) == ";" or s.at(k) in (")", "]", "}") and s.partner.get(k, k) < i:
                return k - 1
            if k + 1 < len(s.tokens) and s.tokens[k + 1].line > s.tokens[k].line and k > i and s.at(k) not in ("=", "=>", ",", ".", "(", "+", "?", ":", "&&", "||") and s.at(k + 1) not in (".", "?.", "=>", "?", ":", "&&", "||", "+", "=", "{"):
                return k
            k += 1
        return len(s.tokens) - 1

    def read_imports(self) -> None:
        s = self.s
        for i, t in enumerate(s.tokens):
            if t.kind != "name" or t.text != "import" or s.depth[i] or s.at(i + 1) in ("(", "."):
                continue
            k = i + 1
            while k < len(s.tokens) and not s.is_text(k) and s.at(k) != ";":
                k += 1
            if not s.is_text(k) or not s.string(k):
                continue
            name = s.string(k)
            target = f"typescript://{name.replace('/', '.')}"
            brace = next((j for j in range(i + 1, k) if s.at(j) == "{"), None)
            names: list[str | None] = []
            if brace is not None:  # one edge for each name; a default beside them is left out
                j, end = brace + 1, s.partner.get(brace, k)
                while j < end:
                    if s.is_name(j) and s.at(j) == "type" and s.is_name(j + 1) and s.at(j + 1) != "as":
                        j += 1
                    if s.is_name(j):
                        named = s.at(j)
                        if s.at(j + 1) == "as" and s.is_name(j + 2):
                            named, j = s.at(j + 2), j + 2
                        names.append(named)
                    j += 1
            elif k == i + 1:
                names = [None]
            else:
                names = [x for x in (s.at(j) for j in range(i + 1, k) if s.is_name(j)) if x not in ("type", "as", "from")][:1] or [None]
            for n in names:
                self.sink.refer("IMPORTS", self.module, target, "module", name, "high", t.line)
                if n:
                    self.imports[n] = target

    def register(self, name: str, line: int) -> None:
        self.local[name] = f"{self.module}:{name}"
        self.sink.define(self.module, self.local[name], "function", name, line)

    def body_end(self, i: int) -> int:
        """Last token of the braces that open next after token i, not beyond the statement."""
        s, k = self.s, i
        while k < len(s.tokens) and s.at(k) not in ("{", ";"):
            k = s.partner[k] + 1 if s.at(k) in ("(", "[") and k in s.partner else k + 1
        return s.partner.get(k, k) if s.at(k) == "{" else k

    def read_definitions(self) -> None:
        s = self.s
        for i, t in enumerate(s.tokens):
            if t.kind != "name":
                if t.text == "=>":
                    self.arrow(i)
                continue
            if t.text == "function" and s.at(i - 1) not in _BEFORE_EXPRESSION:
                k = i + 2 if s.at(i + 1) == "*" else i + 1
                if s.is_name(k):
                    line = s.tokens[i - 1].line if s.at(i - 1) == "async" else t.line
                    self.register(s.at(k), line)
                    self.scopes.append((i, self.body_end(k), s.at(k)))
            elif t.text in ("const", "let", "var") and s.is_name(i + 1):
                self.variables(i + 1, self.end(i))
            elif t.text == "class" and s.is_name(i + 1) and s.at(i - 1) != ".":
                self.class_(i)
            elif t.text == "interface" and s.is_name(i + 1) and s.at(i + 2) in ("{", "extends", "<"):
                self.local[s.at(i + 1)] = f"{self.module}:{s.at(i + 1)}"
                self.sink.define(self.module, self.local[s.at(i + 1)], "interface", s.at(i + 1), t.line)

    def variables(self, a: int, end: int) -> None:
        """Declared names whose value has a function anywhere within it."""
        s, k, name = self.s, a, a
        while k <= end + 1:
            if k > end or s.at(k) == ",":
                held = range(name + 1, k)
                if s.is_name(name) and any(s.at(j) in ("=>", "function") for j in held):
                    self.register(s.at(name), s.tokens[name].line)
                name = k + 1
            if k <= end and s.at(k) in ("(", "[", "{") and k in s.partner:
                k = s.partner[k]
            k += 1

    def arrow(self, i: int) -> None:
        """An arrow function; calls within count for the first name it holds, if that is known here."""
        s = self.s
        first = s.partner.get(i - 1, i - 1) if s.at(i - 1) == ")" else i - 1
        last = s.partner.get(i + 1, i + 1) if s.at(i + 1) == "{" else self.end(i + 1)
        name = next((s.at(j) for j in range(first, last + 1) if s.is_name(j)), "")
        self.scopes.append((first, last, name))

    def class_(self, i: int) -> None:
        s, name = self.s, self.s.at(i + 1)
        me = f"{self.module}:{name}"
        line = s.tokens[i - 1].line if s.at(i - 1) == "abstract" else s.tokens[i].line
        self.local[name], self.members[name] = me, {}
        self.sink.define(self.module, me, "class", name, line)
        k = i + 2
        heritage = None
        while k < len(s.tokens) and s.at(k) != "{":
            if heritage is None and s.at(k) in ("extends", "implements"):
                heritage = k
            k += 1
        if heritage is not None and s.is_name(heritage + 1):
            parent = s.at(heritage + 1)
            self.sink.refer("INHERITS", me, f"typescript://{parent}", "class", parent, "medium", s.tokens[heritage].line)
        close = s.partner.get(k, k)
        self.scopes.append((i, close, name))
        j = k + 1
        while j < close:
            first = j
            while s.at(j) in _MODIFIERS and (s.is_name(j + 1) or s.at(j + 1) in ("*", "[")):
                j += 1
            if s.at(j) == "@":  # a decorator
                j += 2
                j = s.partner.get(j, j) + 1 if s.at(j) == "(" else j
                continue
            if s.is_name(j) and s.at(j + 1) in ("(", "<", "=", ":", ";", "?", "!"):
                member = s.at(j)
                p = j + 1
                while s.at(p) not in ("(", "=", ":", ";", "{", "}") and p < close:
                    p += 1
                method = s.at(p) == "("
                last = self.body_end(p) if method else self.end(j)
                self.members[name][member] = self.local[member] = f"{me}.{member}"
                self.sink.define(me, f"{me}.{member}", "method" if method else "property", member, s.tokens[first].line)
                if method:
                    self.scopes.append((first, last, member))
                j = last + 1
            else:
                j += 1

    def caller(self, at: int) -> str:
        """The innermost thing about a token whose name is known here, else the module."""
        for a, b, name in sorted((x for x in self.scopes if x[0] <= at <= x[1]), key=lambda x: x[1] - x[0]):
            if name in self.local:
                return self.local[name]
        return self.module

    def read_calls(self) -> None:
        s = self.s
        declared = {p for a, _, name in self.scopes for p in range(a, min(a + 8, len(s.tokens))) if s.at(p) == "(" and s.at(p - 1) == name and s.at(a) != "("}
        for c in calls(s, "new"):
            last = c.open - 1
            if c.open in declared or s.at(last) in (")", "]") or s.at(last - 1) == "function":
                continue  # a definition, or a call of what another call gave
            name = s.at(last)
            if s.at(last - 1) not in (".", "?."):
                if name in ("constructor", "super", "require") and name not in self.local and name == "super":
                    continue
                known = self.local.get(name)
                target = known or (f"{self.imports[name]}:{name}" if name in self.imports else f"typescript://{name}")
                degree = "high" if known else "medium" if name in self.imports else "low"
            else:
                # a member: the object is the first name of the expression, the method its first member
                chain = [j for j in range(c.first, c.open) if s.is_name(j)]
                obj = next((s.at(j) for j in chain if s.at(j - 1) not in (".", "?.")), None)
                method = next((s.at(j) for j in chain if s.at(j - 1) in (".", "?.")), name)
                target, degree = None, "low"
                if obj == "this":
                    target = next((m[method] for m in self.members.values() if method in m), None)
                if target is None and obj in self.members and self.local.get(obj) == f"{self.module}:{obj}":
                    target = self.members[obj].get(method)
                degree = "high" if target else "low"
                target = target or f"typescript://{method}"
            self.sink.refer("CALLS", self.caller(c.first), target, "symbol", target.rsplit(":", 1)[-1].rsplit(".", 1)[-1], degree, c.line)


def extract(rel: str, content: bytes) -> Sink:
    f = _File(rel, content)
    f.read_imports()
    f.read_definitions()
    f.read_calls()
    return f.sink
