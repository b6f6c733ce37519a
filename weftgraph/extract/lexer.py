"""A tolerant tokenizer for brace languages: enough to see imports, definitions and calls of files that do not compile."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|\s+)"""
    r"""|(?P<text>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)"""
    r"""|(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)"""
    r"""|(?P<number>\d[\w.]*)"""
    r"""|(?P<sign>=>|\.\.\.|\?\.|:=|&&|\|\||[-+*/%&|^!=<>]=|.)""",
    re.S,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int


class Source:
    """Tokens of a text, with the partner of each bracket and the depth of braces about each token."""

    def __init__(self, content: bytes):
        text = content.decode("utf-8", "replace")
        breaks = [m.start() for m in re.finditer("\n", text)]
        self.tokens = [Token(m.lastgroup, m[0], bisect_right(breaks, m.start() - 1) + 1) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
        self.partner: dict[int, int] = {}
        self.depth: list[int] = []
        stack: list[int] = []
        braces = 0
        for i, t in enumerate(self.tokens):
            self.depth.append(braces)
            if t.kind != "sign":
                continue
            if t.text in _OPEN:
                stack.append(i)
                braces += t.text == "{"
            elif t.text in _CLOSE and stack:
                k = stack.pop()
                self.partner[i], self.partner[k] = k, i
                braces -= self.tokens[k].text == "{"
        for k in stack:
            self.partner[k] = len(self.tokens) - 1

    def at(self, i: int) -> str:
        """Text of a sign or name, empty elsewhere and for strings."""
        return self.tokens[i].text if 0 <= i < len(self.tokens) and self.tokens[i].kind != "text" else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "name"

    def is_text(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "text"

    def string(self, i: int) -> str:
        return self.tokens[i].text.strip("\"'`")

    def operand(self, i: int) -> int:
        """First token of the chain of names, members, indexes and calls that ends at token i."""
        while True:
            if self.at(i) in (")", "]") and i in self.partner:
                i = self.partner[i]
                if not (self.is_name(i - 1) or self.at(i - 1) in (")", "]")) or self.at(i - 1) in KEYWORDS:
                    return i
                i -= 1
                continue
            if self.at(i - 1) in (".", "?."):
                i -= 2
                continue
            return i


# Names before a bracket that are no calls in any of the languages.
KEYWORDS = set("if for while switch catch return func function else case do new throw typeof await yield in of instanceof delete void super go defer select range try synchronized assert import class interface struct map chan var const let type package async extends implements export default".split())


@dataclass(slots=True)
class Call:
    first: int
    open: int
    line: int


def calls(s: Source, ctor: str = "") -> list[Call]:
    """Calls in order of where their expressions begin, outer ones first. ctor: the word before a constructor, whose brackets
    are no call."""
    out = []
    for p, t in enumerate(s.tokens):
        if t.kind != "sign" or t.text != "(" or p == 0:
            continue
        before = p - 1
        if not (s.is_name(before) and s.at(before) not in KEYWORDS or s.at(before) in (")", "]")):
            continue
        first = s.operand(before)
        if ctor and s.at(first - 1) == ctor and s.is_name(first) and s.partner.get(p) is not None and _plain(s, first, before):
            continue
        if s.at(first) in ("(", "[") and first == s.partner.get(before) and s.at(first - 1) in KEYWORDS:
            continue
        out.append(Call(first, p, s.tokens[first].line))
    out.sort(key=lambda c: (c.first, -s.partner.get(c.open, c.open)))
    return out


def _plain(s: Source, a: int, b: int) -> bool:
    return all(s.is_name(i) or s.at(i) in (".", "<", ">", ",") for i in range(a, b + 1))


def first_name(s: Source, a: int, b: int, skip: set[str] = frozenset()) -> str | None:
    """The first name of tokens a to b that is no keyword."""
    for i in range(a, b + 1):
        if s.is_name(i) and s.at(i) not in KEYWORDS and s.at(i) not in skip:
            return s.at(i)
    return None
