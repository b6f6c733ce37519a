"""Symbols and edges of Python files, by the standard parser."""

from __future__ import annotations

import ast

from .rows import Sink

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.expr) -> str | None:
    """The dotted name of an expression: of a call its function's, of an attribute of something nameless the attribute."""
    parts: list[str] = []
    while True:
        match node:
            case ast.Name(id=x):
                return ".".join([x, *reversed(parts)])
            case ast.Attribute(value=inner, attr=x):
                parts.append(x)
                node = inner
            case ast.Call(func=inner):
                node = inner
            case _:
                return ".".join(reversed(parts)) or None


class _Module:
    def __init__(self, sink: Sink, module: str, intended: bool):
        self.sink, self.module, self.intended = sink, module, intended
        self.aliases: dict[str, str] = {}
        self.functions: set[str] = set()

    def bind(self, body: list[ast.stmt]) -> None:
        """Names that the module's body imports or defines. An alias stands for the whole dotted target; only plain, not
        async, functions count as local; the dots of a relative import are dropped."""
        for node in body:
            match node:
                case ast.Import(names=names):
                    for a in names:
                        self._import(a.asname or a.name.partition(".")[0], a.name, "module", node.lineno)
                case ast.ImportFrom(module=base, names=names):
                    for a in names:
                        self._import(a.asname or a.name, f"{base}.{a.name}" if base else a.name, "symbol", node.lineno)
                case ast.FunctionDef(name=name):
                    self.functions.add(name)

    def _import(self, alias: str, target: str, as_type: str, line: int) -> None:
        self.aliases[alias] = target
        self.sink.refer("IMPORTS", self.module, f"python://{target}", as_type, target, "high", line)

    def resolve(self, name: str, owner: str | None, methods: set[str]) -> str:
        head, _, rest = name.partition(".")
        if owner and head == "self" and rest in methods:
            return f"{self.module}:{owner}.{rest}"
        if name in self.functions:
            return f"{self.module}:{name}"
        if head in self.aliases:
            return f"python://{self.aliases[head]}" + (f".{rest}" if rest else "")
        return f"python://{name}"

    def confidence(self, name: str, target: str) -> str:
        """high, as every id has a colon; the intended degrees only on request."""
        if not self.intended or ":" in target.removeprefix("python://"):
            return "high"
        head = name.partition(".")[0]
        if head in self.aliases:
            return "high" if "." in name else "medium"
        return "low" if "." not in name and head not in dir(__builtins__) else "medium"

    def function(self, node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None = None, methods: set[str] = frozenset()) -> None:
        parent = f"{self.module}:{owner}" if owner else self.module
        me = f"{parent}.{node.name}" if owner else f"{parent}:{node.name}"
        about = {"args": [a.arg for a in node.args.args], "async": isinstance(node, ast.AsyncFunctionDef)}
        self.sink.define(parent, me, "method" if owner else "function", node.name, node.lineno, about)
        for call in ast.walk(node):  # decorators, defaults and nested functions too
            if isinstance(call, ast.Call) and (name := dotted(call.func)):
                target = self.resolve(name, owner, methods)
                self.sink.refer("CALLS", me, target, "symbol", name, self.confidence(name, target), call.lineno)

    def class_(self, node: ast.ClassDef, methods: set[str]) -> None:
        me = f"{self.module}:{node.name}"
        self.sink.define(self.module, me, "class", node.name, node.lineno, {"kind": "class"})
        for item in node.body:
            if isinstance(item, FUNCTIONS):
                self.function(item, node.name, methods)
        for base in node.bases:
            if name := dotted(base):
                self.sink.refer("INHERITS", me, self.resolve(name, node.name, methods), "class", name, "medium", base.lineno)


def extract(rel: str, content: bytes, intended: bool = False) -> Sink:
    sink = Sink(rel, "python")
    try:
        tree = ast.parse(content.decode("utf-8", "replace"))
    except (SyntaxError, ValueError, RecursionError) as e:
        sink.symbol(f"python://{rel}", "file", rel.rsplit("/", 1)[-1], None, True, {"parse_error": str(e)})
        return sink
    name = (rel[:-3] if rel.endswith(".py") else rel).replace("/", ".") if rel.endswith(".py") else rel
    module = f"python://{name}"
    sink.symbol(module, "module", name, 1, True)
    m = _Module(sink, module, intended)
    m.bind(tree.body)
    # of classes of one name the last tells the methods of all
    methods = {c.name: {f.name for f in c.body if isinstance(f, FUNCTIONS)} for c in tree.body if isinstance(c, ast.ClassDef)}
    for node in tree.body:
        if isinstance(node, FUNCTIONS):
            m.function(node)
        elif isinstance(node, ast.ClassDef):
            m.class_(node, methods[node.name])
    return sink
