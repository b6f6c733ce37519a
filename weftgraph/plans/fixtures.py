"""Small source files and the rows that extraction must give for them, told by the rules of each language."""

from __future__ import annotations

TREE = {
    "a.py": "def f():\n    return g()\n",
    "b.ts": 'import { g } from "pkg-a";\nexport function f() {\n  return g();\n}\n',
    "c.go": 'package c\nimport "fmt"\nfunc F() {\n\tfmt.Println(g())\n}\nfunc g() int { return 1 }\n',
    "D.java": "import java.util.List;\nclass D {\n  int f() { return g(); }\n  int g() { return 1; }\n}\n",
    "README.md": "no code",
    "node_modules/x.js": "function no() {}",
    "pkg/__init__.py": "",
}

SOURCES = {
    "python": {
        "pkg/a.py": "import os.path\nfrom .b import g as h\n\n\nclass C(B):\n    def m(self):\n        self.n()\n        h()\n        os.path.join('')\n\n    def n(self):\n        pass\n\n\nasync def k(x, *, y):\n    k(x)\n\n\nh()\n",
        "broken.py": "def (",
        "empty.py": "",
    },
    "go": {"c.go": 'package c\nimport "net/http"\nfunc F() { g(); fmt.Println(1) }\nfunc g() { h.x() }\nfunc (t *T) M() { z() }\n'},
    "java": {"p/D.java": "import java.util.List;\nclass D {\n  int f() { return g(); }\n  int g() { return x.h(); }\n}\n"},
    "typescript": {"b.ts": 'import d, { g as k } from "./m";\nclass A extends B {\n  y = 1;\n  m() { this.n(); k(); }\n  n() {}\n}\nconst w = () => { d(); };\ninterface I { z: number }\nw();\n'},
}

# (kind, id, type, source, target, name, confidence, file, line, metadata) of every row that must come out.
EXPECTED = {
    "python": [
        ("s", "python://pkg.a", "module", None, None, "pkg.a", None, "pkg/a.py", 1, None),
        ("s", "python://os.path", "module", None, None, "os.path", None, None, None, None),
        ("e", None, "IMPORTS", "python://pkg.a", "python://os.path", None, "high", "pkg/a.py", 1, None),
        ("s", "python://b.g", "symbol", None, None, "b.g", None, None, None, None),
        ("e", None, "IMPORTS", "python://pkg.a", "python://b.g", None, "high", "pkg/a.py", 2, None),
        ("s", "python://pkg.a:C", "class", None, None, "C", None, "pkg/a.py", 5, '{"kind": "class"}'),
        ("e", None, "CONTAINS", "python://pkg.a", "python://pkg.a:C", None, "high", "pkg/a.py", 5, None),
        ("s", "python://pkg.a:C.m", "method", None, None, "m", None, "pkg/a.py", 6, '{"args": ["self"], "async": false}'),
        ("e", None, "CONTAINS", "python://pkg.a:C", "python://pkg.a:C.m", None, "high", "pkg/a.py", 6, None),
        ("s", "python://pkg.a:C.n", "symbol", None, None, "self.n", None, None, None, None),
        ("e", None, "CALLS", "python://pkg.a:C.m", "python://pkg.a:C.n", None, "high", "pkg/a.py", 7, None),
        ("e", None, "CALLS", "python://pkg.a:C.m", "python://b.g", None, "high", "pkg/a.py", 8, None),
        ("s", "python://os.path.path.join", "symbol", None, None, "os.path.join", None, None, None, None),
        ("e", None, "CALLS", "python://pkg.a:C.m", "python://os.path.path.join", None, "high", "pkg/a.py", 9, None),
        ("e", None, "CONTAINS", "python://pkg.a:C", "python://pkg.a:C.n", None, "high", "pkg/a.py", 11, None),
        ("s", "python://B", "class", None, None, "B", None, None, None, None),
        ("e", None, "INHERITS", "python://pkg.a:C", "python://B", None, "medium", "pkg/a.py", 5, None),
        ("s", "python://pkg.a:k", "function", None, None, "k", None, "pkg/a.py", 15, '{"args": ["x"], "async": true}'),
        ("e", None, "CONTAINS", "python://pkg.a", "python://pkg.a:k", None, "high", "pkg/a.py", 15, None),
        ("s", "python://k", "symbol", None, None, "k", None, None, None, None),
        ("e", None, "CALLS", "python://pkg.a:k", "python://k", None, "high", "pkg/a.py", 16, None),
        ("s", "python://broken.py", "file", None, None, "broken.py", None, "broken.py", None, '{"parse_error": "invalid syntax (<unknown>, line 1)"}'),
        ("s", "python://empty", "module", None, None, "empty", None, "empty.py", 1, None),
    ],
    "go": [
        ("s", "go://c", "module", None, None, "c", None, "c.go", 1, None),
        ("s", "go://net.http", "module", None, None, "net/http", None, None, None, None),
        ("e", None, "IMPORTS", "go://c", "go://net.http", None, "high", "c.go", 2, None),
        ("s", "go://c:F", "function", None, None, "F", None, "c.go", 3, None),
        ("e", None, "CONTAINS", "go://c", "go://c:F", None, "high", "c.go", 3, None),
        ("s", "go://c:g", "function", None, None, "g", None, "c.go", 4, None),
        ("e", None, "CONTAINS", "go://c", "go://c:g", None, "high", "c.go", 4, None),
        ("e", None, "CALLS", "go://c:F", "go://c:g", None, "medium", "c.go", 3, None),
        ("s", "go://fmt", "symbol", None, None, "fmt", None, None, None, None),
        ("e", None, "CALLS", "go://c:F", "go://fmt", None, "low", "c.go", 3, None),
        ("s", "go://h", "symbol", None, None, "h", None, None, None, None),
        ("e", None, "CALLS", "go://c:F", "go://h", None, "low", "c.go", 4, None),
        ("s", "go://z", "symbol", None, None, "z", None, None, None, None),
        ("e", None, "CALLS", "go://c:F", "go://z", None, "low", "c.go", 5, None),
    ],
    "java": [
        ("s", "java://p.D", "module", None, None, "p.D", None, "p/D.java", 1, None),
        ("s", "java://java.util.List", "module", None, None, "java.util.List", None, None, None, None),
        ("e", None, "IMPORTS", "java://p.D", "java://java.util.List", None, "high", "p/D.java", 1, None),
        ("s", "java://p.D:f", "method", None, None, "f", None, "p/D.java", 3, None),
        ("e", None, "CONTAINS", "java://p.D", "java://p.D:f", None, "high", "p/D.java", 3, None),
        ("s", "java://p.D:g", "method", None, None, "g", None, "p/D.java", 4, None),
        ("e", None, "CONTAINS", "java://p.D", "java://p.D:g", None, "high", "p/D.java", 4, None),
        ("e", None, "CALLS", "java://p.D:f", "java://p.D:g", None, "medium", "p/D.java", 3, None),
        ("s", "java://x", "symbol", None, None, "x", None, None, None, None),
        ("e", None, "CALLS", "java://p.D:f", "java://x", None, "low", "p/D.java", 4, None),
    ],
    "typescript": [
        ("s", "typescript://b", "module", None, None, "b", None, "b.ts", 1, None),
        ("s", "typescript://..m", "module", None, None, "./m", None, None, None, None),
        ("e", None, "IMPORTS", "typescript://b", "typescript://..m", None, "high", "b.ts", 1, None),
        ("s", "typescript://b:A", "class", None, None, "A", None, "b.ts", 2, None),
        ("e", None, "CONTAINS", "typescript://b", "typescript://b:A", None, "high", "b.ts", 2, None),
        ("s", "typescript://B", "class", None, None, "B", None, None, None, None),
        ("e", None, "INHERITS", "typescript://b:A", "typescript://B", None, "medium", "b.ts", 2, None),
        ("s", "typescript://b:A.y", "property", None, None, "y", None, "b.ts", 3, None),
        ("e", None, "CONTAINS", "typescript://b:A", "typescript://b:A.y", None, "high", "b.ts", 3, None),
        ("s", "typescript://b:A.m", "method", None, None, "m", None, "b.ts", 4, None),
        ("e", None, "CONTAINS", "typescript://b:A", "typescript://b:A.m", None, "high", "b.ts", 4, None),
        ("s", "typescript://b:A.n", "method", None, None, "n", None, "b.ts", 5, None),
        ("e", None, "CONTAINS", "typescript://b:A", "typescript://b:A.n", None, "high", "b.ts", 5, None),
        ("s", "typescript://b:w", "function", None, None, "w", None, "b.ts", 7, None),
        ("e", None, "CONTAINS", "typescript://b", "typescript://b:w", None, "high", "b.ts", 7, None),
        ("s", "typescript://b:I", "interface", None, None, "I", None, "b.ts", 8, None),
        ("e", None, "CONTAINS", "typescript://b", "typescript://b:I", None, "high", "b.ts", 8, None),
        ("e", None, "CALLS", "typescript://b:A.m", "typescript://b:A.n", None, "high", "b.ts", 4, None),
        ("s", "typescript://..m:k", "symbol", None, None, "k", None, None, None, None),
        ("e", None, "CALLS", "typescript://b:A.m", "typescript://..m:k", None, "medium", "b.ts", 4, None),
        ("s", "typescript://d", "symbol", None, None, "//d", None, None, None, None),
        ("e", None, "CALLS", "typescript://b", "typescript://d", None, "low", "b.ts", 7, None),
        ("e", None, "CALLS", "typescript://b", "typescript://b:w", None, "high", "b.ts", 9, None),
    ],
}
