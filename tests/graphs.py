"""Small graphs for tests."""

from weftgraph.graph import CodeGraph

SYMBOLS = "ord long, id string, type string, language string, name string, file string, line int, metadata string"
EDGES = "seq long, type string, source string, target string, language string, confidence string, file string, line int"


def make(spark, symbols, edges, meta=None):
    s = [(k, i, t, "python", n, f, line, None) for k, (i, t, n, f, line) in enumerate(symbols)]
    e = [(k, t, a, b, "python", c, f, line) for k, (t, a, b, c, f, line) in enumerate(edges)]
    return CodeGraph(spark.createDataFrame(s, SYMBOLS), spark.createDataFrame(e, EDGES), meta or {})


def two_modules(spark):
    p = "python://"
    symbols = [
        (p + "m1", "module", "m1", "m1.py", 1),
        (p + "m1:f", "function", "f", "m1.py", 5),
        (p + "m1:g", "function", "g", "m1.py", 15),
        (p + "m2", "module", "m2", "m2.py", 1),
        (p + "m2:C", "class", "C", "m2.py", 3),
        (p + "m2:C.run", "method", "run", "m2.py", 8),
    ]
    edges = [
        ("CONTAINS", p + "m1", p + "m1:f", "high", "m1.py", 5),
        ("CONTAINS", p + "m1", p + "m1:g", "high", "m1.py", 15),
        ("CONTAINS", p + "m2", p + "m2:C", "high", "m2.py", 3),
        ("CONTAINS", p + "m2:C", p + "m2:C.run", "high", "m2.py", 8),
        ("CALLS", p + "m1:f", p + "m1:g", "high", "m1.py", 10),
        ("CALLS", p + "m2:C.run", p + "m1:f", "medium", "m2.py", 12),
        ("IMPORTS", p + "m2", p + "m1", "high", "m2.py", 1),
    ]
    return make(spark, symbols, edges)
