import random

from weftgraph.llm import handwritten as h

FILE = "file_seq long, rel string, repo string, lang string, content string, reason string, bands int"


def body(seed, n=14):
    r = random.Random(seed)
    w = lambda: r.choice("anchor bucket cargo depot engine ferry gauge hoist inlet jetty kiln ledger moor node".split())
    return "".join(f"def {w()}_{w()}_{k}{'abcdefghijklmnop'[k % 16]}(items):\n    {w()} = {w()}(items)\n    if not {w()}:\n        return {w()}({r.randint(2, 99)})\n    return {w()}\n\n" for k in range(n))


def run(spark, files):
    rows = [(k, *f, None, 0) for k, f in enumerate(files)]
    return {r.rel: r.reason for r in h.not_handwritten(spark.createDataFrame(rows, FILE)).collect()}


def test_kinds(spark):
    ours = f"# Copyright 2024 alpha_1 contributors\nfrom alpha_1.core import x\n{body(1)}"
    lib = body(2)
    changed = lib.replace("return", "yield", 2) + "\ndef extra():\n    return 1\n"
    files = [
        ("alpha_1/core/a.py", "alpha_1", "python", ours),
        ("alpha_1/dist/vendor_x.py", "alpha_1", "python", f"# Strips the file that carries the DO NOT EDIT banner.\nfrom alpha_1.core import y\n{body(3)}"),
        ("alpha_1/a_pb2.py", "alpha_1", "python", f"# Copyright 2024 alpha_1 contributors\n\n# Code generated by abc. DO NOT EDIT.\n{body(4)}"),
        ("alpha_1/w.go", "alpha_1", "go", "// Diese Datei wird von abc erzeugt\n// und bei jedem Lauf ersetzt.\npackage w\nfunc A() {}\n"),
        ("alpha_1/stub.py", "alpha_1", "python", "".join(f"def get_{k}(wire):\n    return call('/s/Op{k}', wire)\n\n" for k in range(8))),
        ("alpha_1/x.min.js", "alpha_1", "typescript", "!function(e,t){" + "var a=b[1],c=!0;try{d()}catch(e){}for(;a<b;c++)d[e]^=3;" * 30 + "}"),
        ("alpha_1/table.py", "alpha_1", "python", "T = [" + ", ".join(str(k * 1.5) for k in range(300)) + "]\n"),
        ("alpha_1/rows.py", "alpha_1", "python", "code,label,weight\n" + "".join(f"{k},a{k},0.{k}\n" for k in range(40))),
        ("alpha_1/big_line.py", "alpha_1", "python", f'from alpha_1.core import z\n{body(5)}KEY = "{"q9" * 320}"\n'),
        ("alpha_1/vendor/lib_a/m.py", "alpha_1", "python", f"# vendored: lib_a@1.2.3\n\n{lib}"),
        ("beta_2/plain/m.py", "beta_2", "python", changed),  # a changed copy, not where copies lie
        ("gamma_3/plain/n.py", "gamma_3", "python", body(6)),
        ("delta_4/plain/n.py", "delta_4", "python", body(6)),  # the same file in two repositories
        ("epsilon_5/solo.py", "epsilon_5", "python", body(7)),
        ("alpha_1/none.py", "alpha_1", "python", None),
        ("alpha_1/empty.py", "alpha_1", "python", ""),
        (None, None, None, "# Code generated by abc. DO NOT EDIT."),
    ]
    got = run(spark, files + files[:3])
    assert got == {
        "alpha_1/a_pb2.py": "generated", "alpha_1/w.go": "generated", "alpha_1/stub.py": "generated", "alpha_1/x.min.js": "minified", "alpha_1/table.py": "data", "alpha_1/rows.py": "data",
        "alpha_1/vendor/lib_a/m.py": "copied", "beta_2/plain/m.py": "copied", "gamma_3/plain/n.py": "copied", "delta_4/plain/n.py": "copied"}


def test_symbols_and_empty(spark):
    assert run(spark, []) == {}
    symbols = spark.createDataFrame([("a", "x.py", "m"), ("b", None, "m"), ("c", "y.py", "m")], "id string, file string, reason string")
    found = spark.createDataFrame([("x.py", "data"), ("x.py", "data")], "rel string, reason string")
    assert {r.id for r in h.handwritten_symbols(symbols, found).collect()} == {"b", "c"}
    excluded = spark.createDataFrame([("d", None), (None, None)], "dir_name string, language string")
    more = spark.createDataFrame([("r/d/x.py", "data"), ("r/e/d", "data")], "rel string, reason string")
    assert {tuple(r) for r in h.by_directory(more, excluded).collect()} == {("data", True, 1), ("data", False, 1)}


def test_bands_meet_for_similar_bodies():
    a = body(8, 30)
    near = a.replace("cargo", "carg0", 3)
    meet = lambda x, y: bool(set(h.bands(h.shingles(x))) & set(h.bands(h.shingles(y))))
    assert meet(a, near) and not meet(a, body(9, 30))


def told(rel, repo, text):
    return h.judge(rel, repo, text, h.automaton())[:2]


def test_notices_name_tools_and_releases():
    code = f"from alpha_1.core import x\n{body(11)}"
    for head in (
        "# Created by schemagen 2.7\n", "// generated with protoc-gen-go v1.26.0\n", "# Diese Datei wurde von bauwerk erstellt.\n", "# Ce fichier a été généré par outil\n",
        "# Este archivo fue generado con herramienta\n", "# source: a/b.proto\n# built with: pbgen\n", "/* " + "x" * 5000 + " automatically generated by abc */\n", "# a\n" * 200 + "# Code generated by abc. DO NOT EDIT.\n",
    ):
        assert told("alpha_1/a.py", "alpha_1", head + code) == ("generated", "notice"), head[:60]
    for head in ("/*! jquery v3.5.1 | (c) OpenJS */\n", "# leftpad 1.2.0 Copyright 2019 Somebody\n", '"""tarlib v2.0.1, licensed under MIT"""\n', "# vendored from https://x.example/y\n"):
        assert told("alpha_1/a.py", "alpha_1", head + body(11)) == ("copied", "notice"), head
    for head in ("# Copyright 2024 alpha_1 contributors\n", "# alpha_1 v1.2 (c) 2024\n", "# Writes the file that was generated before.\n", "# Written by hand, with care\n", "# needs python 3.12 or later\n", "# Reads vendored files.\n"):
        assert told("alpha_1/a.py", "alpha_1", head + code) == (None, None), head
    assert told("alpha_1/web/package-lock.json", "alpha_1", code) == ("generated", "path") and told("alpha_1/x/node_modules/y/z.py", "alpha_1", body(11)) == ("copied", "path")
    assert told("alpha_1/node_modules/own.py", "alpha_1", code) == (None, None) and told("alpha_1/own.min.js", "alpha_1", code) == (None, None)


def test_modules_that_only_copies_use(spark):
    use = "from tarlib.inner import a\nfrom publib.api import b\n"
    files = [
        ("alpha_1/vendor/tarlib/m.py", "alpha_1", "python", f"# vendored: tarlib@1.2.3\n{use}{body(21)}"),
        ("beta_2/x/m.py", "beta_2", "python", f"{use}{body(22)}"),  # from within tarlib, though nothing else says so
        ("beta_2/x/n.py", "beta_2", "python", f"from beta_2.core import c\nfrom publib.api import b\n{body(23)}"),
        ("gamma_3/y.py", "gamma_3", "python", f"from publib.api import b\nfrom numlib.linear import c\n{body(24)}"),
    ]
    assert run(spark, files) == {"alpha_1/vendor/tarlib/m.py": "copied", "beta_2/x/m.py": "copied"}


def test_a_hot_band_makes_no_pairs_within_a_repository(spark):
    base = body(31, 30)
    rows = [(f"alpha_1/p{k}.py", "alpha_1", "python", f"{base}x_{k} = {k}\n") for k in range(60)]
    assert run(spark, rows) == {}
    got = run(spark, [*rows, ("beta_2/q.py", "beta_2", "python", base)])
    assert set(got) == {r[0] for r in rows} | {"beta_2/q.py"}  # which of them was first cannot be told
