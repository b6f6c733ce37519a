import random

from hypothesis import given
from hypothesis import strategies as st

from weftgraph.llm import leakage
from weftgraph.llm.tiling import tiles

tokens = st.lists(st.integers(0, 3), max_size=25)


@given(tokens, tokens)
def test_tiles_are_disjoint_matches_and_maximal(a, b):
    found = tiles(a, b)
    for i, j, n in found:
        assert n >= 2 and a[i : i + n] == b[j : j + n]
    for side in (0, 1):
        used = [x for t in found for x in range(t[side], t[side] + t[2])]
        assert len(used) == len(set(used))
    left_a = [None if any(i <= k < i + n for i, _, n in found) else v for k, v in enumerate(a)]
    left_b = [None if any(j <= k < j + n for _, j, n in found) else v for k, v in enumerate(b)]
    pairs = {(x, y) for x, y in zip(left_a, left_a[1:]) if x is not None and y is not None}
    assert not pairs & {(x, y) for x, y in zip(left_b, left_b[1:]) if x is not None and y is not None}
    longest = max((k for i in range(len(a)) for j in range(len(b)) for k in [next((k for k in range(26) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]), 0)]), default=0)
    assert longest < 2 or max(n for *_, n in found) == longest


R = random.Random(4)
WORD = lambda: "".join(R.choice("bcdfglmnprst") + R.choice("aeiou") for _ in range(3))
ITEMS = {k: [f"Given that {WORD()}.{WORD()}_{WORD()}" if j % 6 == 0 else WORD() for j in range(60)] for k in range(30)}
NOISE = lambda n: " ".join(WORD() for _ in range(n))


def test_cases(spark):
    item = lambda k: " ".join(ITEMS[k])
    words = item(0).split()
    edited = [w if i % 6 else WORD() for i, w in enumerate(words[10:40])]
    reordered = words[30:42] + words[18:30]
    docs = {
        1: NOISE(40) + " " + item(0) + " " + NOISE(40),
        2: NOISE(40) + "\n" + " ".join(words[5:31]).upper().replace(" ", "  ") + "\n" + NOISE(9),
        3: NOISE(5) + " " + " ".join(edited) + " " + NOISE(5),
        4: NOISE(30) + " " + " ".join(words[5:12]) + " " + NOISE(30),  # seven words
        5: "\n".join("// " + " ".join(words[i : i + 8]) for i in range(0, 56, 8)),
        6: "&nbsp;".join(words[:30]).replace("_", "\\_"),
        7: " ".join(w[:2] + "­" + w[2:] for w in words[:28]),
        8: NOISE(200),
        9: " ".join(reordered),
        10: None,
        11: "",
        12: " ".join(item(k) for k in (1, 2, 3)) + NOISE(20_000),
        13: " ".join(words[i] for i in range(0, 60, 3)),  # every third word
        14: " ".join(w[:3] + "-\n  # " + w[3:] if i % 5 == 0 and len(w) > 4 and w.isalpha() else w for i, w in enumerate(words[:32])),
    }
    d = spark.createDataFrame([(k, v, "a", 1) for k, v in docs.items()] + [(1, docs[1], "b", 1)], "doc_id long, text string, source string, item_id long")
    t = spark.createDataFrame([(k, "q", "dev", item(k)) for k in ITEMS] + [(99, "q", "dev", None), (98, "q", "dev", ""), (0, "q", "dev", item(0))], "item_id long, kind string, split string, text string")
    got = {tuple(r) for r in leakage.leaks(d, t).collect()}
    assert got == {(k, 0) for k in (1, 2, 3, 5, 6, 7, 9, 14)} | {(12, k) for k in (1, 2, 3)}
    report = {r.item_id: (r.n_documents, r.n_sources) for r in leakage.leak_report(leakage.leaks(d, t), d, t).collect()}
    assert report[0] == (8, 2) and report[1] == (1, 1) and report[29] == (0, 0)
    assert leakage.leaks(d.limit(0), t).count() == 0 and leakage.leaks(d, t.limit(0)).count() == 0


def test_short_items_with_a_change_in_every_six_words():
    r = random.Random(5)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(3))
    for n in (8, 9, 10, 12, 13, 16, 20, 23):
        for changes in range(n // 6 + 1):
            for _ in range(20):
                item = [word() for _ in range(n)]
                said = list(item)
                for c in range(changes):
                    said[c * 6 + r.randrange(6)] = word()
                items = leakage.Items([(1, " ".join(item)), *((k, " ".join(word() for _ in range(30))) for k in range(2, 6))])
                noise = lambda: [word() for _ in range(30)]
                assert items.find(" ".join([*noise(), *said, *noise()])) == [1], (n, changes)
                assert items.find(" ".join([*noise(), *item[: n // 2], *noise(), *noise(), *item[n // 2 + 2 :]])) == [] or n > 16
    assert leakage.Items([(1, "one two three four five six seven")]).find("one two three four five six seven") == []


def test_very_many_tokens():
    items = leakage.Items([(k, " ".join(f"w{k}x{j}" for j in range(30))) for k in range(90_000)])  # 2.7 million tokens
    assert items.find("so " + " ".join(f"w89999x{j}" for j in range(30))) == [89_999] and items.find("w1x1 w2x2 " * 40) == []
