"""Trains the tagger and its screen and writes their weights: python -m weftgraph.llm.train_pii FOLDER [PROCESSES].

One seeded run of fixed steps; the same command on the same machine gives the same weights. Labelled text is generated
(pii_text). FOLDER holds a documents and a contributors table, of which at most MOST_ROWS rows of documents are read: lines
without anything that looks like personal information or names a contributor are background, beside lines of Python's own
documentation; lines whose personal information is certain (a contributor's full name, an address of a mailbox, plain forms
of numbers) lend their words as contexts, the values in them are always made up.
"""

from __future__ import annotations

import multiprocessing
import os
import re
import sys
import time
from collections import Counter

import numpy as np

from . import pii_text, tagger
from .pii import _ADDRESS, _EMAIL, _ID, WEIGHTS, find

#: Rows of documents that background lines are taken from.
MOST_ROWS = 4000
#: Steps and seeds; windows of a step and process, and their characters.
STEPS, SCREEN_STEPS, SEED = 7600, 4500, 20
WINDOWS, LENGTH = 40, 160
#: Rate of steps at the start, least part of it at the end.
RATE, LAST = 0.006, 0.01
#: Share of held-out pieces that the screen may miss.
MISSED = 0.003
#: Lines that must hold a word in small letters for it to be no name where it is capital.
COMMON = 20
_SUSPECT = re.compile(r"@|\(at\)|\[at\]|\bat\b.*\bdot\b|\d[\d ./()-]{6,}\d|\b\d{5}\b|(?i:\btel\b|phone|passport|street|road|\brue\b|calle|stra(?:ß|ss)e)")
_DATE = re.compile(r"\b\d{4}-\d\d-\d\d\b")
_CAPITALS = re.compile(r"\b(?=([A-ZÀ-Þ][\w'’-]*\.?,? +(?:(?:van|von|de|del|der|di|la) +)*[A-ZÀ-Þ][\w'’-]*))")


#: Digits after such a word are no person's.
_COUNTED = re.compile(r"(?i:\b(?:order|ticket|build|commit|run|branch|job|invoice|version|row|line|issue|case|serial|hash|port|revision|request)s?\b\W+(?:(?:id|no|nr|number|is|was)\W+)?)[\d(][\d ./()-]{4,}\d")
_PHONE = re.compile(r"(?<![\w.])(?:\+\d[\d \u00a0()./\u2011-]{7,}\d|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[.\u2011-]\d{3}[.\u2011-]\d{4})(?![\w-])")


def _people(folder: str) -> tuple[set[str], re.Pattern]:
    """Words of the contributors' names, and the pattern of their full names."""
    import pyarrow.parquet as pq

    people = [(p["given_name"], p["family_name"]) for p in pq.read_table(f"{folder}/contributors.parquet", columns=["given_name", "family_name"]).to_pylist() if p["given_name"] and p["family_name"]]
    known = {w.casefold() for p in people for v in p for w in re.findall(r"\w{3,}", v)}
    given, family = ("|".join(sorted({re.escape(p[i]) for p in people}, key=len, reverse=True)) for i in (0, 1))
    return known, re.compile(rf"(?<!\w)(?:(?:{given}|[A-Z]\.)(?: [A-Z]\.)? (?:{family})|(?:{family}), (?:{given}))(?!\w)", re.I)


def sample(folder: str) -> tuple[list[str], list[list[str]]]:
    """(background, contexts). Background: lines without forms of personal information, known people, and two capital words of
    which none is common in small letters. Contexts: [text, kind, text, kind, ..., text] of lines that have nothing else."""
    import pyarrow.parquet as pq
    from pydoc_data import topics

    known, named = _people(folder)
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["text"]).column("text").to_pylist()[:MOST_ROWS]
    whole = {x for t in [*rows, *topics.topics.values()] for x in re.split(r"\r?\n", t or "") if 8 < len(x) < 300}
    lines = {x for y in whole for x in re.split(r"(?<=[.?!]) ", y) if 8 < len(x)}
    count = Counter(w for x in lines for w in set(re.findall(r"(?<![\w.])[a-zà-ÿ]+", x)))

    def clean(x: str) -> bool:
        if _SUSPECT.search(_COUNTED.sub("", _DATE.sub("", x))) or known & set(re.findall(r"\w{3,}", x.casefold())) - count.keys():
            return False
        return not any(all(count[w.casefold()] < COMMON for w in re.findall(r"\w{2,}", p)) for p in _CAPITALS.findall(x))

    contexts = set()
    for x in lines | whole:
        found = [(*m.span(), k) for k, ps in (("N", [named]), ("A", _ADDRESS), ("E", [_EMAIL]), ("P", [_PHONE])) for p in ps for m in p.finditer(x)]
        if m := re.search(rf"(?i:{'|'.join(map(re.escape, sorted(sum(pii_text.LABELS.values(), []), key=len, reverse=True)))})", x):
            found += [(*m.span(), "K"), *((*i.span(), "I") for i in _ID.finditer(x))]
        found.sort()
        if not any(k in "NAEPI" for *_, k in found) or any(b > a2 for (_, b, _), (a2, *_) in zip(found, found[1:])) or re.search(r"://|git@", x):
            continue
        parts, at = [], 0
        for a, b, k in found:
            parts += [x[at:a], k]
            at = b
        parts.append(x[at:])
        if clean(rest := " ~ ".join(parts[::2])) and not re.search(r"\d{5}|\b\d{1,4},? [A-ZÀ-Þ]", rest) and not any(re.search(r"\w$", u) or re.match(r"[\w@]", v) for u, v in zip(parts[::2], parts[2::2])):
            contexts.add(tuple(parts))
    return sorted(x for x in lines if clean(x)), sorted(map(list, contexts))


def labels(size: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(size, dtype=np.int8)
    for a, b, k in spans:
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def batch(source: pii_text.Source, rare: float, length: int = LENGTH, windows: int = WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of consecutive windows of generated text."""
    text, spans = source.stream(windows * length + 200, rare)
    x, y = tagger.codes(text), labels(len(text), spans)
    at = source.r.randint(0, len(x) - windows * length)
    w, t = x[at : at + windows * length].reshape(windows, length), y[at : at + windows * length].reshape(windows, length).copy()
    first = t[:, 0]  # a cut span begins again in the next window
    t[:, 0] = np.where((first > 0) & (first % 2 == 0), first - 1, first)
    return w, t


def _work(rank: int, count: int, lines: tuple, shapes: dict, shared, barrier, steps: int, screen: bool) -> None:
    names = sorted(shapes)
    sizes = [int(np.prod(shapes[n])) for n in names]
    cuts = np.cumsum(sizes)[:-1]
    total = sum(sizes)
    everyone = np.frombuffer(shared, dtype=np.float32).reshape(count + 1, total + 1)
    p = everyone[count, :total].copy()
    m, s = np.zeros_like(p), np.zeros_like(p)
    source, mean, began = pii_text.Source(SEED * 1000 + rank + (500 if screen else 0), *lines), 0.0, time.time()
    for step in range(1, steps + 1):
        named = {n: v.reshape(shapes[n]) for n, v in zip(names, np.split(p, cuts))}
        w, t = batch(source, (1.0, 0.25)[step % 2])
        value, g = (tagger.screen_loss if screen else tagger.loss)(named, w, t)
        everyone[rank, :total] = np.concatenate([g[n].ravel() for n in names])
        everyone[rank, total] = value
        barrier.wait()
        d = everyone[:count].mean(axis=0)
        barrier.wait()
        value, d = float(d[total]), d[:total]
        d *= min(1.0, 0.5 / (float(np.sqrt((d * d).sum())) + 1e-9))
        left = 1 - (step - 1) / steps
        rate = RATE * min(1, step / 50) * max(LAST, left)
        m = 0.9 * m + 0.1 * d
        s = 0.999 * s + 0.001 * d * d
        p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        mean = value if step == 1 else 0.98 * mean + 0.02 * value
        if rank == 0 and step % 200 == 0:
            print("screen" if screen else "tagger", step, round(mean, 5), round(time.time() - began), flush=True)
    if rank == 0:
        everyone[count, :total] = p


def fit(p: dict, lines: tuple, steps: int, screen: bool, count: int) -> dict:
    """Weights after ``steps``: every process has its own text, the mean of all gradients makes a step."""
    context = multiprocessing.get_context("fork")
    names = sorted(p)
    flat = np.concatenate([p[n].ravel() for n in names]).astype(np.float32)
    shared = context.RawArray("f", (count + 1) * (len(flat) + 1))
    last = np.frombuffer(shared, dtype=np.float32).reshape(count + 1, len(flat) + 1)[count]
    last[: len(flat)] = flat
    barrier = context.Barrier(count)
    shapes = {n: p[n].shape for n in names}
    workers = [context.Process(target=_work, args=(k, count, lines, shapes, shared, barrier, steps, screen)) for k in range(count)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    if any(w.exitcode for w in workers):
        raise RuntimeError("a process of the training ended early")
    cuts = np.cumsum([p[n].size for n in names])[:-1]
    return {n: v.reshape(shapes[n]) for n, v in zip(names, np.split(last[: len(flat)].copy(), cuts))}


def least(p: dict, lines: tuple, missed: float = MISSED) -> tuple[float, float]:
    """The greatest level of the screen at which at most ``missed`` of held-out pieces have no block of it, and the share of
    characters that it then keeps."""
    source, best, kept = pii_text.Source(SEED * 1000 + 999, *lines), [], []
    for _ in range(200):
        text, spans = source.stream(20_000, 0.2)
        x = tagger.codes(text)
        x = np.append(x, np.zeros(-len(x) % tagger.SCREEN_LENGTH, dtype=np.uint8))
        z = tagger.screen(p, x.reshape(-1, tagger.SCREEN_LENGTH)).ravel()
        best += [float(z[a // tagger.BLOCK : (b - 1) // tagger.BLOCK + 1].max()) for a, b, _ in spans]
        kept.append(z)
    level = float(np.quantile(best, missed))
    return level, float(np.mean(np.concatenate(kept) >= level))


def eagerness(p: dict, lines: tuple) -> float:
    """What is added to the score of beginning a piece, so that held-out text has the best balance (F1) of precision and
    recall."""
    source, texts, want = pii_text.Source(SEED * 1000 + 998, *lines), [], []
    for _ in range(150):
        text, spans = source.stream(900)
        texts.append(text.replace("\0", " "))
        want.append({(*x[:2], tagger.KINDS[x[2]]) for x in spans})
    best, most = 0.0, -1.0
    for add in np.arange(0, 3.01, 0.25):
        t = p["t"].copy()
        t[0, 1::2] += add
        got = find(p | {"t": t}, texts)
        f1 = 2 * sum(len(w & set(g)) for w, g in zip(want, got)) / (sum(map(len, want)) + sum(map(len, got)))
        if f1 > most:
            best, most = float(add), f1
    return best


def main(folder: str, count: int = 8, out: str = WEIGHTS) -> None:
    lines = sample(folder)
    print(len(lines[0]), "lines of background,", len(lines[1]), "contexts", flush=True)
    p = fit(tagger.fresh(SEED), lines, STEPS, False, count)
    q = fit(tagger.fresh_screen(SEED + 1), lines, SCREEN_STEPS, True, count)
    half = {k: v.astype(np.float16) for k, v in (p | q).items()}
    read = {k: v.astype(np.float32) for k, v in half.items()}
    level, kept = least(read, lines)
    print("screen keeps blocks from", round(level, 3), "that is", round(kept, 4), "of them", flush=True)
    add = eagerness(read | {"least": np.array([level], dtype=np.float32)}, lines)
    print("added to the beginning of a piece:", add, flush=True)
    half["t"][0, 1::2] += np.float16(add)
    np.savez(f"{out}.new.npz", **half, least=np.array([level], dtype=np.float32))
    os.replace(f"{out}.new.npz", out)


if __name__ == "__main__":
    for variable in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        if os.environ.get(variable) != "1":  # one thread for each process, before numpy starts its own
            os.environ.update(OMP_NUM_THREADS="1", OPENBLAS_NUM_THREADS="1")
            os.execv(sys.executable, [sys.executable, "-m", "weftgraph.llm.train_pii", *sys.argv[1:]])
    main(sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 8)
