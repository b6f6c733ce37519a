"""Character tagger in numpy: bidirectional LSTM, linear-chain CRF, training and decoding of windows."""

from __future__ import annotations

import unicodedata

import numpy as np

KINDS = ["email", "phone", "id_number", "address", "name"]
#: Tag 0 is outside; kind k begins with tag 1 + 2k and goes on with tag 2 + 2k.
TAGS = 1 + 2 * len(KINDS)
#: States of one direction of the tagger and of the screen before it.
HIDDEN, SCREEN_HIDDEN = 48, 16
#: Characters of a window and of the overlap of neighbours.
LENGTH, OVERLAP = 256, 48
#: Characters that the screen reads in a step, of one of its windows and of their overlap.
BLOCK, SCREEN_LENGTH, SCREEN_OVERLAP = 4, 512, 64
#: Characters that are tagged on both sides of what the screen keeps.
MARGIN = 32
#: Windows of a batch; their states stay in the cache.
ROWS = 384
_NEVER = np.float32(-1e4)


def _classes() -> tuple[np.ndarray, int]:
    """Class of every code point below 65536, and their number: printable ASCII by itself, accented letters as their base
    letter, other letters, digits, spaces, dashes and signs together. Class 0 is the gap between texts."""
    ascii_ = {chr(c): i + 2 for i, c in enumerate(range(32, 127))}
    nl = 1
    lower, upper, letter, digit, sign, hidden = (len(ascii_) + 2 + i for i in range(6))
    table = np.full(65536, sign, dtype=np.uint8)
    table[0] = 0
    for c in range(1, 65536):
        ch = chr(c)
        if ch in ascii_:
            table[c] = ascii_[ch]
            continue
        if ch in "\n\r\x0b\x0c\x85  ":
            table[c] = nl
            continue
        kind = unicodedata.category(ch)
        base = unicodedata.normalize("NFKD", ch)[:1]
        if kind[0] == "L" and base in ascii_:
            table[c] = ascii_[base]
        elif kind == "Zs" or ch == "\t":
            table[c] = ascii_[" "]
        elif kind == "Pd":
            table[c] = ascii_["-"]
        elif kind == "Cf":
            table[c] = hidden
        elif kind == "Nd":
            table[c] = digit
        elif c < 0x250 and kind == "Ll":
            table[c] = lower
        elif c < 0x250 and kind == "Lu":
            table[c] = upper
        elif kind[0] in "LM":
            table[c] = letter
    return table, len(ascii_) + 8


_TABLE, CLASSES = _classes()


def codes(text: str) -> np.ndarray:
    """Class of each character of a text."""
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32), 65535)]


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large negative: a kind goes on only after itself."""
    m = np.zeros((TAGS, TAGS), dtype=np.float32)
    for k in range(len(KINDS)):
        m[:, 2 + 2 * k] = _NEVER
        m[1 + 2 * k, 2 + 2 * k] = m[2 + 2 * k, 2 + 2 * k] = 0
    return m


def fresh(seed: int = 7, hidden: int | None = None) -> dict[str, np.ndarray]:
    """Untrained weights of the tagger."""
    r, H = np.random.default_rng(seed), hidden or HIDDEN
    p = {}
    for d in "fb":
        x = r.normal(0, 0.3, (CLASSES, 4 * H))
        x[:, H : 2 * H] += 1.0  # the forget gate starts open
        p["x" + d] = x
        p["u" + d] = np.concatenate([np.linalg.qr(r.normal(size=(H, H)))[0] for _ in range(4)], axis=1) * 0.8
    p["o"] = r.normal(0, 0.2, (2 * H, TAGS))
    p["c"] = np.zeros(TAGS)
    p["t"] = np.zeros((TAGS, TAGS))
    return {k: v.astype(np.float32) for k, v in p.items()}


def fresh_screen(seed: int = 8, hidden: int | None = None) -> dict[str, np.ndarray]:
    """Untrained weights of the screen."""
    r, H = np.random.default_rng(seed), hidden or SCREEN_HIDDEN
    p = {}
    for d in "fb":
        x = r.normal(0, 0.2, (BLOCK * CLASSES, 4 * H))
        x[:, H : 2 * H] += 1.0 / BLOCK
        p["sx" + d] = x
        p["su" + d] = np.concatenate([np.linalg.qr(r.normal(size=(H, H)))[0] for _ in range(4)], axis=1) * 0.8
    p["so"] = r.normal(0, 0.2, 2 * H)
    p["sc"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _lstm(x: np.ndarray, u: np.ndarray):
    """States, cells and gates for x: steps x rows x 4H. Gates in the order input, forget, output, candidate; gates by
    tanh of the half."""
    steps, rows, _ = x.shape
    H = len(u)
    h = np.zeros((rows, H), dtype=np.float32)
    c = np.zeros_like(h)
    hs = np.empty((steps, rows, H), dtype=np.float32)
    cs = np.empty_like(hs)
    gs = np.empty((steps, rows, 4 * H), dtype=np.float32)
    a = np.empty((rows, 4 * H), dtype=np.float32)
    k = 3 * H
    for s in range(steps):
        np.matmul(h, u, out=a)
        a += x[s]
        a[:, :k] *= 0.5
        np.tanh(a, out=a)
        g = a[:, :k]
        g *= 0.5
        g += 0.5
        c = a[:, H : 2 * H] * c
        c += a[:, :H] * a[:, k:]
        h = np.tanh(c)
        h *= a[:, 2 * H : k]
        hs[s], cs[s], gs[s] = h, c, a
    return hs, cs, gs


def _lstm_back(dh_all, hs, cs, gs, u):
    steps, rows, H = hs.shape
    dx = np.empty_like(gs)
    du = np.zeros_like(u)
    dh, dc = np.zeros((rows, H), np.float32), np.zeros((rows, H), np.float32)
    zero = np.zeros((rows, H), np.float32)
    for s in range(steps - 1, -1, -1):
        i, f, o, g = (gs[s][:, j * H : (j + 1) * H] for j in range(4))
        before_c, before_h = (cs[s - 1], hs[s - 1]) if s else (zero, zero)
        tc = np.tanh(cs[s])
        d = dh_all[s] + dh
        dc = dc + d * o * (1 - tc * tc)
        da = dx[s]
        da[:, :H] = dc * g * i * (1 - i)
        da[:, H : 2 * H] = dc * before_c * f * (1 - f)
        da[:, 2 * H : 3 * H] = d * tc * o * (1 - o)
        da[:, 3 * H :] = dc * i * (1 - g * g)
        du += before_h.T @ da
        dh = da @ u.T
        dc = dc * f
    return dx, du


def _run(tables: list[np.ndarray], u: np.ndarray, w: list[np.ndarray], o: np.ndarray) -> np.ndarray:
    """What one direction adds to the emissions (steps x rows x outputs), without what training needs. The inputs of a step
    are the rows of ``tables`` at ``w``, looked up step by step, so that all of a step stays in the cache."""
    H = len(u)
    k = 3 * H
    half = np.ones(4 * H, dtype=np.float32)
    half[:k] = 0.5  # a gate is the hyperbolic tangent of the half
    tables, u = [t * half for t in tables], u * half
    steps, rows = w[0].shape
    h, c = np.zeros((rows, H), dtype=np.float32), np.zeros((rows, H), dtype=np.float32)
    out = np.empty((steps, rows, o.shape[1]), dtype=np.float32)
    a, x = np.empty((rows, 4 * H), dtype=np.float32), np.empty((rows, 4 * H), dtype=np.float32)
    for s in range(steps):
        np.matmul(h, u, out=a)
        for t, i in zip(tables, w):
            np.take(t, i[s], axis=0, out=x, mode="clip")
            a += x
        np.tanh(a, out=a)
        g = a[:, :k]
        g *= 0.5
        g += 0.5
        c *= a[:, H : 2 * H]
        c += a[:, :H] * a[:, k:]
        np.tanh(c, out=h)
        h *= a[:, 2 * H : k]
        np.matmul(h, o, out=out[s])
    return out


def emissions(p: dict, windows: np.ndarray) -> np.ndarray:
    """steps x rows x tags for windows of classes (rows x steps)."""
    w = np.ascontiguousarray(windows.T)
    h = len(p["uf"])
    return _run([p["xf"]], p["uf"], [w], p["o"][:h]) + _run([p["xb"]], p["ub"], [w[::-1]], p["o"][h:])[::-1] + p["c"]


def _pairs(p: dict) -> dict:
    """Inputs of the screen for pairs of classes, so that a step looks up half as often."""
    n = CLASSES
    for d in "fb":
        x = p["sx" + d].reshape(BLOCK, n, -1)
        p["sp" + d] = [(x[i][:, None] + x[i + 1][None]).reshape(n * n, -1) for i in range(0, BLOCK, 2)]
    return p


def screen(p: dict, windows: np.ndarray) -> np.ndarray:
    """rows x blocks: how much each block of windows of classes (rows x characters) looks as if it held something."""
    if "spf" not in p:
        _pairs(p)
    rows, n = windows.shape
    h = len(p["suf"])
    b = windows.reshape(rows, n // BLOCK, BLOCK).astype(np.int32)
    w = [np.ascontiguousarray((b[:, :, i] * CLASSES + b[:, :, i + 1]).T) for i in range(0, BLOCK, 2)]
    f = _run(p["spf"], p["suf"], w, p["so"][:h, None])
    g = _run(p["spb"], p["sub"], [x[::-1] for x in w], p["so"][h:, None])[::-1]
    return (f + g)[:, :, 0].T + p["sc"][0]


def decode(p: dict, windows: np.ndarray) -> np.ndarray:
    """Best tags (rows x steps) of windows."""
    e = emissions(p, windows)
    t = (p["t"] + allowed()).T.copy()  # next x before
    steps, rows, _ = e.shape
    back = np.empty((steps, rows, TAGS), dtype=np.int8)
    score = e[0].copy()
    at = np.arange(rows)
    for s in range(1, steps):
        m = score[:, None, :] + t
        b = m.argmax(axis=2)
        back[s] = b
        score = np.take_along_axis(m, b[:, :, None], axis=2)[:, :, 0] + e[s]
    out = np.empty((steps, rows), dtype=np.int8)
    out[-1] = score.argmax(axis=1)
    for s in range(steps - 1, 0, -1):
        out[s - 1] = back[s][at, out[s]]
    return out.T


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis=axis, keepdims=True)) + m).squeeze(axis)


def loss(p: dict, windows: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood of the tags and its gradient."""
    w, y = windows.T, tags.T.astype(np.int64)
    steps, rows = w.shape
    hf, cf, gf = _lstm(p["xf"][w], p["uf"])
    rb = w[::-1]
    hb, cb, gb = _lstm(p["xb"][rb], p["ub"])
    H = len(p["uf"])
    e = hf @ p["o"][:H] + hb[::-1] @ p["o"][H:] + p["c"]
    t = p["t"] + allowed()
    alpha = np.empty_like(e)
    alpha[0] = e[0]
    for s in range(1, steps):
        alpha[s] = _lse(alpha[s - 1][:, :, None] + t, 1) + e[s]
    z = _lse(alpha[-1], 1)
    beta = np.zeros_like(e)
    dt = np.zeros_like(t)
    at = np.arange(rows)
    for s in range(steps - 2, -1, -1):
        nxt = beta[s + 1] + e[s + 1]
        beta[s] = _lse(t + nxt[:, None, :], 2)
        dt += np.exp(alpha[s][:, :, None] + t + nxt[:, None, :] - z[:, None, None]).sum(axis=0)
    de = np.exp(alpha + beta - z[None, :, None])
    gold = e[np.arange(steps)[:, None], at, y].sum() + t[y[:-1], y[1:]].sum()
    value = float(z.sum() - gold)
    np.subtract.at(de, (np.arange(steps)[:, None], at[None, :], y), 1)
    np.subtract.at(dt, (y[:-1].ravel(), y[1:].ravel()), 1)
    n = np.float32(steps * rows)
    de /= n
    flat = de.reshape(-1, TAGS)
    grad = {"t": dt / n, "c": flat.sum(axis=0), "o": np.concatenate([hf.reshape(-1, H).T @ flat, hb[::-1].reshape(-1, H).T @ flat])}
    for d, hs, cs, gs, dh, idx in (("f", hf, cf, gf, de @ p["o"][:H].T, w), ("b", hb, cb, gb, (de @ p["o"][H:].T)[::-1], rb)):
        dx, du = _lstm_back(dh, hs, cs, gs, p["u" + d])
        grad["x" + d], grad["u" + d] = _gathered(p["x" + d], idx, dx), du
    return value / float(n), grad


def _gathered(table: np.ndarray, idx: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """The gradient of a table from that of its looked-up rows."""
    g = np.zeros_like(table)
    order = np.argsort(idx.ravel(), kind="stable")
    srt = idx.ravel()[order]
    cut = np.flatnonzero(np.append(True, srt[1:] != srt[:-1]))
    g[srt[cut]] = np.add.reduceat(dx.reshape(-1, table.shape[1])[order], cut, axis=0)
    return g


def screen_loss(p: dict, windows: np.ndarray, tags: np.ndarray, weight: float = 4.0) -> tuple[float, dict]:
    """Mean logistic loss of the blocks and its gradient; blocks that hold something count ``weight`` times."""
    rows, n = windows.shape
    b = windows.reshape(rows, n // BLOCK, BLOCK).transpose(1, 0, 2).astype(np.int64)
    idx = b + np.arange(BLOCK) * CLASSES
    y = (tags.reshape(rows, n // BLOCK, BLOCK) > 0).any(axis=2).T.astype(np.float32)
    H = len(p["suf"])
    back = idx[::-1]
    hf, cf, gf = _lstm(p["sxf"][idx].sum(axis=2), p["suf"])
    hb, cb, gb = _lstm(p["sxb"][back].sum(axis=2), p["sub"])
    z = hf @ p["so"][:H] + hb[::-1] @ p["so"][H:] + p["sc"][0]
    w = np.where(y > 0, np.float32(weight), np.float32(1))
    value = float((w * (np.logaddexp(0, z) - y * z)).sum())
    d = (w * (1 / (1 + np.exp(-z)) - y) / y.size).astype(np.float32)
    grad = {"sc": np.array([d.sum()], dtype=np.float32), "so": np.concatenate([np.tensordot(d, hf, ((0, 1), (0, 1))), np.tensordot(d, hb[::-1], ((0, 1), (0, 1)))])}
    for k, hs, cs, gs, dz, o, at in (("f", hf, cf, gf, d, p["so"][:H], idx), ("b", hb, cb, gb, d[::-1], p["so"][H:], back)):
        dx, du = _lstm_back(np.ascontiguousarray(dz[:, :, None] * o), hs, cs, gs, p["su" + k])
        grad["sx" + k] = sum(_gathered(p["sx" + k], at[:, :, j], dx) for j in range(BLOCK))
        grad["su" + k] = du
    return value / y.size, grad


def _cut(begins: np.ndarray, ends: np.ndarray, length: int, overlap: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of stretches [begin, end) of a stream: where each begins, its length (a multiple of ``step``) and
    its stretch."""
    stride = length - overlap
    count = np.maximum(1, -(-(ends - begins - overlap) // stride))
    which = np.repeat(np.arange(len(begins)), count)
    first = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    starts = begins[which] + first * stride
    size = np.minimum(length, ends[which] - starts)
    return starts, np.maximum(step, -(-size // step) * step), which


def _each(stream: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray):
    """(numbers of windows, their classes) in batches of windows of the same size; what lies beyond a window's end is gap, so
    a window's result does not depend on what else is in the stream."""
    order = np.argsort(sizes, kind="stable")
    for n in np.unique(sizes):
        same = order[np.searchsorted(sizes[order], n) : np.searchsorted(sizes[order], n, side="right")]
        for i in range(0, len(same), ROWS):
            k = same[i : i + ROWS]
            at = starts[k, None] + np.arange(n)
            yield k, np.where(at < ends[k, None], stream[np.minimum(at, len(stream) - 1)], np.uint8(0))


def stretches(p: dict, stream: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of what the screen keeps of the texts [begin, end) of a stream: blocks of at least ``least``, with a
    margin, those that touch made one."""
    least = float(p["least"][0]) if least is None else least
    filled = ends > begins
    begins, ends = begins[filled], ends[filled]
    if not len(begins):
        return begins, ends
    starts, sizes, which = _cut(begins, ends, SCREEN_LENGTH, SCREEN_OVERLAP, 8 * BLOCK)
    a = []
    for k, w in _each(stream, starts, sizes, ends[which]):
        r, b = np.nonzero(screen(p, w) >= least)
        a.append(np.stack([which[k[r]], starts[k[r]] + b * BLOCK]))
    hit = np.concatenate(a, axis=1)
    hit = hit[:, np.lexsort((hit[1], hit[0]))]
    if not hit.shape[1]:
        return begins[:0], ends[:0]
    text = hit[0]
    lo, hi = np.maximum(begins[text], hit[1] - MARGIN), np.minimum(ends[text], hit[1] + BLOCK + MARGIN)
    new = np.append(True, (text[1:] != text[:-1]) | (lo[1:] > hi[:-1]))
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:] - 1, len(hi) - 1)]


def tag(p: dict, stream: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tags of a stream of classes: 0 outside the stretches [begin, end). Each stretch is cut into overlapping windows, each
    decoded by itself; at each place the window in which it lies most inside tells the tag."""
    out = np.zeros(len(stream), dtype=np.int8)
    filled = ends > begins
    begins, ends = begins[filled], ends[filled]
    if not len(begins):
        return out
    starts, sizes, which = _cut(begins, ends, LENGTH, OVERLAP, 32)
    first = np.append(True, which[1:] != which[:-1])
    half = OVERLAP // 2
    for k, w in _each(stream, starts, sizes, ends[which]):
        tags = decode(p, w)
        for j, i in enumerate(k.tolist()):
            s, e = int(starts[i]), int(min(starts[i] + sizes[i], ends[which[i]]))
            a = 0 if first[i] else half
            b = e - s if i + 1 == len(first) or first[i + 1] else min(e - s, LENGTH - half)
            out[s + a : s + b] = tags[j, a:b]
    return out


def spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the runs of tags."""
    kind = (tags - 1) // 2
    inside = tags > 0
    begins = np.flatnonzero(inside & (((tags % 2 == 1)) | ~np.append(False, inside[:-1]) | (np.append(-9, kind[:-1]) != kind)))
    outside = np.append(np.flatnonzero(~inside), len(tags))
    ends = np.minimum(outside[np.searchsorted(outside, begins)], np.append(begins[1:], len(tags)))
    return list(zip(begins.tolist(), ends.tolist(), kind[begins].tolist()))
