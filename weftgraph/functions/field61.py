"""Arithmetic in the field of integers modulo 2**61 - 1, vectorised and for polynomials."""

from __future__ import annotations

import numpy as np

P = (1 << 61) - 1
_P = np.uint64(P)
_M32, _M29, _M61 = np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1), np.uint64(P)


def mul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod P for uint64 arrays below P, by 32-bit halves."""
    a_hi, a_lo, b_hi, b_lo = a >> np.uint64(32), a & _M32, b >> np.uint64(32), b & _M32
    mid = a_hi * b_lo + a_lo * b_hi  # below 2**62
    low = a_lo * b_lo
    # hi*2**64 = hi*8, mid*2**32 = (mid >> 29) + (mid & (2**29-1)) * 2**32
    s = ((a_hi * b_hi) << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & _M29) << np.uint64(32)) + (low >> np.uint64(61)) + (low & _M61)
    s = (s & _M61) + (s >> np.uint64(61))
    return np.where(s >= _P, s - _P, s)


def sub(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a - b mod P."""
    return np.where(a >= b, a - b, a + (_P - b))


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = a + b
    return np.where(s >= _P, s - _P, s)


def elements(h: np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes as field elements; 0 and the small numbers, which are sample points, are kept free."""
    u = h.view(np.uint64) & _M61
    return np.where((u >= _P) | (u < np.uint64(1 << 20)), u % np.uint64(1 << 40) + np.uint64(1 << 21), u)


def products_by_group(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Product of each run of rows of ``values`` (rows x points); run i begins at row starts[i]. By halving rounds."""
    ends = np.append(starts[1:], len(values))
    sizes, out = ends - starts, values
    while len(sizes) and sizes.max() > 1:
        pairs = sizes // 2
        odd = sizes % 2
        new = pairs + odd
        first = np.repeat(np.append(0, np.cumsum(sizes)[:-1]), new)
        k = np.arange(new.sum()) - np.repeat(np.append(0, np.cumsum(new)[:-1]), new)
        left = first + 2 * k
        whole = k < np.repeat(pairs, new)
        merged = out[left]
        merged[whole] = mul(out[left[whole]], out[left[whole] + 1])
        out, sizes = merged, new
    return out


def horner(coefficients: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values at x of one polynomial for each row; coefficients from the lowest, rows x (degree + 1)."""
    y = coefficients[:, -1].copy()
    for i in range(coefficients.shape[1] - 2, -1, -1):
        y = add(mul(y, x), coefficients[:, i])
    return y


def _trim(a: list[int]) -> list[int]:
    while a and a[-1] == 0:
        a.pop()
    return a


def _poly_at(a: list[int], x: int) -> int:
    y = 0
    for c in reversed(a):
        y = (y * x + c) % P
    return y


def interpolate(xs: list[int], ys: list[int]) -> list[int]:
    """Coefficients of the polynomial through the points, by Newton's divided differences."""
    n, d = len(xs), list(ys)
    for j in range(1, n):
        for i in range(n - 1, j - 1, -1):
            d[i] = (d[i] - d[i - 1]) * pow(xs[i] - xs[i - j], -1, P) % P
    out: list[int] = []
    for i in range(n - 1, -1, -1):
        shifted = [0, *out]
        for k, c in enumerate(out):
            shifted[k] = (shifted[k] - xs[i] * c) % P
        shifted[0] = (shifted[0] + d[i]) % P
        out = shifted
    return _trim(out)


def rational(xs: list[int], ys: list[int], difference: int, more: list[tuple[int, int]]) -> tuple[list[int], list[int]] | None:
    """Monic coprime (p, q), deg p - deg q = difference, deg p + deg q <= len(xs), with p/q through all points; None if
    there is none, also when a point of ``more`` denies it. By the extended Euclidean algorithm on the node polynomial and
    the interpolant."""
    most = (len(xs) + difference) // 2
    if most < 0 or most - difference < 0:
        return None
    m = [1]
    for x in xs:
        m = [(a - x * b) % P for a, b in zip([0, *m], [*m, 0])]
    r0, r1, t0, t1 = m, interpolate(xs, ys), [], [1]
    while len(r1) - 1 > most:
        lead, quotient, rest = pow(r1[-1], -1, P), [0] * (len(r0) - len(r1) + 1), list(r0)
        for k in range(len(quotient) - 1, -1, -1):
            q = rest[k + len(r1) - 1] * lead % P
            quotient[k] = q
            if q:
                for i, c in enumerate(r1):
                    rest[k + i] = (rest[k + i] - q * c) % P
        t2 = [0] * max(len(t0), len(t1) + len(quotient) - 1)
        for i, c in enumerate(t0):
            t2[i] = c
        for i, a in enumerate(quotient):
            if a:
                for j, b in enumerate(t1):
                    t2[i + j] = (t2[i + j] - a * b) % P
        r0, r1, t0, t1 = r1, _trim(rest), t1, _trim(t2)
    if not r1 or not t1 or len(r1) - len(t1) != difference or r1[-1] != t1[-1]:
        return None
    lead = pow(t1[-1], -1, P)
    p, q = [c * lead % P for c in r1], [c * lead % P for c in t1]
    if any(_poly_at(p, x) != y * _poly_at(q, x) % P for x, y in [*more, *zip(xs, ys)]):
        return None
    return p, q
