"""Greedy string tiling of two token sequences, found by running Karp-Rabin hashes."""

from __future__ import annotations

from collections.abc import Sequence

_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _hashes(x: Sequence[int], marked: bytearray, s: int) -> list[tuple[int, int]]:
    """(hash, start) of every window of s unmarked tokens, rolled from one to the next."""
    out, h, run, top = [], 0, 0, pow(_BASE, s - 1, _MOD)
    for i, v in enumerate(x):
        if marked[i]:
            h = run = 0
            continue
        if run == s:
            h = (h - x[i - s] * top) % _MOD
            run -= 1
        h = (h * _BASE + v) % _MOD
        run += 1
        if run == s:
            out.append((h, i - s + 1))
    return out


def tiles(a: Sequence[int], b: Sequence[int], least: int = 2, first: int = 16) -> list[tuple[int, int, int]]:
    """Non-overlapping matches (start in a, start in b, length) of at least ``least`` tokens, longest first.

    Rounds of a falling search length: windows of that length of what is unmarked are met by their hashes, verified and
    extended as far as both go; matches are marked from the longest; parts that a longer one has covered are left for a
    later round. Tokens below 0 match nothing. A longest match far above the search length restarts the search there.
    """
    out: list[tuple[int, int, int]] = []
    ma, mb = bytearray(v < 0 for v in a), bytearray(v < 0 for v in b)
    n, m, s = len(a), len(b), max(least, min(first, len(a) or 1, len(b) or 1))
    while True:
        windows: dict[int, list[int]] = {}
        for h, i in _hashes(a, ma, s):
            windows.setdefault(h, []).append(i)
        found: list[tuple[int, int, int]] = []
        jump = 0
        if windows:
            for h, j in _hashes(b, mb, s):
                for i in windows.get(h, ()):
                    if i and j and not ma[i - 1] and not mb[j - 1] and a[i - 1] == b[j - 1]:
                        continue  # within a match that began before
                    k = 0
                    while i + k < n and j + k < m and not ma[i + k] and not mb[j + k] and a[i + k] == b[j + k]:
                        k += 1
                    if k >= s:
                        found.append((-k, i, j))
                        jump = max(jump, k)
        if jump > 2 * s and jump > first:
            s = first = jump
            continue
        again = False
        for k, i, j in sorted(found):
            k = -k
            if any(ma[i : i + k]) or any(mb[j : j + k]):
                again = True
                continue
            ma[i : i + k] = mb[j : j + k] = b"\1" * k
            out.append((i, j, k))
        if again:
            continue
        if s == least:
            return out
        s = max(least, s // 2)
