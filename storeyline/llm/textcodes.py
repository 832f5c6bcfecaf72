"""Texts as arrays of folded letters, for operators that look at letters or words in bulk."""

from __future__ import annotations

from functools import cache

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


@cache
def _fold_table() -> np.ndarray:
    """Code point of the basic plane -> its lower-case letter, 0 for what is no letter."""
    table = np.zeros(1 << 16, np.uint32)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low[0])
    return table


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, starts): the texts one after another with two non-letters before and after each;
    every letter lower-cased, everything else 0; starts has one entry more than there are texts."""
    codes = np.frombuffer(("  " + "  ".join(t or "" for t in texts) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _fold_table()
    if len(codes) and int(codes.max()) >= 1 << 16:
        out = table[np.minimum(codes, 0xFFFF)]
        for i in np.flatnonzero(codes >= 1 << 16):
            c = chr(codes[i])
            out[i] = ord(c.lower()[0]) if c.isalpha() else 0
    else:
        out = table[codes]
    starts = np.cumsum([0, *(len(t or "") + 2 for t in texts)])
    return out, starts


_POWERS: list[np.ndarray] = []


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """At least 2**bits powers of the base and of its inverse; only the longest table is kept."""
    n = 1 << bits
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _POWERS.append(np.cumprod(table, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values with all bits depending on all bits."""
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def words(letters: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): a 64-bit hash of each maximal run of letters; bounds[i]..bounds[i + 1] are text i's."""
    edge = np.diff((letters > 0).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    bits = max(16, int(len(letters)).bit_length())
    up, down = _powers(bits)
    total = np.empty(len(letters) + 1, np.uint64)
    total[0] = 0
    np.cumsum(letters.astype(np.uint64) * up[: len(letters)], dtype=np.uint64, out=total[1:])
    return mixed((total[end] - total[begin]) * down[begin]), np.searchsorted(begin, starts)
