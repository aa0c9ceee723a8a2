"""Words of many texts at once, as 64-bit hashes in numpy: no loop per word.

A word is a run of letters and digits. Case is folded letter by letter, the apostrophes inside words are dropped, everything
else separates words. The hash of a word is a polynomial of its code points, so it is the same in every
process and needs no vocabulary.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_TOP = 0x3000
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INV = pow(_BASE, -1, 1 << 64)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """1 for letters and digits, 2 for apostrophes that are dropped, else 0."""
    t = np.array([chr(i).isalnum() for i in range(_TOP)], np.uint8)
    t[[0x27, 0x2019, 0x02BC]] = 2
    return t


@lru_cache(4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a public mixing function)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(1)
def _lower() -> np.ndarray:
    out = np.arange(_TOP, dtype=np.uint32)
    for i in range(_TOP):
        out[i] = ord(chr(i).lower()[0])
    return out


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed; where each text starts, and the end."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 if t else 1 for t in texts], out=starts[1:])
    joined = "\n".join([t or "" for t in texts]) + "\n" if texts else ""
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), starts


def lowered(cp: np.ndarray) -> np.ndarray:
    small = np.minimum(cp, _TOP - 1)
    low = _lower()[small]
    return np.where(cp < _TOP, low, cp) if len(cp) and cp.max() >= _TOP else low


def words(texts: list[str], points: tuple[np.ndarray, np.ndarray] | None = None, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the first word of each text (and the end), and the start of each word in code points.

    With `apart`, apostrophes separate words as any other sign does.
    """
    cp, starts = points or codepoints(texts)
    pieces = list(batches(len(texts), np.diff(starts)))
    if len(pieces) > 1:  # bounded memory, however much text
        parts = [_words(cp[starts[a] : starts[b]], starts[a : b + 1] - starts[a], apart) for a, b in pieces]
        firsts = np.cumsum([0, *(len(p[0]) for p in parts)])
        at = np.concatenate([*(p[1][:-1] + n for p, n in zip(parts, firsts, strict=False)), firsts[-1:]])
        return np.concatenate([p[0] for p in parts]), at, np.concatenate([p[2] + starts[a] for p, (a, _) in zip(parts, pieces, strict=True)])
    return _words(cp, starts, apart)


def _words(cp: np.ndarray, starts: np.ndarray, apart: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cp = lowered(cp)
    kind = _kinds()[np.minimum(cp, _TOP - 1)]
    kind[cp >= _TOP] = 1
    if apart:
        kind[kind == 2] = 0
    keep = kind != 2
    where = None
    if not keep.all():
        where = np.flatnonzero(keep)
        shift = np.cumsum(~keep)
        starts = starts - np.r_[0, shift][starts]
        cp, kind = cp[where], kind[where]
    edge = np.diff(np.r_[np.uint8(0), kind].view(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # every text ends in a line feed
    size = 1 << max(12, int(len(cp)).bit_length())
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(cp.astype(np.uint64) * _powers(size, _BASE)[: len(cp)], out=total[1:])
    h = mix((total[end] - total[begin]) * _powers(size, _INV)[begin])
    return h, np.searchsorted(begin, starts), begin if where is None else where[begin]


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order: a sort beats a hash table by far."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for every length n, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def batches(n: int, sizes: np.ndarray, limit: int = 1_500_000):
    """Slices of 0..n of about `limit` size each; one text may exceed it alone."""
    total, a = np.cumsum(sizes), 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right")))
        yield a, min(b, n)
        a = b
