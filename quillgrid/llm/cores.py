"""Letter-and-digit cores of texts, their character windows and minwise fingerprints.

Everything here works on whole Arrow batches with numpy: the texts of a batch
are laid end to end in one array of code points, so the cost per character is
a few array operations and no Python loop runs over texts or characters.

Definitions
-----------
core        the lower-cased text, keeping only characters of the Unicode
            categories L* and N*; a null text has the empty core
window      ``n`` consecutive characters of a core
likeness    distinct windows of both cores, intersection / union (0 if either
            core has no window)
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Not a character; it parts the texts of a batch and never occurs in a core.
_PART = chr(0x10FFFF)
#: No letter or number is assigned from here on.
_TOP = 0x40000
_DOC_SHIFT = np.uint64(44)
_TOKEN_MASK = np.uint64((1 << 44) - 1)


@lru_cache(maxsize=1)
def core_table() -> np.ndarray:
    """For each code point, whether a core keeps it."""
    table = np.zeros(0x110000, dtype=bool)
    table[:_TOP] = [unicodedata.category(chr(i))[0] in "LN" for i in range(_TOP)]
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def cores(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all cores laid end to end, and the text that each belongs to."""
    joined = _PART.join([t.replace(_PART, " ") if _PART in t else t for t in texts]).lower()
    points = code_points(joined)
    keep = core_table()[points]
    owner = np.cumsum(points == 0x10FFFF, dtype=np.int32)
    return points[keep], owner[keep]


def core_string(text: str | None) -> str:
    if not text:
        return ""
    points = code_points(text.lower())
    return points[core_table()[points]].tobytes().decode("utf-32-le", "surrogatepass")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def windows(points: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all windows of ``n`` characters, and their texts."""
    m = len(points) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    wide = points.astype(np.uint64)
    h = wide[:m].copy()
    for k in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[k : m + k]
    inside = owner[:m] == owner[n - 1 :]
    return mix(h[inside]), owner[:m][inside]


def distinct_windows(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, window) of a batch: 44-bit window hashes and their texts."""
    h, owner = windows(*cores(texts), n)
    key = (owner.astype(np.uint64) << _DOC_SHIFT) | (h >> np.uint64(20))
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return key & _TOKEN_MASK, (key >> _DOC_SHIFT).astype(np.int64)


def core_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of the whole core of each text, the core's length, and a second hash."""
    points, owner = cores(texts)
    out = np.zeros((2, len(texts)), np.uint64)
    sizes = np.bincount(owner, minlength=len(texts)) if len(points) else np.zeros(len(texts), np.int64)
    if len(points):
        starts = np.cumsum(sizes) - sizes
        place = np.arange(len(points), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64)
        has = sizes > 0
        for k, seed in enumerate((np.uint64(0), np.uint64(0xD6E8FEB86659FD93))):
            parts = mix((points.astype(np.uint64) << np.uint64(32)) ^ (place * np.uint64(0x9E3779B97F4A7C15)) ^ seed)
            out[k, has] = np.add.reduceat(parts, starts[has])
            out[k] = mix(out[k] ^ sizes.astype(np.uint64))
    return out[0], sizes, out[1]


def core_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of the whole core of each text, and the core's length."""
    return core_digests(texts)[:2]


class MinHasher:
    """``slots`` minwise values for each text, seeded and the same on every machine."""

    def __init__(self, slots: int, seed: int = 0x51ED):
        rng = np.random.default_rng(seed)
        self.slots = slots
        self.mul = (rng.integers(1, 1 << 32, slots, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        self.xor = rng.integers(0, 1 << 32, slots, dtype=np.uint64).astype(np.uint32)

    def matrix(self, tokens: np.ndarray, owner: np.ndarray, step: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
        """The texts that have tokens, and a row of ``slots`` values for each.

        ``step`` tokens are worked on at a time, so that they stay in a core's cache.
        """
        if not len(tokens):
            return np.empty(0, np.int64), np.empty((0, self.slots), np.uint32)
        small = (tokens ^ (tokens >> np.uint64(12))).astype(np.uint32)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        docs = owner[starts]
        ends = np.r_[starts[1:], len(tokens)]
        out = np.empty((self.slots, len(docs)), np.uint32)
        a = 0
        while a < len(docs):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + step, side="right")))
            part, at = small[starts[a] : ends[b - 1]], starts[a:b] - starts[a]
            for k in range(self.slots):
                out[k, a:b] = np.minimum.reduceat((part ^ self.xor[k]) * self.mul[k], at)
            a = b
        return docs, out.T


def likeness(a: str | None, b: str | None, n: int) -> float:
    """Exact likeness of two texts by ``n``."""
    x, y = core_string(a), core_string(b)
    p = {x[i : i + n] for i in range(len(x) - n + 1)}
    q = {y[i : i + n] for i in range(len(y) - n + 1)}
    return len(p & q) / len(p | q) if p and q else 0.0
