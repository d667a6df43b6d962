"""Word shingles of many texts at once, as sorted 64-bit hashes (numpy).

Words are the maximal runs of bytes other than space and tab..carriage return,
after lower-casing A-Z. A word's hash is a polynomial over random 64-bit byte
values (arithmetic modulo 2**64), read off prefix sums, so the cost is a few
array passes per byte. Equal shingles have equal hashes; different ones agree
with a chance near 2**-60.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP = _RNG.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_DELIM = np.zeros(256, bool)
_DELIM[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CHUNK = 1 << 19
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply), one stream per salt."""
    x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, _CHUNK + (_CHUNK >> 2))
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of every text)."""
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    buf = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    gap = _DELIM[buf]
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    ends = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts])
    doc_ends = np.cumsum(np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts)))
    last = np.searchsorted(starts, doc_ends, "left")
    return h, np.diff(last, prepend=0)


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of every text, sorted within it; their number).

    A text with fewer than ``width`` words has its whole word sequence as its
    one shingle; a text without words has none.
    """
    sets, counts = [], []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= _CHUNK >> 1):
            size += len(texts[j])
            j += 1
        h, words = word_hashes(texts[i:j])
        first = np.cumsum(words) - words
        s = np.zeros(len(h), np.uint64)
        for k in range(width):
            s[: max(0, len(h) - k)] += mix(h[k:], 7 + k) * _STEP[k]
        s = mix(s, 3)
        for a, n in zip(first.tolist(), words.tolist(), strict=True):
            if n >= width:
                own = np.unique(s[a : a + n - width + 1])
            elif n:
                short = np.zeros(1, np.uint64)
                for k in range(n):
                    short += mix(h[a + k : a + k + 1], 7 + k) * _STEP[k]
                own = mix(short, 100 + n)
            else:
                own = h[:0]
            sets.append(own)
            counts.append(len(own))
        i = j
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return flat, np.array(counts, np.int64)
