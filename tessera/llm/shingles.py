"""Words and hashed word shingles of texts."""

from __future__ import annotations

import numpy as np
import xxhash

from tessera.llm.common import WORD_SEPARATORS

#: Words of a shingle, and the similarity (in hundredths) from which texts are near copies.
SHINGLE_WORDS, NEAR = 5, 75
#: Bytes whose words are hashed at once, and the length from which a word is hashed by itself.
CHUNK, LONG = 1 << 18, 1 << 16
_SEPARATOR = np.isin(np.arange(256), list(WORD_SEPARATORS))
_tables: list[np.ndarray] = []
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of an odd number modulo 2**64, and of its inverse."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 17)
        base = 0x9E3779B97F4A7C15
        _tables[:] = [np.cumprod(np.full(size, b, np.uint64)) for b in (base, pow(base, -1, 1 << 64))]
    return _tables


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a text in lower case, and where each begins."""
    text = text.lower()
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SEPARATOR[data]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + CHUNK, side="right")))
        if ends[j - 1] - a > CHUNK:
            j = i + 1
        else:
            b = int(ends[j - 1])
            power, inverse = powers(CHUNK)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * _MUL)
        i = j
    for i in np.flatnonzero(ends - starts >= LONG).tolist():
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]])
    return out, starts


def shingled(w: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash for each run of width words given by their hashes, in order; for fewer words one of them all, for none none."""
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    width = min(width, n)
    m = n - width + 1
    h = np.full(m, width, np.uint64)
    for i in range(width):
        h = mixed(h * _MUL + w[i : i + m])
    return h


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct shingle hashes of a text, sorted."""
    return np.unique(shingled(word_hashes(text or b"")[0]))
