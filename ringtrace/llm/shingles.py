"""Word and shingle hashes of whole Arrow batches of texts, in numpy without a loop over words.

A word's hash is the sum of its bytes' random numbers times powers of an odd base, which the
prefix sums of a stretch of text give for all its words at once; a mixing step follows.  All
numbers are 64 bits wide and wrap.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_A, _B, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x5851F42D4C957F2D
#: Bytes that are hashed together, unless a single word is longer.
STRETCH = 1 << 17

_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64)[_LOWER] | np.uint64(1)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


@lru_cache(4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        both.append(np.multiply.accumulate(x))
    return both[0], both[1]


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts (null: none) and its offsets."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, cuts, data = texts.buffers()
    offsets = np.frombuffer(cuts, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z in lower case, between ASCII white space) and each text's first word, with the end."""
    data, offsets = _flat(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    first = np.searchsorted(starts, offsets)
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = starts[at]
        until = max(at + 1, int(np.searchsorted(ends, low + STRETCH, "right")))
        size = int(ends[until - 1] - low)
        powers, inverse = _powers(1 << max(size, STRETCH).bit_length())
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTES[data[low : low + size]] * powers[:size], out=sums[1:])
        a, b = starts[at:until] - low, ends[at:until] - low
        out[at:until] = mixed((sums[b] - sums[a]) * inverse[a])
        at = until
    return out, first


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All shingles (runs of ``words`` words) of each text in their order, and each text's first one, with the end.

    A text of fewer words is one shingle, the whole; a text without words has none.
    """
    hashes, first = word_hashes(texts)
    sizes = np.diff(first)
    runs = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    cuts = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(int(cuts[-1]), np.uint64)
    if not len(out):
        return out, cuts
    at = np.repeat(first[:-1] - cuts[:-1], runs) + np.arange(len(out))
    out[:] = words
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    for k in range(words):
        out = mixed(out * _B + padded[at + k])
    for k in np.flatnonzero((sizes > 0) & (sizes < words)).tolist():
        own = np.full(1, sizes[k], np.uint64)
        for h in hashes[first[k] : first[k + 1]]:
            own = mixed(own * _B + h)
        out[cuts[k]] = own[0]
    return out, cuts


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    flat, cuts = shingles(texts, words)
    out = []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        own = np.sort(flat[a:b])
        if b - a > 1:
            fresh = np.empty(b - a, bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            if not fresh.all():
                own = own[fresh]
        out.append(own)
    return out
