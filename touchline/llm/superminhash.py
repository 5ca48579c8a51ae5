"""SuperMinHash signatures of shingle sets, for whole blocks of documents at once.

Each element of a set visits the signature's positions in the order of its own
random permutation; at its j-th step it offers j plus a random fraction, and a
position keeps the least offer. Ranks of one element are thus correlated over
the positions, which lowers the variance of the estimate. As offers only grow,
a document stops as soon as all its positions are filled. Here the j-th step of
all elements of all unfinished documents is one array operation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import mixed, split_words, word_hashes

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1
_UNFILLED = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of so many lower-cased words, and the n+1 offsets of each text's.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    found, rows = split_words(texts, lower=True)
    hashes = word_hashes(found)
    n = np.diff(rows)
    doc = np.repeat(np.arange(len(n)), n)
    left = np.repeat(rows[1:], n) - np.arange(len(hashes))  # words from here to the text's end
    whole = np.repeat(n, n) < words
    first = np.zeros(len(hashes), bool)
    first[rows[:-1][n > 0]] = True
    value = np.full(len(hashes), np.uint64(words), np.uint64)
    value[whole] = np.repeat(n, n)[whole].astype(np.uint64)
    padded = np.concatenate([hashes, np.zeros(words, np.uint64)])
    for i in range(words):
        inside = left > i
        value[inside] = mixed(value[inside] * _GOLDEN + padded[i : i + len(hashes)][inside])
    taken = np.where(whole, first, left >= words)
    value, doc = value[taken], doc[taken]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(values: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """(documents, size) least offers: step in the upper 32 bits, fraction in the lower. A document without elements keeps all positions unfilled."""
    if not 0 < size <= 256:
        raise ValueError("a signature has 1 to 256 positions")
    n = len(rows) - 1
    best = np.full(n * size, _UNFILLED)
    doc = np.repeat(np.arange(n), np.diff(rows))
    seed, order = values, None
    for step in range(size):
        drawn = mixed(seed + np.uint64((step + 1) * int(_GOLDEN) & _MASK))
        pick = step + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(size - step) >> np.uint64(32)).astype(np.int64)
        if order is None:
            place = pick
        else:
            each = np.arange(len(seed))
            place = order[each, pick].astype(np.int64)
            order[each, pick] = order[:, step]
        np.minimum.at(best, doc * size + place, np.uint64(step << 32) | (drawn >> np.uint64(32)))
        open_docs = (best.reshape(n, size) == _UNFILLED).any(axis=1)
        going = open_docs[doc]
        if not going.any():
            break
        if order is None:
            seed, doc, pick = seed[going], doc[going], pick[going]
            order = np.tile(np.arange(size, dtype=np.uint8), (len(seed), 1))
            order[np.arange(len(seed)), pick] = 0
        elif going.sum() < 0.8 * len(seed):
            seed, doc, order = seed[going], doc[going], order[going]
    return best.reshape(n, size)


def set_prints(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set: equal sets have equal prints."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mixed(values ^ np.uint64(salt)), out=total[1:])
        out.append((total[rows[1:]] - total[rows[:-1]]).view(np.int64))
    return out[0], out[1]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted arrays of distinct values share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents, bands) keys; equal where a band's rows are equal."""
    out = np.empty((len(signature), bands), np.int64)
    for b in range(bands):
        key = np.full(len(signature), np.uint64((b + 1) * int(_GOLDEN) & _MASK))
        for i in range(b * rows, (b + 1) * rows):
            key = mixed(key * _GOLDEN + signature[:, i])
        out[:, b] = key.view(np.int64)
    return out
