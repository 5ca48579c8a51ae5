"""Vectorised pre-tokenisation of byte-level BPE.

Splits texts as the public pattern does: contractions, optional space and a
run of letters, of digits or of other characters, and white space, of which
the last character stands apart before a word. The pattern's alternatives are
told from the classes of neighbouring code points, so whole blocks of texts
are split by array operations and no regular expression runs.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from .common import string_buffers

LETTER, NUMBER, SPACE, REST = 0, 1, 2, 3
#: The code points of Unicode's White_Space property.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe in the pattern's contractions.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(0x110000, REST, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kinds[c] = LETTER
        elif major == "N":
            kinds[c] = NUMBER
    kinds[list(WHITE_SPACE)] = SPACE
    return kinds


def _begins(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where tokens begin; ``first`` marks the first character of each text."""
    n = len(codes)
    kind = _classes()[codes]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    begins = first.copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    # The last of several white spaces stands apart before a word; a plain space then joins that word.
    before_word = np.zeros(n, bool)
    before_word[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    begins |= before_word
    joins = np.flatnonzero(before_word & (codes == 0x20)) + 1
    begins[joins] = False
    # Contractions: an apostrophe that begins a token.
    marks = np.flatnonzero((codes == 0x27) & begins & ~last)
    if len(marks):
        # distance to the end of the text, so that no contraction reaches into the next
        ends = np.append(np.flatnonzero(first)[1:], n)
        room = ends[np.searchsorted(ends, marks, side="right")] - marks
        padded = np.append(codes, [0, 0, 0]).astype(np.int64)
        a, b = padded[marks + 1], padded[marks + 2]
        length = np.zeros(len(marks), np.int64)
        for tail in CONTRACTIONS:
            fits = (a == ord(tail[0])) & (room > len(tail))
            if len(tail) == 2:
                fits &= b == ord(tail[1])
            length[fits & (length == 0)] = len(tail) + 1
        hit = length > 0
        at, size = marks[hit], length[hit]
        begins[at + 1] = False
        after = at + size
        inside = after < n
        begins[after[inside]] = True
        two = at[size == 3]
        begins[two + 2] = False
    return begins


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of these texts as one binary array over their own bytes, and the n+1 offsets of each text's pre-tokens."""
    data, rows = string_buffers(texts)
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(len(rows), np.int64)
    raw = data.tobytes()
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    size = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    at = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    first = np.zeros(len(codes), bool)
    starts = np.searchsorted(at, rows[:-1][np.diff(rows) > 0])
    first[starts] = True
    begins = at[:-1][_begins(codes, first)]
    offsets = np.append(begins, len(data))
    tokens = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return tokens, np.searchsorted(begins, rows)
