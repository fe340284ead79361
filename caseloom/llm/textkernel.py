"""Vectorised words and word shingles of whole texts, straight from Arrow buffers.

Texts are handled in slices of about SLICE bytes (one text at least), so memory follows the longest
text, some 40 bytes for each of its own. A word's hash is a polynomial over its bytes modulo 2**64,
taken from one running sum over the slice; a shingle's hash mixes the hashes of its words. Two
different shingles share a hash with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 19
_B = 0x9E3779B97F4A7C15
_INV = pow(_B, -1, 1 << 64)
_pow = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["p"]) < n:
        for k, b in (("p", _B), ("i", _INV)):
            a = np.full(n, b, np.uint64)
            a[0] = 1
            _pow[k] = np.cumprod(a)
    return _pow["p"][:n], _pow["i"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    return word, low + np.uint64(1)


_blank = np.ones(256, bool)
_blank[[0x20, *range(0x09, 0x0E)]] = False
#: words are runs of bytes other than space and U+0009..U+000D
BLANK = _tables(_blank)
_alnum = np.zeros(256, bool)
_alnum[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: words are runs of ASCII letters, digits and bytes of non-ASCII characters
ALNUM = _tables(_alnum)


class Words(NamedTuple):
    first: int  # index of the slice's first text in the batch
    n: int  # texts in the slice
    data: np.ndarray  # the slice's bytes
    offs: np.ndarray  # n + 1 byte offsets of texts
    start: np.ndarray  # byte span of each word
    end: np.ndarray
    doc: np.ndarray  # text of each word
    hash: np.ndarray
    stem: np.ndarray | None  # hash of each word's first bytes, where asked for


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data, offs


def slices(col: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offs = text_buffers(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j - i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def fold_latin1(data: np.ndarray) -> np.ndarray:
    """Lower-case the two-byte capitals U+00C0..U+00DE; ASCII is left to the tables."""
    if len(data) < 2:
        return data
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    if len(at):
        data = data.copy()
        data[at] += 0x20
    return data


def words(col: pa.Array, tables: tuple[np.ndarray, np.ndarray] = BLANK, fold: bool = False, size: int = SLICE, stem: int = 0) -> Iterator[Words]:
    is_word, low = tables
    for first, n, data, offs in slices(col, size):
        if fold:
            data = fold_latin1(data)
        w = is_word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True
        start, end = w.copy(), w.copy()
        start[1:] &= ~w[:-1] | edge[1:-1]
        end[:-1] &= ~w[1:] | edge[1:-1]
        start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
        p, inv = _powers(len(data) + 1)
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(low[data] * p[:-1], out=run[1:])
        h = mix64((run[end] - run[start]) * inv[start])
        short = mix64((run[np.minimum(end, start + stem)] - run[start]) * inv[start]) if stem else None
        yield Words(first, n, data, offs, start, end, np.searchsorted(offs, start, "right") - 1, h, short)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of each k-word shingle, by text and place. A text of fewer words
    (one at least) has its whole sequence as its only shingle."""
    n = len(w.doc)
    count = np.bincount(w.doc, minlength=w.n)
    m = max(0, n - k + 1)
    at = np.flatnonzero(w.doc[:m] == w.doc[k - 1 :]) if m else np.zeros(0, np.int64)
    h = _combine(w.hash, at, k)
    if k > 1 and ((count > 0) & (count < k)).any():
        begin = np.concatenate(([0], np.cumsum(count)[:-1]))
        hs, ats = [h], [at]
        for s in range(1, k):
            a = begin[count == s]
            if len(a):
                hs.append(_combine(w.hash, a, s))
                ats.append(a)
        h, at = np.concatenate(hs), np.concatenate(ats)
        order = np.argsort(at, kind="stable")
        h, at = h[order], at[order]
    return h, w.doc[at] if len(at) else np.zeros(0, np.int64), at


def _combine(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    out = np.full(len(at), k * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[at + j]
    return mix64(out)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
