"""Vectorised word splitting and hashing over whole Arrow text columns.

A word is a run of bytes other than space and \\x09-\\x0D, so UTF-8 needs no decoding.
A word hash folds in eight bytes at a time, each followed by a full mix, so no algebra of
letters makes unlike words equal; word windows are polynomials over the word hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = U(0x9E3779B97F4A7C15)
#: Bytes of a word that are folded in steps over all words; what goes beyond is hashed word by word.
FOLDED = 256
#: Keeps the first so many of eight bytes.
FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string array; nulls count as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


class Words:
    """start, end: byte range of each word; doc: its row; first: words before each row (n + 1)."""

    def __init__(self, texts: pa.Array):
        offsets, data = text_buffers(texts)
        self.data, self.rows, n = data, len(offsets) - 1, len(data)
        solid = np.zeros(n + 2, dtype=bool)
        np.logical_not(IS_SPACE[data], out=solid[1 : n + 1])
        inner = solid[1 : n + 1]
        opens, closes = inner & ~solid[:n], inner & ~solid[2:]
        held = offsets[:-1][offsets[1:] > offsets[:-1]]
        opens[held] = inner[held]
        held = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        closes[held] = inner[held]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, lower: bool = False, head: int | None = None) -> np.ndarray:
        """One hash a word, of its first ``head`` bytes if given; A-Z as a-z if ``lower``."""
        if not len(self.start):
            return np.zeros(0, dtype=U)
        data = np.concatenate([LOWER[self.data] if lower else self.data, np.zeros(8, dtype=np.uint8)])
        eights = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), shape=(len(data) - 7,), strides=(1,))
        length = self.end - self.start if head is None else np.minimum(self.end - self.start, head)
        out = mix(eights[self.start] & FIRST_BYTES[np.minimum(length, 8)] ^ length.astype(U) * BASE)
        open_, at = np.flatnonzero(length > 8), 8
        while len(open_) and at < FOLDED:
            left = np.minimum(length[open_] - at, 8)
            out[open_] = mix(out[open_] * BASE ^ eights[self.start[open_] + at] & FIRST_BYTES[left])
            at += 8
            open_ = open_[length[open_] > at]
        for w in open_.tolist():
            out[w] ^= U(xxhash.xxh3_64_intdigest(data[self.start[w] + FOLDED : self.start[w] + length[w]], int(out[w])))
        return out


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the k words from each position on (n - k + 1), by doubling."""
    result, length, power, have = None, 0, words, 1
    bits = k
    while bits:
        if bits & 1:
            if result is None:
                result, length = power, have
            else:
                n = len(words) - (length + have) + 1
                if n <= 0:
                    return np.zeros(0, dtype=U)
                result = result[:n] * U(pow(int(BASE), have, 2**64)) + power[length : length + n]
                length += have
        bits >>= 1
        if bits:
            n = len(words) - 2 * have + 1
            if n <= 0:
                return np.zeros(0, dtype=U)
            power = power[:n] * U(pow(int(BASE), have, 2**64)) + power[have : have + n]
            have *= 2
    return mix(result)


def shingles(words: Words, k: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each row, sorted within it, and offsets (rows + 1).

    A row with fewer words gives its whole sequence as one shingle, a row without words none.
    """
    h = words.hashes(lower)
    full = windows(h, k)
    inside = words.doc[: len(full)] == words.doc[k - 1 :] if len(full) else np.zeros(0, dtype=bool)
    values, docs = full[inside], words.doc[: len(full)][inside]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = np.empty(len(short), dtype=U)
        for n in np.unique(words.counts[short]):
            rows = short[words.counts[short] == n]
            at = words.first[rows][:, None] + np.arange(n)
            acc = np.full(len(rows), n, dtype=U)
            for j in range(n):
                acc = acc * BASE + h[at[:, j]]
            extra[words.counts[short] == n] = mix(acc ^ U(0x5BD1E995))
        values, docs = np.concatenate([values, extra]), np.concatenate([docs, short])
    order = np.lexsort((values, docs))
    values, docs = values[order], docs[order]
    if len(values):
        fresh = np.ones(len(values), dtype=bool)
        fresh[1:] = (values[1:] != values[:-1]) | (docs[1:] != docs[:-1])
        values, docs = values[fresh], docs[fresh]
    return values, np.searchsorted(docs, np.arange(words.rows + 1))
