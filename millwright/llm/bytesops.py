"""Whole-batch text arithmetic on UTF-8 buffers.

Arrow hands a batch of texts over as one byte buffer and an offset array.
The functions here compute words, hashes, n-grams and per-document sums for
all documents of a bounded block at once, so no Python loop runs per word.
"""

from __future__ import annotations

import hashlib
import sys
import types

import numpy as np
import pyarrow as pa

#: Blocks of whole documents are cut at about this many bytes of text; one longer document is its own block.
BLOCK_BYTES = 512 * 1024
_BASE = 0x9E3779B97F4A7C15 | 1
#: Words are hashed as polynomials over a prime field at two points (fixed values): those of up to SHORT_WORD bytes by tables of whole terms, those of more than LONG_WORD bytes one by one.
PRIME, POINTS, SHORT_WORD, LONG_WORD = (1 << 31) - 1, (1_482_715_439, 893_256_713), 64, 1 << 16


def worker_cache() -> dict:
    """A dictionary that outlives tasks in a reused Python worker."""
    return sys.modules.setdefault("_millwright_worker", types.ModuleType("_millwright_worker")).__dict__


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that follow from the seed."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def _powers() -> list[np.ndarray]:
    """The powers of both points, for every place in a word."""
    cache = worker_cache()
    if "powers" not in cache:
        out = []
        for point in POINTS:
            table, k = np.ones(LONG_WORD, np.uint64), 1
            while k < LONG_WORD:
                table[k : 2 * k] = table[:k] * np.uint64(pow(point, k, PRIME)) % np.uint64(PRIME)
                k *= 2
            out.append(table)
        cache["powers"] = out
    return cache["powers"]


def _terms(lower: bool) -> list[np.ndarray]:
    """For both points the term of every place and byte of a short word, at 256 * place + byte."""
    cache = worker_cache().setdefault("terms", {})
    if lower not in cache:
        values = (_LOWER if lower else np.arange(256)).astype(np.uint64) + np.uint64(1)
        cache[lower] = [(power[:SHORT_WORD, None] * values[None, :] % np.uint64(PRIME)).ravel() for power in _powers()]
    return cache[lower]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, the n + 1 offsets and the non-null mask of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    n = len(column)
    valid = np.ones(n, bool) if not column.null_count else column.is_valid().to_numpy(zero_copy_only=False)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64), valid
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0], valid


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges [a, b) of documents with at most limit bytes together, or one document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a block: where they begin and end, and the document of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.docs = data, offsets, len(offsets) - 1
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        inside = ~_SPACE[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~inside[:-1]
            after[-1], after[:-1] = True, ~inside[1:]
            before |= edge[:n]
            after |= edge[1:]
        self.inside = inside
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=self.docs).astype(np.int64)

    def hashes(self, lower: bool) -> np.ndarray:
        """A hash of each word; lower: A-Z count as a-z.

        The value of the word's polynomial at two points of a field of 2**31 - 1
        elements: two words of up to n bytes agree in both for at most the
        share (n / 2**31)**2 of the pairs of points.
        """
        if not len(self.starts):
            return np.empty(0, np.uint64)
        sizes = (self.ends - self.starts).astype(np.int32)
        first = np.r_[0, np.cumsum(sizes, dtype=np.int64)][:-1]
        letters = self.data[self.inside]
        place = np.arange(len(letters), dtype=np.int64) - np.repeat(first, sizes)
        if sizes.max() > SHORT_WORD:
            np.minimum(place, SHORT_WORD - 1, out=place)
        place <<= 8
        place |= letters
        both = [np.add.reduceat(terms[place], first) % np.uint64(PRIME) for terms in _terms(lower)]
        more = np.flatnonzero((sizes > SHORT_WORD) & (sizes <= LONG_WORD))
        if len(more):
            many = sizes[more]
            start = np.r_[0, np.cumsum(many, dtype=np.int64)][:-1]
            at = np.arange(int(many.sum())) - np.repeat(start, many)
            own = letters[np.repeat(first[more], many) + at]
            values = (_LOWER[own] if lower else own).astype(np.uint64) + np.uint64(1)
            for k, power in enumerate(_powers()):
                both[k][more] = np.add.reduceat(values * power[at], start) % np.uint64(PRIME)
        out = mix64((both[0] << np.uint64(31)) | both[1])
        for i in np.flatnonzero(sizes > LONG_WORD):
            own = letters[first[i] : first[i] + sizes[i]]
            out[i] = int.from_bytes(hashlib.blake2b((_LOWER[own] if lower else own).tobytes(), digest_size=8).digest(), "big")
        return out

    def repeats(self) -> np.ndarray:
        """Whether each word equals the word before it in its document."""
        sizes = self.ends - self.starts
        out = np.zeros(len(sizes), bool)
        if len(sizes) < 2:
            return out
        like = (sizes[1:] == sizes[:-1]) & (self.doc[1:] == self.doc[:-1]) & (self.data[self.starts[1:]] == self.data[self.starts[:-1]]) & (self.data[self.ends[1:] - 1] == self.data[self.ends[:-1] - 1])
        pairs = np.flatnonzero(like)
        if len(pairs):
            many = sizes[pairs]
            start = np.r_[0, np.cumsum(many)][:-1]
            at = np.arange(int(many.sum())) - np.repeat(start, many)
            same = self.data[np.repeat(self.starts[pairs], many) + at] == self.data[np.repeat(self.starts[pairs + 1], many) + at]
            out[pairs + 1] = np.logical_and.reduceat(same, start)
        return out


def sums(values: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Sum of values by document; doc is ascending."""
    out = np.zeros(docs, np.float64)
    if len(values):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        out[doc[first]] = np.add.reduceat(values, first)
    return out


def shingles(words: Words, width: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the word windows of each document, and n + 1 bounds.

    Words are lower-cased (A-Z). A document with fewer words than the window
    has its whole word sequence as its only shingle; without words it has none.
    """
    hashes, counts = words.hashes(lower=True), words.counts
    factor = multipliers(width + 1, seed)
    first = np.r_[0, np.cumsum(counts)]
    windows = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for j in range(width if len(windows) else 0):
        windows += hashes[j : j + len(windows)] * factor[j]
    windows = mix64(windows)
    out, bounds = [], np.zeros(words.docs + 1, np.int64)
    for d in range(words.docs):
        n = int(counts[d])
        if n >= width:
            own = np.unique(windows[first[d] : first[d] + n - width + 1])
        elif n:
            own = mix64(np.sum(hashes[first[d] : first[d] + n] * factor[:n], dtype=np.uint64, keepdims=True) + factor[width:] * np.array([n], np.uint64))
        else:
            own = np.empty(0, np.uint64)
        out.append(own)
        bounds[d + 1] = bounds[d] + len(own)
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), bounds
