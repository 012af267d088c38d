"""Language identification by prediction by partial matching (PPM).

For each language a context tree over bytes holds the symbols seen after
every context of up to three bytes. A symbol unseen in a context is coded by
an escape to the next shorter one, down to a uniform byte. The statistics are
frozen after training, so the code length of a byte depends only on the
longest known context and the byte. All trees are compiled on the driver into
one sparse table of fixed-point code lengths: a row for each pair of context
and byte that any language has, and a row of escape lengths for each context.
A byte costs one look-up where its four-byte window was seen, and two more for
each escape. The table holds the distinct windows of the sampled texts only.

Defined results: null text, or text without a letter (Unicode category L), is
`und` with score 0; more than MAX_LANGS labelled languages are an error;
equal code lengths go to the smaller language name; without any training text
every text is `und`; a null doc_id is never trained on nor held out. The lang,
source and doc_id columns are no inputs of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import blocks, column_bytes

UNKNOWN = "und"
ORDER = 3
#: About so many texts of each language are learnt from, chosen by a hash of doc_id.
SAMPLE = 1500
MAX_LANGS = 256
#: Fixed point of code lengths: parts of a bit.
SCALE = 1024
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte letters after 0xC3."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    lead = np.r_[False, data[:-1] == 0xC3] if len(data) else np.zeros(0, bool)
    out[lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)] += 32
    return out


def _before(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three bytes before each byte; a document begins after spaces."""
    starts, n, out = offsets[:-1], len(data), []
    for k in (1, 2, 3):
        p = np.full(n, 32, np.uint32)
        p[k:] = data[: n - k] if n > k else p[k:]
        for j in range(k):
            at = starts + j
            p[at[at < n]] = 32
        out.append(p)
    return tuple(out)


def _counts(batches):
    """Occurrences of (three bytes, next byte) by language."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        data, offsets, _ = column_bytes(batch.column("text"))
        for a, b in blocks(offsets):
            part, offs = _folded(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
            p1, p2, p3 = _before(part, offs)
            keys = (p3 << 24) | (p2 << 16) | (p1 << 8) | part
            of = np.repeat(langs[a:b].astype(str), np.diff(offs))
            for lang in np.unique(of):
                k, c = np.unique(keys[of == lang], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([str(lang)] * len(k)), pa.array(k.astype(np.int64)), pa.array(c.astype(np.int64))], names=["lang", "gram", "n"])


class Index:
    """The places of sorted distinct 32-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.shift = keys.astype(np.uint32), 32 - max(8, (4 * len(keys)).bit_length())
        self.slots = np.full(1 << (32 - self.shift), -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(self.keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]  # of several keys one stays
            out = self.slots[slot] != left
            left, slot = left[out], (slot[out] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(self.shift)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for an unknown one."""
        out, left, slot = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(left):
            at = self.slots[slot]
            hit = (at >= 0) & (self.keys[at] == keys)
            out[left[hit]] = at[hit]
            on = (at >= 0) & ~hit
            left, slot, keys = left[on], (slot[on] + 1) % len(self.slots), keys[on]
        return out


class Trees:
    """The compiled context trees: for each order, code lengths by language of the pairs of context and byte, and of escapes."""

    def __init__(self, langs: list[str], grams: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, size = langs, len(langs)
        self.pairs, self.bits, self.contexts, self.escapes = [], [], [], []
        lower = None
        for order in range(ORDER + 1):
            mask = (1 << (8 * (order + 1))) - 1
            pairs = np.unique(np.concatenate([k & mask for k, _ in grams]))
            contexts, of = np.unique(pairs >> 8, return_inverse=True)
            seen = np.zeros((len(pairs), size))
            for lang, (keys, counts) in enumerate(grams):
                np.add.at(seen[:, lang], np.searchsorted(pairs, keys & mask), counts)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            escape = np.log2(np.where(total > 0, (total + kinds) / np.maximum(kinds, 1), 1.0))
            shorter = 8.0 if lower is None else lower[1][np.searchsorted(lower[0], pairs & (mask >> 8))]
            bits = np.where(seen > 0, np.log2(np.maximum(total + kinds, 1)[of] / np.maximum(seen, 1)), escape[of] + shorter)
            lower = pairs, bits
            self.pairs.append(Index(pairs))
            self.contexts.append(Index(contexts))
            self.bits.append(np.rint(bits * SCALE).astype(np.int32))
            self.escapes.append(np.rint(escape * SCALE).astype(np.int32))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each four-byte window, in parts of a bit, by language."""
        out = np.zeros((len(grams), len(self.langs)), np.int32)
        left = np.arange(len(grams))
        for order in range(ORDER, -1, -1):
            keys = grams[left] & np.uint32((1 << (8 * (order + 1))) - 1)
            at = self.pairs[order].find(keys)
            known = at >= 0
            out[left[known]] += self.bits[order][at[known]]
            left, keys = left[~known], keys[~known]
            at = self.contexts[order].find(keys >> np.uint32(8))
            out[left[at >= 0]] += self.escapes[order][at[at >= 0]]
        out[left] += 8 * SCALE
        return out

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length in bits of each document under each language."""
        part = _folded(data)
        p1, p2, p3 = _before(part, offsets)
        cost = self.costs((p3 << 24) | (p2 << 16) | (p1 << 8) | part)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            out[full] = np.add.reduceat(cost, offsets[:-1][full], axis=0, dtype=np.int64) / SCALE
        return out


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """Languages in order, and for each the distinct grams and their counts, from texts that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} labelled languages")
    if not sizes:
        return [], []
    share = F.create_map(*(x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, sample / n)))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(place < F.element_at(share, F.col("lang"))).select("lang", "text")
    found = chosen.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(found.column("lang").to_pylist(), object)
    grams, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    langs, out = sorted(set(lang)), []
    for k in langs:
        at = np.flatnonzero(lang == k)
        at = at[np.argsort(grams[at])]
        out.append((grams[at], n[at]))
    return langs, out


def _predict(model):
    def run(batches):
        trees = model.value
        langs = trees.langs if trees is not None else []
        for batch in batches:
            texts = batch.column("text")
            lettered = np.array([bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            data, offsets, _ = column_bytes(texts)
            n = len(texts)
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if trees is not None:
                for a, b in blocks(offsets):
                    bits = trees.lengths(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    best[a:b] = bits.argmin(1)
                    score[a:b] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
            lettered &= trees is not None
            pred = [langs[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(np.where(lettered, score, 0.0))], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of docs, which has doc_id, text and lang."""
    langs, grams = train(docs, sample)
    # some 40 bytes for each distinct window of the sampled texts, and 4 more for each language
    model = spark.sparkContext.broadcast(Trees(langs, grams) if langs else None)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
