"""Terms of many texts at once, as 64-bit numbers: counts of documents, lengths of tf-idf vectors and scores, without a row for each term of a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are counted at once, and the most of them times their texts; rows that a task holds before it sums or cuts them.
TEXT, CROWD, HELD = 400_000, 24_000_000, 2_000_000
#: Scores are rounded to six decimals before they are ranked, so what is less than this below the k-th may still tie with it.
MARGIN = 1.001e-6
_K = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _K
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, and the place of each number among them."""
    coded = pa.array(x.view(np.int64)).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).view(np.uint64), coded.indices.to_numpy(zero_copy_only=False)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of every range, one range after another."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Texts:
    """Words between ASCII white space of some texts: doc (place of a word's text), and a 64-bit number of each word."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        held = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        blank = (held == 32) | ((held >= 9) & (held <= 13))
        inner = ~blank
        first = inner.copy()
        first[1:] &= blank[:-1]
        last = inner.copy()
        last[:-1] &= blank[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(held))]  # a word ends with its text
        first[cuts] |= inner[cuts]
        last[cuts - 1] |= inner[cuts - 1]
        self.held, self.start, self.end = held, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        size = self.end - self.start
        place = spread(np.zeros(len(size), np.int64), size)
        letters = mixed(held[spread(self.start, size)].astype(np.uint64) | ((place + 1).astype(np.uint64) << np.uint64(8)))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(letters, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
            self.key = mixed(total + size.astype(np.uint64) * _K)


def joined_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of two neighbouring words."""
    with np.errstate(over="ignore"):
        return mixed(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F))


def _letters(points: np.ndarray, place: int) -> np.ndarray:
    """Numbers of code points at a place of an n-gram."""
    out = _KNOWN[place][points & np.uint32(0xFFFF)]
    rare = np.flatnonzero(points > 0xFFFF)
    if len(rare):
        out[rare] = mixed(points[rare].astype(np.uint64) | np.uint64((place + 1) << 32))
    return out


_KNOWN = [mixed(np.arange(1 << 16, dtype=np.uint64) | np.uint64((place + 1) << 32)) for place in range(5)]


def gram_keys(points: np.ndarray, low: int = 3, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(grams of each word, keys in the order of words) of code points of words, each between two spaces of its own."""
    spaces = np.flatnonzero(points == 32)
    size = spaces[1::2] + 1 - spaces[0::2]
    left = np.repeat(spaces[1::2] + 1, size) - np.arange(len(points))  # code points from here to the end of the word
    many = np.clip(left - low + 1, 0, high - low + 1)
    at = np.cumsum(many) - many
    keys = np.zeros(int(many.sum()), np.uint64)
    total = np.zeros(len(points), np.uint64)
    for j in range(high):
        with np.errstate(over="ignore"):
            total[: len(points) - j] += _letters(points[j:], j)
        if j + 1 >= low:
            here = np.flatnonzero(left >= j + 1)
            keys[at[here] + j + 1 - low] = total[here]
    return np.add.reduceat(many, spaces[0::2]) if len(size) else np.zeros(0, np.int64), keys


class WordTerms:
    """(doc, key) of the words and neighbouring words of texts whose tokens stand between spaces."""

    def __init__(self, texts: pa.Array):
        t = Texts(texts)
        near = np.flatnonzero(t.doc[1:] == t.doc[:-1])
        self.keys, own = distinct(np.concatenate([t.key, joined_keys(t.key[near], t.key[near + 1])]))
        doc = np.concatenate([t.doc, t.doc[near]])
        self.docs = len(texts)
        cells = np.sort(doc * np.int64(max(1, len(self.keys))) + own)
        first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
        self.doc, self.own = np.divmod(cells[first], max(1, len(self.keys)))
        self.tf = np.diff(np.r_[first, len(cells)])

    def matrix(self, of: np.ndarray) -> np.ndarray:
        """Counts of some terms, by their places in keys."""
        column = np.full(len(self.keys), -1)
        column[of] = np.arange(len(of))
        c = column[self.own]
        hit = c >= 0
        out = np.zeros((self.docs, len(of)))
        out[self.doc[hit], c[hit]] = self.tf[hit]
        return out


class GramTerms:
    """Counts of the character n-grams of each word of texts, as a matrix."""

    def __init__(self, texts: pa.Array):
        t = Texts(texts)
        self.docs = len(texts)
        words, word = distinct(t.key)
        one = np.zeros(len(words), np.int64)
        one[word[::-1]] = np.arange(len(word))[::-1]  # where each word stands first
        size = t.end[one] - t.start[one]
        padded = np.full(int(size.sum()) + 2 * len(size), 32, np.uint8)
        padded[spread(np.cumsum(size + 2) - size - 1, size)] = t.held[spread(t.start[one], size)]
        points = np.frombuffer(padded.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        many, keys = gram_keys(points)
        self.keys, gram = distinct(keys)
        at = np.cumsum(many) - many
        n = many[word]
        cells = gram[spread(at[word], n)] + np.repeat(t.doc * np.int64(len(self.keys)), n)
        self.counts = np.bincount(cells, minlength=self.docs * len(self.keys)).reshape(self.docs, len(self.keys))

    @property
    def doc(self) -> np.ndarray:
        return np.nonzero(self.counts)[0]

    @property
    def own(self) -> np.ndarray:
        return np.nonzero(self.counts)[1]

    @property
    def tf(self) -> np.ndarray:
        return self.counts[np.nonzero(self.counts)]

    def matrix(self, of: np.ndarray) -> np.ndarray:
        return self.counts[:, of].astype(np.float64)


KINDS = {"bm25": WordTerms, "dense": GramTerms}


def term_keys(terms: list[str], kind: str) -> np.ndarray:
    """The numbers of terms that are written out."""
    if kind == "bm25":
        t = Texts(pa.array(terms, pa.string()))
        first = np.searchsorted(t.doc, np.arange(len(terms)))
        two = np.bincount(t.doc, minlength=len(terms)) == 2
        out = t.key[first]
        out[two] = joined_keys(t.key[first[two]], t.key[first[two] + 1])
        return out
    size = np.array([len(t) for t in terms], np.int64)  # every n-gram has code points
    points = np.frombuffer("".join(terms).encode("utf-32-le"), np.uint32)
    place = spread(np.zeros(len(size), np.int64), size)
    letters = np.zeros(len(points), np.uint64)
    for j in range(int(size.max(initial=0))):
        letters[place == j] = _letters(points[place == j], j)
    with np.errstate(over="ignore"):
        return np.add.reduceat(letters, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)


def parts(batches, kind: str, *more: str):
    """(terms, doc keys, other columns) of some texts at a time, of about TEXT bytes."""
    for batch in batches:
        texts = batch.column("_text")
        sizes = np.r_[0, np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))]
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + TEXT, side="right")) - 1)
            while to - at > 1 and (to - at) * (sizes[to] - sizes[at]) > CROWD:
                to = at + (to - at) // 2
            if sizes[to] > sizes[at]:
                yield KINDS[kind](texts.slice(at, to - at).fill_null("")), batch.column("doc").slice(at, to - at), *(batch.column(c).slice(at, to - at) for c in more)
            at = to


def document_numbers(kind: str, asked=None):
    """For mapInArrow: (key, df) of the terms of a task's texts; asked: a broadcast of sorted keys, without it all terms."""

    def count(batches):
        only = None if asked is None else asked.value
        keys, numbers, size, limit = [], [], 0, HELD
        for terms, _ in parts(batches, kind):
            df = np.bincount(terms.own, minlength=len(terms.keys)) if kind != "dense" else np.count_nonzero(terms.counts, axis=0)
            own = terms.keys
            if only is not None:
                hit = found(only, own)[1]
                own, df = own[hit], df[hit]
            keys.append(own)
            numbers.append(df)
            size += len(own)
            if size > limit:
                keys, numbers = ([x] for x in summed(keys, numbers))
                size = len(keys[0])
                limit = 2 * max(HELD // 2, size)
        if keys:
            k, n = summed(keys, numbers)
            for a in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64))], names=["key", "df"])

    return count


def summed(keys: list[np.ndarray], numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, own = distinct(np.concatenate(keys))
    return k, np.bincount(own, np.concatenate(numbers), len(k)).astype(np.int64)


def found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and which are there."""
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return at, (known[at] == keys if len(known) else np.zeros(len(keys), bool))


def dealt(kind: str, bits: int):
    """For mapInArrow: the terms of a batch's texts by the first bits of their keys: (bucket, docs, doc (a place in docs), keys, tf)."""

    def deal(batches):
        for batch in batches:
            own = [(t.doc, t.keys[t.own], t.tf, docs) for t, docs in parts([batch], kind)]
            if not own:
                continue
            before = np.cumsum([0] + [len(x[3]) for x in own])
            doc = np.concatenate([x[0] + n for x, n in zip(own, before, strict=False)]).astype(np.int32)
            key, tf = np.concatenate([x[1] for x in own]), np.concatenate([x[2] for x in own]).astype(np.int32)
            docs = pa.concat_arrays([x[3] for x in own])
            bucket = (key >> np.uint64(64 - bits)).astype(np.uint16) if bits else np.zeros(len(key), np.uint16)
            order = np.argsort(bucket, kind="stable")
            bucket, doc, key, tf = bucket[order], doc[order], key[order].view(np.int64), tf[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(bucket)], strict=True):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (docs, pa.array(doc[a:b]), pa.array(key[a:b]), pa.array(tf[a:b]))]
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[a])], pa.int32()), *lists], names=["bucket", "docs", "at", "keys", "tf"])

    return deal


def squares(n: int):
    """For applyInArrow on a bucket: (doc, part), each document's sum of squared tf-idf weights of the bucket's terms."""

    def weigh(t: pa.Table) -> pa.Table:
        flat = lambda c: t.column(c).combine_chunks()
        docs, at, keys, tf = (pa.concat_arrays([x.flatten() for x in t.column(c).chunks]) for c in ("docs", "at", "keys", "tf"))
        sizes, many = (pc.list_value_length(flat(c)).to_numpy(zero_copy_only=False) for c in ("docs", "keys"))
        doc = at.to_numpy() + np.repeat(np.cumsum(sizes) - sizes, many)
        order = np.argsort(keys.to_numpy())
        key = keys.to_numpy()[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        df = np.diff(np.r_[first, len(key)])
        w = tf.to_numpy()[order] * np.repeat(idf(df, n), df)
        part = np.bincount(doc[order], w * w, len(docs))
        some = np.flatnonzero(part)
        return pa.table([docs.take(pa.array(some)), pa.array(part[some])], names=["doc", "part"])

    return weigh


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


class _Best:
    """The k largest scores of each query, and those that may tie with the k-th."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.zeros(queries)
        self.rows: list[tuple] = []
        self.size, self.limit = 0, HELD

    def add(self, q: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        self.rows.append((q, doc, score))
        self.size += len(q)
        if self.size > self.limit:
            self.cut()
            self.limit = 2 * max(HELD // 2, self.size)

    def cut(self) -> tuple:
        q, doc, score = (np.concatenate([r[i] for r in self.rows]) if self.rows else np.zeros(0, np.int64) for i in range(3))
        order = np.lexsort((-score, q))
        q, doc, score = q[order], doc[order], score[order]
        first = np.searchsorted(q, np.arange(len(self.least) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.least[full] = score[first[full] + self.k - 1] - MARGIN
        kept = score >= self.least[q] if len(q) else np.zeros(0, bool)
        self.rows, self.size = [(q[kept], doc[kept], score[kept])], int(kept.sum())
        return self.rows[0]


def ranked(kind: str, shared, k: int, cells: int):
    """For mapInArrow: (q, doc, score) of a task's texts, at least the first k of each query.

    shared is a broadcast of (asked, keys, weights, first, query, value, qn): the
    queries; sorted keys of terms with the squares of their idf, all terms of
    the texts or (with the vectors' lengths as column dn) those asked; for each
    of these the queries that ask it with their weights, from first on; and
    the lengths of the queries' vectors.
    """

    def rank(batches):
        asked, keys, weights, first, query, value, qn, has_length = shared.value
        best, docs, before = _Best(len(asked), k), [], 0
        for terms, doc, *length in parts(batches, kind, *(["dn"] if has_length else [])):
            docs.append(doc)
            at, hit = found(keys, terms.keys)
            here = np.flatnonzero(hit)
            if has_length:
                dn = length[0].to_numpy(zero_copy_only=False)
            else:
                square = np.zeros(len(terms.keys))
                square[here] = weights[at[here]]
                dn = np.sqrt(np.square(terms.counts, dtype=np.float64) @ square)
            here = here[first[at[here] + 1] > first[at[here]]]
            if len(here):
                place = at[here]
                many = first[place + 1] - first[place]
                of = spread(first[place], many)
                row, column, v = np.repeat(np.arange(len(here)), many), query[of], value[of]
                counts = terms.matrix(here)
                step = max(1, cells // len(here))
                for a in range(0, len(asked), step):
                    some = (column >= a) & (column < a + step)
                    w = np.zeros((len(here), min(step, len(asked) - a)))
                    w[row[some], column[some] - a] = v[some]
                    score = counts @ w
                    score /= np.where(dn > 0, dn, 1.0)[:, None]
                    score /= qn[a : a + step][None, :]
                    r, c = np.nonzero((score > 0) & (score >= best.least[None, a : a + step]))
                    best.add(c + a, r + before, score[r, c])
            before += len(doc)
        if not docs:
            return
        q, at, score = best.cut()
        docs = pa.concat_arrays(docs)
        for a in range(0, len(q), 100_000):
            part = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(q[part])), docs.take(pa.array(at[part])), pa.array(score[part])], names=["q", "doc", "score"])

    return rank
