"""Byte-level BPE encoding by tree concatenation, and decoding.

Text longer than a leaf is cut in halves down to leaves; the leaves are
encoded in parallel and joined bottom-up. At each join only a window around
the cut is encoded again. The window grows until both sides agree with it:
either its ends are places where every reading of the text begins a new
piece (white space after something else), or its first and last tokens are
the very tokens of the two halves, which makes every neighbouring pair of
the joined sequence a pair that the merge rules leave alone.

Defined results: null text is the empty text (no tokens); a special token's
string in a text becomes that token, as the tokenizer file says; rows that
repeat are encoded each on their own.
"""

from __future__ import annotations

import hashlib
import json
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import worker_cache
from .store import narrow

#: Characters of a leaf, and of the first window on each side of a cut.
LEAF, WINDOW = 4096, 24
#: How byte-level tokenizers of this family split text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters that the pattern takes as white space (fixed value).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters about a cut in an unsplit stretch: more than a contraction is long or the pattern looks ahead.
CLEAR = 4
_EDGE = regex.compile(rf"(?<=[^{WHITE}])[{WHITE}]")
_CLEAR = regex.compile(rf"[^{WHITE}']{{{CLEAR}}}")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + k)] = b
    return out


class Codec:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]
        if spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"] or spec["model"].get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are understood")
        letters = byte_letters()
        self.leaf, self.window = leaf, window
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with white space or word rules are not understood")
        vocab = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        merged = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][a + b] for a, b in merged]
        if ids != sorted(ids):
            raise ValueError("the merge order must be the order of ids")
        self.core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * top
        for word, i in [*vocab.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes_of[i] = word
        self.digits = [str(i) for i in range(top)]
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def encode(self, text: str, pool: ThreadPoolExecutor | None = None) -> list[int]:
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text, pool)
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.special[part]] if part in self.special else self._plain(part, pool)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def _plain(self, text: str, pool: ThreadPoolExecutor | None) -> list[int]:
        if len(text) <= self.leaf:
            return self.core.encode_ordinary(text)
        cuts = [(0, len(text))]
        while max(b - a for a, b in cuts) > self.leaf:
            cuts = [x for a, b in cuts for x in (((a, (a + b) // 2), ((a + b) // 2, b)) if b - a > 1 else ((a, b),))]
        texts = [text[a:b] for a, b in cuts]
        ids = list((pool.map if pool else map)(self.core.encode_ordinary, texts))
        while len(texts) > 1:
            pairs = range(0, len(texts) - 1, 2)
            joined = [self._join(texts[i], ids[i], texts[i + 1], ids[i + 1]) for i in pairs]
            rest = len(texts) % 2
            texts = [texts[i] + texts[i + 1] for i in pairs] + texts[len(texts) - rest :]
            ids = joined + ids[len(ids) - rest :]
        return ids[0]

    def _join(self, a: str, ia: list[int], b: str, ib: list[int]) -> list[int]:
        """The encoding of a + b from the encodings of a and b."""
        size = self.window
        while True:
            whole_a, whole_b = size >= len(a), size >= len(b)
            left, ka, sure_a = (0, 0, True) if whole_a else self._left(a, ia, size)
            right, kb, sure_b = (len(b), len(ib), True) if whole_b else self._right(b, ib, size)
            if left is not None and right is not None:
                middle = self.core.encode_ordinary(a[left:] + b[:right])
                if (sure_a or middle[0] == ia[ka]) and (sure_b or middle[-1] == ib[kb - 1]):
                    return ia[:ka] + middle + ib[kb:]
            size *= 2

    def _left(self, a: str, ia: list[int], size: int) -> tuple[int | None, int, bool]:
        """Where the window begins in a, how many tokens of a end there, and whether a piece surely begins there; None if a longer window is needed."""
        edge = _EDGE.search(a, len(a) - size)
        raw = a[edge.start() if edge else len(a) - size :].encode()
        found, k, at = None, len(ia), len(raw)
        while at > 0:
            k -= 1
            at -= len(self.bytes_of[ia[k]])
            if not edge and at >= 0 and self._clear(raw, at):
                found = at, k
        if edge:
            return (edge.start(), k, True) if at == 0 else (None, 0, False)
        return (len(a) - len(raw[found[0] :].decode()), found[1], False) if found else (None, 0, False)

    def _right(self, b: str, ib: list[int], size: int) -> tuple[int | None, int, bool]:
        """The same for where the window ends in b."""
        edges = [m.start() for m in _EDGE.finditer(b, 0, size + 1)]
        raw = b[: edges[-1] if edges else size].encode()
        found, k, at = None, 0, 0
        while at < len(raw):
            at += len(self.bytes_of[ib[k]])
            k += 1
            if not edges and at <= len(raw) and self._clear(raw, at):
                found = at, k
        if edges:
            return (edges[-1], k, True) if at == len(raw) else (None, 0, False)
        return (len(raw[: found[0]].decode()), found[1], False) if found else (None, 0, False)

    @staticmethod
    def _clear(raw: bytes, at: int) -> bool:
        """Whether CLEAR harmless characters stand on both sides of a place, which is no place inside a character."""
        if at == len(raw) or raw[at] & 0xC0 == 0x80:
            return False
        before = raw[max(0, at - 4 * CLEAR) : at].decode("utf-8", "ignore")[-CLEAR:]
        return bool(_CLEAR.match(before) and _CLEAR.match(raw[at : at + 4 * CLEAR].decode("utf-8", "ignore")))


def codec(path: str) -> Codec:
    """The codec of a file, made once in each Python worker."""
    cache = worker_cache().setdefault("codecs", {})
    if path not in cache:
        cache[path] = Codec(path)
    return cache[path]


def _digests(path: str):
    def run(batches):
        own = codec(path)
        with ThreadPoolExecutor(2) as pool:
            for batch in batches:
                counts, hashed, decoded = [], [], []
                for text in batch.column("text").to_pylist():
                    ids = own.encode(text or "", pool)
                    counts.append(len(ids))
                    hashed.append(hashlib.sha256(",".join(map(own.digits.__getitem__, ids)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _token_lists(path: str):
    def run(batches):
        own = codec(path)
        with ThreadPoolExecutor(2) as pool:
            for batch in batches:
                ids = [own.encode(text or "", pool) for text in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return run


def _texts(path: str):
    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every text."""
    return narrow(docs).mapInArrow(_token_lists(path), "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every id list; null stays null."""
    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_texts(path), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, one row for each document."""
    return narrow(docs).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
