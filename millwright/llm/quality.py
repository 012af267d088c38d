"""Quality by importance resampling.

Two hashed n-gram models, one of labelled good texts and one of all raw
texts, give each document the log ratio of its probability under both. The
wanted number of documents is then drawn without replacement in proportion to
that ratio by Gumbel top-k: the k largest of log ratio plus a Gumbel variate.
The variate follows from doc_id, so a run can be repeated.

The n-grams are byte 4-grams, and pairs of word forms (first and last
character class, length, capitals, same as the word before), both hashed.

Both the plain log ratio (`log_ratio`) and the one that is drawn by
(`log_weight`) are returned. The latter is scaled down to `evidence` n-grams in
longer documents, since in a sum over n-grams the length of a document decides
before its quality does; with evidence=None they are the same.

How many are drawn follows from the labelled table: as many as have at least
the weight that all but a small share of the good labelled texts reach, less a
part of its distance to the poor ones. There each half of the labelled texts is
weighed by the model of the other half, so few labels make a weak model and a low
cut. That none of n good labelled texts lies below a cut says with confidence
1 - (1 - DOUBT)**n that at most the share DOUBT of all good texts does. This part
of the documents below the cut is left out, so fewer labels reject less, without
a step.

Defined results: null or empty text has log ratio 0; without labelled good
texts every ratio is 0 and all documents are kept; rows that repeat a doc_id and text
have one fate, so ties at the end may keep a few more than k; null doc_id
counts as 0 in the variate. Labels that are null, or of no document, are not
used; of labels that repeat the lowest counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import Words, blocks, column_bytes, sums
from .store import Scratch, narrow, with_columns

#: Buckets of each family of n-grams.
BUCKETS = 1 << 14
#: About so many labelled texts are learnt from, chosen by a hash of doc_id.
SAMPLE = 6000
#: Occurrences by which a bucket is smoothed.
PRIOR = 10.0
#: N-grams that a longer document's evidence is scaled down to; None for plain sums.
EVIDENCE = 200.0
#: Share of good labelled texts that the cut may lose.
LOSS = 0.0005
#: Share of good texts that may lie below the cut for all that the labels say.
DOUBT = 0.05
#: How far the cut moves from there towards the poor labelled texts.
SLACK = 0.25

_FIRST = np.full(256, 4, np.int64)
_FIRST[65:91], _FIRST[97:123], _FIRST[48:58], _FIRST[128:] = 0, 1, 2, 3
_LAST = np.full(256, 3, np.int64)
_LAST[65:91], _LAST[97:123], _LAST[46], _LAST[44], _LAST[48:58], _LAST[128:] = 0, 0, 1, 2, 4, 5


def grams(data: np.ndarray, offsets: np.ndarray):
    """(bucket, document) of every n-gram of a block; documents ascend within each of the two families."""
    n, docs = len(data), len(offsets) - 1
    if n >= 4:
        wide = data.astype(np.uint32)
        key = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
        doc = np.repeat(np.arange(docs), np.diff(offsets))
        inside = doc[:-3] == doc[3:]
        yield ((key[inside] * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64), doc[:-3][inside]
    words = Words(data, offsets)
    if len(words.starts) > 1:
        length = words.ends - words.starts
        capital = np.r_[0, np.cumsum((data >= 65) & (data <= 90))]
        together = words.doc[1:] == words.doc[:-1]
        again = words.repeats()
        form = ((_FIRST[data[words.starts]] * 6 + _LAST[data[words.ends - 1]]) * 8 + np.minimum(length, 15) // 2) * 4 + (capital[words.ends] - capital[words.starts] > 1) * 2 + again
        pair = (form[:-1] * 1024 + form[1:])[together].astype(np.uint32)
        yield BUCKETS + ((pair * np.uint32(2246822519)) >> np.uint32(18)).astype(np.int64), words.doc[1:][together]


def _count(batches):
    """Occurrences of every bucket, in each of two halves."""
    total = np.zeros((2, 2 * BUCKETS), np.int64)
    for batch in batches:
        data, offsets, _ = column_bytes(batch.column("text"))
        half = batch.column("half").to_numpy()
        for a, b in blocks(offsets):
            for bucket, doc in grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                if (half[a:b] == 0).all():
                    total[0] += np.bincount(bucket, minlength=2 * BUCKETS)
                    continue
                second = half[a:b][doc] == 1
                total[0] += np.bincount(bucket[~second], minlength=2 * BUCKETS)
                total[1] += np.bincount(bucket[second], minlength=2 * BUCKETS)
    half, at = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(half), pa.array(at), pa.array(total[half, at])], names=["half", "bucket", "n"])


def counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of every bucket over the texts of each half (0, 1); each task sends its sums only."""
    rows = texts.select(F.col("text").cast("string").alias("text"), F.col("half").cast("int").alias("half"))
    found = rows.mapInArrow(_count, "half long, bucket long, n long").groupBy("half", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, 2 * BUCKETS))
    out[found.column("half").to_numpy(), found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the two models' probabilities of each bucket.

    The target model is smoothed towards the raw one by PRIOR occurrences a
    bucket, so a bucket that the sample could hardly show says nothing.
    """
    out = np.zeros(2 * BUCKETS)
    if not target.sum():
        return out
    for family in (slice(0, BUCKETS), slice(BUCKETS, 2 * BUCKETS)):
        t, r = target[family], raw[family]
        expected = t.sum() * r / max(1.0, r.sum())
        out[family] = np.log((t + PRIOR) / (expected + PRIOR))
    return out


def _weights(table, evidence: float | None, halves: bool = False):
    """Log ratio and weight of each text, by the table of its half if there are halves."""

    def run(batch):
        tables = table.value
        data, offsets, _ = column_bytes(batch.column("text"))
        half = batch.column("half").to_numpy() if halves else np.zeros(batch.num_rows, np.int64)
        out, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for a, b in blocks(offsets):
            for bucket, doc in grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                out[a:b] += sums(tables[half[a:b][doc], bucket] if halves else tables[0][bucket], doc, b - a)
                n[a:b] += np.bincount(doc, minlength=b - a)
        scale = np.minimum(1.0, evidence / np.maximum(n, 1)) if evidence is not None else 1.0
        return [pa.array(np.round(out, 6)), pa.array(np.round(out * scale, 6))]

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """A standard Gumbel variate that follows from doc_id."""
    u = (F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(0)), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, value: str, k: int, few: int = 20000) -> float:
    """The k-th largest value, by histograms over ever narrower ranges; ties count each."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    while True:
        inside = df.where(F.col(value).between(lo, hi))
        if hi <= lo or inside.count() <= few:
            if hi <= lo:
                return lo
            top = sorted((r[0] for r in inside.select(value).collect()), reverse=True)
            return top[k - 1]
        step = (hi - lo) / 1024
        rows = inside.groupBy(F.least(F.floor((F.col(value) - lo) / step), F.lit(1023)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).orderBy(F.desc("b")).collect()
        for r in rows:
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]


@dataclass(frozen=True)
class Model:
    """Log ratios of the buckets, the evidence they are scaled to, and the Gumbel key from which on documents are drawn."""

    ratio: np.ndarray
    least: float
    seed: int
    evidence: float | None = EVIDENCE


def weigh(spark: SparkSession, docs: DataFrame, ratio: np.ndarray, seed: int, evidence: float | None = EVIDENCE) -> DataFrame:
    """docs with log_ratio, log_weight and gumbel_key; docs has doc_id and text."""
    table = spark.sparkContext.broadcast(ratio[None, :])
    weighed = with_columns(docs, _weights(table, evidence), "log_ratio double, log_weight double")
    return weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id").cast("long"), seed))


def cut_of(weight: np.ndarray, good: np.ndarray, loss: float = LOSS) -> float:
    """The weight from which on documents count as good, from the weights of labelled ones."""
    if not good.any():
        return float("-inf")
    cut = float(np.quantile(weight[good], loss))
    return cut if good.all() else cut - SLACK * max(0.0, cut - float(np.quantile(weight[~good], 0.95)))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, loss: float = LOSS, seed: int = 7, evidence: float | None = EVIDENCE) -> Model:
    """Both models and the cut; labels has doc_id and quality (1 good)."""
    docs = narrow(docs)
    labels = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    share = min(1.0, sample / max(1, labels.count()))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30) < share)  # about `sample` ids
    known = docs.join(F.broadcast(chosen.select("doc_id", (F.col("quality") == 1).alias("good"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).alias("half"))), "doc_id")
    raw, target = counts(docs.withColumn("half", F.lit(0)))[0], counts(known.where("good"))
    ratio = log_ratio(target.sum(0), raw)
    scored = Scratch(spark, "quality")
    every = scored.table(weigh(spark, docs, ratio, seed, evidence).select("log_weight", "gumbel_key"))
    across = spark.sparkContext.broadcast(np.stack([log_ratio(target[1], raw), log_ratio(target[0], raw)]))
    found = with_columns(known.select("text", "good", "half"), _weights(across, evidence, True), "log_ratio double, log_weight double").select("log_weight", "good").toArrow()
    good = found.column("good").to_numpy(zero_copy_only=False).astype(bool)
    cut = cut_of(found.column("log_weight").to_numpy(), good, loss)
    total, below = every.agg(F.count(F.lit(1)), F.count_if(F.col("log_weight") < cut)).first()
    k = total - round(below * (1 - (1 - DOUBT) ** int(good.sum())))
    least = float("-inf") if k >= total else kth_largest(every, "gumbel_key", k)
    scored.drop(every)
    return Model(ratio, least, seed, evidence)


def draw(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs with log_ratio, log_weight, gumbel_key and kept."""
    return weigh(spark, docs, model.ratio, model.seed, model.evidence).withColumn("kept", F.col("gumbel_key") >= model.least)


def resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, log_ratio, log_weight, gumbel_key, kept: one row for each row of docs."""
    return draw(spark, narrow(docs), fit(spark, docs, labels, **how)).drop("text")
