"""Mixing by soft membership: document rates whose expected domain totals meet target weights.

A naive Bayes model over hashed byte trigrams, trained from a labelled table,
gives each document a posterior over domains. Nonnegative rates r minimise

    1/2 sum_d (sum_i p_di w_i r_i - t_d)**2 / m_d + ridge/2 sum_i w_i (r_i - 1)**2

(w_i = n_i / N the share of a document in the N tokens, m_d = sum_i p_di w_i the
share of domain d, t_d its target) by projected gradient steps. A step moves
every rate along the same D-vector and then projects it on 0 or more, so a rate
is max(0, 1 + p_i . x) for a D-vector x, and its gradient needs only the D domain
totals. As long as the projection holds the same documents at 0, the totals are
linear in x, with the D x D second moments of the posteriors over the documents
above 0. One pass over the corpus gives these moments; the steps on them
(conjugate gradients, at most D of them) cost nothing; the next pass projects
anew. Step lengths are halved where the dual objective, which a pass gives as
well, does not rise. This ends after as many passes as the set of documents
at 0 changes: two or three where no rate is 0.

Tokens are the words `[^\\x20\\x09-\\x0D]+`. Unless a budget is given, the
total is the smallest for which no domain shrinks, with a little to spare.
`copies` rounds the rate up or down by a variate that follows from doc_id, so
its expectation is the rate.

Defined results: null or empty text has no tokens, the prior as posterior and
rate 1; a domain without tokens is left out of the fit; a fit that stops before
its gradient is below the tolerance warns and says so in `converged`; more than
MAX_DOMAINS labelled domains are an error; without any labelled
text there are no domains, and all rates are 1; rows that repeat get the same
rate each; null labels are not learnt from.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import Words, blocks, column_bytes
from .store import Scratch, narrow, with_columns

BUCKETS = 1 << 14
#: About so many labelled texts of each domain are learnt from, chosen by a hash of doc_id.
SAMPLE = 1000
#: Trigrams that a document's evidence is scaled down to, which keeps posteriors soft.
EVIDENCE = 40.0
#: Weight of staying at rate 1; largest part of the budget that a domain's gradient may be off by; least halvings that end a fit; growth over the smallest budget.
RIDGE, TOLERANCE, HALVINGS, SPARE = 1e-6, 1e-5, 30, 1.05
MAX_DOMAINS = 256


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams of a block, the first of each document that has one, and those documents."""
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    low = data | ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    wide = low.astype(np.uint32)
    bucket = ((((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    sizes = np.diff(offsets)
    inside = np.ones(len(bucket), bool)
    for j in (1, 2):  # trigrams that begin in the last two bytes of a document cross its end
        at = offsets[1:-1] - j
        inside[at[(at >= 0) & (at < len(bucket))]] = False
    full = np.flatnonzero(sizes >= 3)
    return bucket[inside], np.r_[0, np.cumsum(sizes[full] - 2)][:-1], full


def _count(batches):
    for batch in batches:
        names = np.array(batch.column("domain").to_pylist(), str)
        data, offsets, _ = column_bytes(batch.column("text"))
        total = {d: np.zeros(BUCKETS, np.int64) for d in np.unique(names)}
        for a, b in blocks(offsets):
            bucket, first, full = _trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            of = names[a:b][full].repeat(np.diff(np.r_[first, len(bucket)]))
            for d in np.unique(of):
                total[d] += np.bincount(bucket[of == d], minlength=BUCKETS)
        for d, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([str(d)] * len(at)), pa.array(at), pa.array(t[at])], names=["domain", "bucket", "n"])


def train(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Domains in order and the log probability of each bucket, from (doc_id, text, domain)."""
    rows = labelled.where("domain is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("domain").cast("string").alias("domain"))
    sizes = {r["domain"]: r["n"] for r in rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).limit(MAX_DOMAINS + 1).collect()}
    if len(sizes) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} labelled domains")
    if not sizes:
        return [], np.zeros((BUCKETS, 0))
    share = F.create_map(*(x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, sample / n)))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30) < F.element_at(share, F.col("domain")))
    found = chosen.select("text", "domain").mapInArrow(_count, "domain string, bucket long, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toArrow()
    domains = sorted(sizes)
    table = np.ones((BUCKETS, len(domains)))
    where = {d: k for k, d in enumerate(domains)}
    np.add.at(table, (found.column("bucket").to_numpy(), np.array([where[d] for d in found.column("domain").to_pylist()], int)), found.column("n").to_numpy())
    return domains, np.log(table / table.sum(0))


def _posteriors(domains: list[str], table: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and its posterior over the domains."""
    data, offsets, _ = column_bytes(column)
    rows = len(offsets) - 1
    tokens, logs = np.zeros(rows, np.int64), np.zeros((rows, len(domains)))
    for a, b in blocks(offsets):
        part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        tokens[a:b] = Words(part, offs).counts
        bucket, first, full = _trigrams(part, offs)
        if len(full) and domains:
            n = np.diff(np.r_[first, len(bucket)])
            logs[a + full] = np.add.reduceat(table[bucket], first, axis=0) * np.minimum(1.0, EVIDENCE / n)[:, None]
    if not domains:
        return tokens, logs
    p = np.exp(logs - logs.max(1, keepdims=True))
    return tokens, np.round(p / p.sum(1, keepdims=True), 6)


def _lists(p: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))


def _soft(model):
    def run(batch):
        tokens, p = _posteriors(*model.value, batch.column("text"))
        return [pa.array(tokens), _lists(p)]

    return run


def _rates(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 + p @ x)


def _moments(x: np.ndarray):
    """Sums over documents at x, as one flat row: totals of all, totals and second moments of those above 0, the dual's part."""
    size = len(x)

    def run(batches):
        total, above, second, dual = np.zeros(size), np.zeros(size), np.zeros((size, size)), 0.0
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            n = batch.column("n_tokens").to_numpy().astype(np.float64)
            move = p @ x
            on = move > -1
            total += n @ p
            q = p[on] * n[on, None]
            above += q.sum(0)
            second += q.T @ p[on]
            dual += float(n[on] @ (-move[on] * move[on] / 2 - move[on])) + n[~on].sum() / 2
        flat = np.concatenate([total, above, second.ravel(), [dual]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "v"])

    return run


def _conjugate(matrix: np.ndarray, gradient: np.ndarray) -> np.ndarray:
    """Steps of conjugate gradients on matrix @ move = gradient, from no move; matrix is positive definite."""
    scale = 1 / np.sqrt(np.diag(matrix))
    matrix, gradient = matrix * scale[:, None] * scale, gradient * scale
    move, left = np.zeros(len(gradient)), gradient.copy()
    way, least = left.copy(), 1e-28 * float(gradient @ gradient)
    for _ in range(4 * len(gradient)):  # as many as domains, and more for the rounding
        size = float(left @ left)
        if size <= least:
            break
        bent = matrix @ way
        step = size / float(way @ bent)
        move, left = move + step * way, left - step * bent
        way = left + float(left @ left) / size * way
    return move * scale


@dataclass(frozen=True)
class Model:
    """The trained posteriors, the vector x of which every rate is a function, and how the fit ended."""

    domains: list[str]
    table: np.ndarray
    x: np.ndarray
    passes: int = 0
    converged: bool = True


def fit(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | None = None, ridge: float = RIDGE) -> Model:
    """Trains on labelled (doc_id, text, domain) and descends over all docs.

    targets: weights of domains, brought to sum 1; a learnt domain without one has weight 0. budget: tokens wanted in all.
    """
    domains, table = train(labelled)
    size = len(domains)
    if not size:
        return Model(domains, table, np.zeros(0))
    model = spark.sparkContext.broadcast((domains, table.astype(np.float32)))  # BUCKETS times the number of domains
    scratch = Scratch(spark, "mixing")
    soft = scratch.table(with_columns(narrow(docs), _soft(model), "n_tokens long, posterior array<double>").select("n_tokens", "posterior"))

    def at(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        flat = np.zeros(2 * size + size * size + 1)
        for r in soft.mapInArrow(_moments(x), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
            flat[r["k"]] = r["v"]
        return flat[:size], flat[size : 2 * size], flat[2 * size : -1].reshape(size, size), flat[-1]

    x, passes, converged = np.zeros(size), 1, True
    plain, above, second, dual = at(x)
    tokens = plain.sum()
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in domains]) * (plain > 0)
    use = np.flatnonzero(plain > 0)
    if tokens > 0 and weight.sum() > 0:
        weight /= weight.sum()
        if budget is None:
            budget = SPARE * max(plain[d] / weight[d] for d in range(size) if weight[d] > 0)
        goal, kept = weight * budget, ridge * np.diag(plain)
        value = lambda x, dual: ridge * (dual + float(goal @ x)) - ridge * ridge * float(plain @ (x * x)) / 2
        best, gradient = value(x, dual), goal - above - second @ x - ridge * plain * x
        while converged and np.abs(gradient).max() > TOLERANCE * budget:
            move = np.zeros(size)
            move[use] = _conjugate((second + kept)[np.ix_(use, use)], gradient[use])
            for k in range(HALVINGS):
                tried = x + move / 2**k
                _, above, second, dual = at(tried)
                passes += 1
                now, new = value(tried, dual), goal - above - second @ tried - ridge * plain * tried
                if now > best or np.abs(new).max() <= TOLERANCE * budget:
                    x, best, gradient = tried, now, new
                    break
            else:
                converged = False
                warnings.warn(f"the mix ended {np.abs(gradient).max() / budget:.1e} of the budget from its optimum", stacklevel=2)
    scratch.drop(soft)
    return Model(domains, table, x, passes, converged)


def _rated(model, x: np.ndarray):
    def run(batch):
        tokens, p = _posteriors(*model.value, batch.column("text"))
        rate = np.round(np.where(tokens > 0, _rates(p, x), 1.0), 6)
        return [pa.array(tokens), _lists(p), pa.array(rate)]

    return run


def rate(spark: SparkSession, docs: DataFrame, model: Model, seed: int = 5) -> DataFrame:
    """docs with n_tokens, posterior (domains in order of name), rate and copies; docs has doc_id and text."""
    table = spark.sparkContext.broadcast((model.domains, model.table.astype(np.float32)))
    out = with_columns(docs, _rated(table, model.x), "n_tokens long, posterior array<double>, rate double")
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return out.withColumn("copies", (F.floor("rate") + (place < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mix(spark: SparkSession, docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **how) -> DataFrame:
    """doc_id, n_tokens, posterior, rate, copies: one row for each row of docs."""
    return rate(spark, narrow(docs), fit(spark, docs, labelled, targets, **how)).drop("text")
