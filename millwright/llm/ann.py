"""Nearest neighbours by adaptive dimension scans of inverted lists.

Vectors are normalised and turned by one random rotation. Every vector stands
in the list of its nearest centroid; a query scans its nearest lists. Within
a list the rotated vectors are read in column blocks: after t of D dimensions
the scaled partial distance is tested against the k-th best found so far, and
a candidate whose true distance is smaller only with small probability is
abandoned. What survives gets its exact cosine in double precision on the
original vectors.

Equal vectors are one candidate with its few smallest ids, found by pieces
before any shuffle, and one query; long lists are split into chunks, and the
queries that probe a list into parts, both of bounded size. A task scans one chunk
for one part. So neither a common vector nor a large cluster lands in one task,
nor do the queries of a much-asked list. A list of n vectors with q queries costs
n * q comparisons of few dimensions however it is dealt; there are about the
square root of the number of vectors lists, up to MAX_LISTS, past which (some 16
million vectors) lists grow in proportion.

A query whose lists hold fewer ids than wanted goes on to its next lists until
it has enough or has scanned them all.

Defined results: vectors that are null, zero, hold null or non-finite
components, or are not of the most common length (ties: the longer) take no
part, nor do null ids; with fewer candidates than wanted all are returned; a
repeated row counts once; two different vectors under one id are both
candidates, and both queries, except for each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch

NEIGHBOURS, EVERY = 5, 50
#: Vectors that the centroids are fitted on and the probes measured on; lists; vectors of a chunk; queries of a part.
SAMPLE, MAX_LISTS, CHUNK, PART = 20000, 4096, 4096, 2048
#: Recall on the sample that the number of scanned lists must reach, and the sample's queries.
RECALL, TRIALS = 0.97, 256
#: Column block, tile of rows, tile of queries, and the factor of the test.
BLOCK, TILE, QUERIES, EPSILON = 16, 1024, 256, 2.1


def rotation(size: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors over the power of two that brings their largest component to 0.5 to 1, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _keyed(size: int):
    """vec_id, key of the vector, vector."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), size) + 0.0  # -0.0 is 0.0
            keys = [hashlib.blake2b(row.tobytes(), digest_size=16).digest() for row in x]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), batch.column("v")], names=["vec_id", "key", "v"])

    return run


def _pieces(few: int):
    """The distinct vectors of each batch with their few smallest ids."""

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            keys = np.array(batch.column("key").to_pylist(), object)
            order = np.lexsort((ids, np.unique(keys.astype("S16"), return_inverse=True)[1])) if len(ids) else []
            first, held = [], []
            for i in order:
                if not first or keys[first[-1]] != keys[i]:
                    first.append(i)
                    held.append([])
                if len(held[-1]) < few and (not held[-1] or held[-1][-1] != ids[i]):
                    held[-1].append(int(ids[i]))
            if first:
                at = pa.array(first, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("v").take(at), pa.array(held, pa.list_(pa.int64()))], names=["key", "v", "ids"])

    return run


def _listed(model, size: int, probes: int):
    """Adds the nearest lists of each vector."""

    def run(batches):
        c = model.value[0]
        for batch in batches:
            if not batch.num_rows:
                continue
            near = _units(_matrix(batch.column("v"), size)) @ c.T
            n = min(probes, c.shape[0])
            best = np.argpartition(-near, n - 1, axis=1)[:, :n]
            order = np.argsort(-np.take_along_axis(near, best, axis=1), axis=1, kind="stable")
            best = np.take_along_axis(best, order, axis=1).astype(np.int32)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(best.ravel()))], names=[*batch.schema.names, "lists"])

    return run


def scan(turned: np.ndarray, queries: np.ndarray, limits: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, query) that may be among the wanted nearest, by the adaptive test.

    limits: squared distances beyond which a query wants nothing; they are
    lowered in place as nearer rows are found. A row within its query's limit
    is only lost if its partial distance overshoots by the test's bound.
    """
    size, out = turned.shape[1], ([], [])
    cuts = range(0, size, BLOCK)
    for a in range(0, len(turned), TILE):
        x = turned[a : a + TILE]
        xx = [(x[:, t : t + BLOCK] ** 2).sum(1) for t in cuts]
        for b in range(0, len(queries), QUERIES):
            q, limit = queries[b : b + QUERIES], limits[b : b + QUERIES]
            part, rows, cols = np.zeros((len(x), len(q))), None, None
            for k, t in enumerate(cuts):
                block = slice(t, t + BLOCK)
                if rows is None:
                    part += xx[k][:, None] + (q[:, block] ** 2).sum(1)[None, :] - 2 * (x[:, block] @ q[:, block].T)
                else:
                    part = part + ((x[rows, block] - q[cols, block]) ** 2).sum(1)
                seen = min(t + BLOCK, size)
                scale = 1.0 if seen == size else (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / size
                if rows is None:
                    near = part <= limit[None, :] * scale + 1e-9
                    if seen == size or near.mean() < 0.2:
                        rows, cols = np.nonzero(near)
                        part = part[rows, cols]
                else:
                    near = part <= limit[cols] * scale + 1e-9
                    rows, cols, part = rows[near], cols[near], part[near]
            if len(rows):
                order = np.lexsort((part, cols))
                rows, cols, part = rows[order], cols[order], part[order]
                first = np.flatnonzero(np.r_[True, cols[1:] != cols[:-1]])
                count = np.diff(np.r_[first, len(cols)])
                enough = first[count >= wanted]
                limit[cols[enough]] = np.minimum(limit[cols[enough]], part[enough + wanted - 1])
                near = part <= limit[cols] + 1e-9
                out[0].append(rows[near] + a)
                out[1].append(cols[near] + b)
    return (np.concatenate(out[0]), np.concatenate(out[1])) if out[0] else (np.empty(0, np.int64), np.empty(0, np.int64))


def probes_for(x: np.ndarray, c: np.ndarray, neighbours: int, recall: float = RECALL, trials: int = TRIALS) -> int:
    """Lists to scan so that the sample's own nearest neighbours are found with the wanted recall."""
    q = x[:: max(1, len(x) // trials)][:trials]
    near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
    rank = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
    score = q @ x.T
    n = min(neighbours + 1, len(x))
    best = np.argpartition(-score, n - 1, axis=1)[:, :n]
    needed = np.sort(np.take_along_axis(rank, near[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def _scanned(model, size: int, wanted: int):
    """The best (query, vec_id, score) of each chunk of a list for each part of its queries; rows of one such pair follow one another."""

    def best(part: pa.Table) -> pa.RecordBatch:
        asks = part.column("asks").to_numpy()
        x = _scaled(_matrix(part.column("v").combine_chunks(), size))
        turned, norms = _units(x) @ model.value[1].T, np.sqrt((x * x).sum(1))
        told, asked = np.flatnonzero(~asks), np.flatnonzero(asks)
        r, q = scan(turned[told], turned[asked], part.column("limit").to_numpy()[asked].copy(), wanted)
        r, q = told[r], asked[q]
        score = (x[r] * x[q]).sum(1) / (norms[r] * norms[q])
        # every id of a matching vector; the best few of each query by score, then id
        lists = part.column("ids").combine_chunks().take(pa.array(r, pa.int64()))
        many = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ids, q, score = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(q, many), np.repeat(score, many)
        order = np.lexsort((ids, -score, q))
        ids, q, score = ids[order], q[order], score[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
        keep = place < wanted
        keys = part.column("key").combine_chunks().take(pa.array(q[keep], pa.int64()))
        return pa.RecordBatch.from_arrays([keys, pa.array(ids[keep], pa.int64()), pa.array(score[keep])], names=["key", "vec_id", "score"])

    def run(batches):
        held, at = [], None

        for batch in batches:
            where = np.stack([batch.column(k).to_numpy() for k in ("list", "chunk", "part")], 1)
            cuts = np.r_[0, np.flatnonzero((where[1:] != where[:-1]).any(1)) + 1, len(where)] if len(where) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if at is not None and at != tuple(where[a]):
                    yield best(pa.Table.from_batches(held))
                    held = []
                at = tuple(where[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield best(pa.Table.from_batches(held))

    return run


def nearest(spark: SparkSession, vectors: DataFrame, neighbours: int = NEIGHBOURS, every: int = EVERY, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by `every`. vectors has vec_id, embedding."""
    schema = "query_id long, rank int, vec_id long, score double"
    scratch = Scratch(spark, "ann")
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    size, wanted = lengths[0]["d"], neighbours + 1
    keyed = rows.where(F.size("v") == size).mapInArrow(_keyed(size), f"vec_id long, key binary, v {kind}")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, wanted)
    distinct = scratch.table(keyed.mapInArrow(_pieces(wanted), f"key binary, v {kind}, ids array<long>").groupBy("key").agg(F.first("v").alias("v"), ids.alias("ids")))
    n = distinct.count()
    lists = max(1, min(MAX_LISTS, int(round(n**0.5))))
    share = min(1.0, sample / n)
    chosen = distinct.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30) <= share).select("key", "v").toArrow()  # about `sample` rows
    order = np.argsort(np.array(chosen.column("key").to_pylist(), "S16"), kind="stable")
    units = _units(_matrix(chosen.column("v").combine_chunks(), size))[order]
    centres = centroids(units, lists)
    probes = probes_for(units, centres, neighbours, recall)
    model = spark.sparkContext.broadcast((centres, rotation(size)))  # MAX_LISTS times the dimension
    stored = scratch.table(distinct.mapInArrow(_listed(model, size, 1), f"key binary, v {kind}, ids array<long>, lists array<int>").select(F.get("lists", F.lit(0)).alias("list"), "key", "v", "ids"))
    chunks = F.broadcast(stored.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks")))  # at most MAX_LISTS rows
    told = stored.join(chunks, "list").select("list", F.pmod(F.xxhash64("key"), F.col("chunks").cast("long")).cast("int").alias("chunk"), F.lit(False).alias("asks"), "key", "v", "ids", F.lit(0.0).alias("limit"))
    members = keyed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key").distinct()
    asking = distinct.join(members.select("key").distinct(), "key", "left_semi").select("key", "v")
    probed = scratch.table(asking.mapInArrow(_listed(model, size, probes), f"key binary, v {kind}, lists array<int>"))

    def scanned(asks: DataFrame, lists: DataFrame) -> DataFrame:
        """The best of each chunk for (list, key, v, limit); lists has the list of each of them."""
        parts = F.broadcast(lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(PART)).cast("int").alias("parts")))  # at most MAX_LISTS rows
        dealt = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts").cast("long")).cast("int").alias("part")
        ask = asks.join(chunks, "list").join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), dealt, F.lit(True).alias("asks"), "key", "v", F.lit(None).cast("array<bigint>").alias("ids"), "limit")
        tell = told.join(parts, "list").select("list", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "asks", "key", "v", "ids", "limit")
        at = ("list", "chunk", "part")
        return ask.unionByName(tell).repartition(*at).sortWithinPartitions(*at).mapInArrow(_scanned(model, size, wanted), "key binary, vec_id long, score double")

    def listed(rows: DataFrame, first: int, many: int) -> DataFrame:
        return rows.select(F.explode(F.slice("lists", first, many)).alias("list"))

    # the nearest list comes first; its k-th distance is what the candidates of all other lists are tested against
    near = scratch.table(scanned(probed.select(F.get("lists", F.lit(0)).alias("list"), "key", "v", F.lit(float("inf")).alias("limit")), listed(probed, 1, 1)))
    kth = near.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    limit = F.when(F.col("n") >= wanted, 2 - 2 * F.get("s", F.lit(wanted - 1)) + 1e-9)
    rest = probed.join(kth.select("key", limit.alias("limit")), "key", "left").select("key", "v", F.coalesce("limit", F.lit(float("inf"))).alias("limit"), F.explode(F.slice("lists", 2, max(1, probes - 1))).alias("list"))
    found = near.unionByName(scanned(rest, listed(probed, 2, max(1, probes - 1))))
    # queries whose lists held fewer ids than wanted go on to the next lists, twice as many each time
    seen = probes
    while seen < len(centres):
        found = scratch.table(found)
        enough = found.groupBy("key").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= wanted)
        short = asking.join(enough, "key", "left_anti")
        if short.isEmpty():
            break
        more = scratch.table(short.mapInArrow(_listed(model, size, 2 * seen), f"key binary, v {kind}, lists array<int>"))
        asks = more.select("key", "v", F.lit(float("inf")).alias("limit"), F.explode(F.slice("lists", seen + 1, seen)).alias("list"))
        found, seen = found.unionByName(scanned(asks, listed(more, seen + 1, seen))), 2 * seen
    best = found.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, wanted).alias("near"))
    out = members.join(best, "key").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, neighbours).alias("near"))
    return out.select("query_id", F.posexplode("near").alias("r", "x")).select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
