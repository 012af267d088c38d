"""MinHash near-duplicate components with circulant signatures.

Two permutations give all coordinates: sigma places a shingle on a circle of
2**32 points and pi, read at the point moved on by k, is coordinate k. Bands
of coordinates put documents in buckets; every link is confirmed on the full
shingle sets. Documents with equal sets are one class before anything else,
and buckets are worked off as stars around one member, so no group of copies
is ever expanded into its pairs.

Defined results: null or wordless text has no shingles, links with nothing
and is kept; rows that repeat a text are rows of one component; rows that
repeat a doc_id are each judged by their own text, so with different texts they
may be in different components; a null doc_id links by its text like any other, and its component is the
smallest non-null doc_id reachable, or null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesops import Words, blocks, column_bytes, mix64, multipliers, shingles
from .store import Scratch, narrow

WIDTH = 5
BANDS = 32
ROWS = 4
#: Rounds of stars before the remaining pairs of a bucket are compared directly.
STAR_ROUNDS = 2
#: Members of a bucket that one task compares with as many others at a time.
BLOCK = 512
_SHIFTS = (0, 12, 24, 36)
_SIGMA, _PI_A, _PI_B = 0x5851F42D4C957F2D, 0x7FEB352D, 0x846CA68B


def signatures(sets: np.ndarray, bounds: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash: one row of 32-bit coordinates for each non-empty set."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((len(full), coordinates), np.uint32)
    if not len(full):
        return out
    place = (mix64(sets ^ np.uint64(_SIGMA)) >> np.uint64(32)).astype(np.uint32)
    first = bounds[:-1][full]
    point = np.empty_like(place)
    for k in range(coordinates):
        np.add(place, np.uint32(k), out=point)
        point ^= point >> np.uint32(16)
        point *= np.uint32(_PI_A)
        point ^= point >> np.uint32(15)
        point *= np.uint32(_PI_B)
        out[:, k] = np.minimum.reduceat(point, first)
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit bucket key for each band, different from band to band."""
    factor = multipliers(rows, 23)
    keys = np.zeros((len(signature), bands), np.uint64)
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    for r in range(rows):
        keys += parts[:, :, r] * factor[r]
    return mix64(keys ^ (np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _features(batches):
    """doc_id, n_shingles, node (a digest of the set), buckets."""
    for batch in batches:
        data, offsets, _ = column_bytes(batch.column("text"))
        for a, b in blocks(offsets):
            words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            sets, bounds = shingles(words, WIDTH)
            sizes = np.diff(bounds)
            keys = band_keys(signatures(sets, bounds))
            nodes = [_digest(sets[bounds[i] : bounds[i + 1]]) if sizes[i] else None for i in range(b - a)]
            ends = np.r_[0, np.cumsum(np.where(sizes > 0, BANDS, 0))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel(), pa.int64()))],
                names=["doc_id", "n_shingles", "node", "buckets"],
            )


def _bits(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter of node keys, of at most 2**26 bits: past its size it lets more through, never less."""
    n = nodes.count()
    bits = 1 << min(26, max(16, (16 * n).bit_length()))
    places = nodes.select(F.explode(F.array(*(F.shiftrightunsigned("key", s).bitwiseAND(F.lit(bits - 1).cast("long")) for s in _SHIFTS))).alias("p"))
    rows = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return words.view(np.uint64), bits


def _sets_of(words: np.ndarray, bits: int):
    """The shingle sets of the nodes that the filter knows."""

    def run(batches):
        for batch in batches:
            data, offsets, _ = column_bytes(batch.column("text"))
            for a, b in blocks(offsets):
                sets, bounds = shingles(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), WIDTH)
                nodes, own, ends = [], [], [0]
                for i in range(b - a):
                    if bounds[i + 1] > bounds[i]:
                        node = _digest(sets[bounds[i] : bounds[i + 1]])
                        key = int.from_bytes(node[:8], "big")
                        if all(int(words[(p := (key >> s) & (bits - 1)) >> 6]) >> (p & 63) & 1 for s in _SHIFTS):
                            nodes.append(node)
                            own.append(sets[bounds[i] : bounds[i + 1]])
                            ends.append(ends[-1] + len(own[-1]))
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own).view(np.int64), pa.int64()))], names=["node", "shingles"])

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= similarity * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size("sa") + F.size("sb")
    common = F.size(F.array_intersect("sa", "sb"))
    # the size bound alone rules out many pairs before any set is read
    sized = F.least(F.size("sa"), F.size("sb")) * 100 >= F.greatest(F.size("sa"), F.size("sb")) * similarity
    return pairs.join(left, "a").join(right, "b").where(sized).where(common * 100 >= (both - common) * similarity).select("a", "b")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of links (a, b): hook each node to its smallest neighbour, contract, repeat.

    Nodes are digests, so their order is random and the graph at least about
    halves with each round. Rounds are cut by written tables.
    """
    edges = scratch.table(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up")))
        up = parent.select(F.col("node").alias("root"), "up")
        before, labels = labels, scratch.table(parent.select("node", F.col("up").alias("root")) if labels is None else labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        pa_, pb = parent.select(F.col("node").alias("a"), F.col("up").alias("ua")), parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        old, edges = edges, scratch.table(edges.join(pa_, "a").join(pb, "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        scratch.drop(old, parent, *([] if before is None else [before]))
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _rooted(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))


def _block_links(similarity: int):
    """Links across components inside one block pair of a bucket; rows of a block pair follow one another."""

    def links(part: pa.Table):
        asks = part.column("asks").to_numpy()
        sizes = part.column("shingles").combine_chunks().value_lengths().to_numpy().astype(np.int64)
        flat = part.column("shingles").combine_chunks().flatten().to_numpy()
        roots = np.unique(np.array(part.column("root").to_pylist(), object), return_inverse=True)[1].reshape(-1)
        first = np.r_[0, np.cumsum(sizes)]
        values, ids = np.unique(flat, return_inverse=True)
        here = np.zeros(len(values), np.int64)
        members = np.flatnonzero(~asks)
        nodes = part.column("node")
        if not len(members):
            return
        # each document of the second side, one after another in ids
        own = np.concatenate([np.arange(first[m], first[m + 1]) for m in members])
        own_ids, own_first = ids[own], np.r_[0, np.cumsum(sizes[members])][:-1]
        for q in np.flatnonzero(asks):
            if not ((roots[members] != roots[q]).any()):
                continue
            mine = ids[first[q] : first[q + 1]]
            here[mine] = 1
            common = np.add.reduceat(here[own_ids], own_first)
            here[mine] = 0
            near = (100 * common >= similarity * (sizes[q] + sizes[members] - common)) & (roots[members] != roots[q])
            for root in np.unique(roots[members[near]]):
                m = members[near][roots[members[near]] == root][0]
                yield nodes[int(q)].as_py(), nodes[int(m)].as_py()
                roots[roots == root] = roots[q]

    def run(batches):
        held, at = [], None

        def flush():
            out = sorted({(min(x), max(x)) for x in links(pa.Table.from_batches(held))})
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("bucket", "qb", "mb")], 1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, len(keys)] if len(keys) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if at is not None and at != tuple(keys[a]):
                    yield flush()
                    held = []
                at = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield flush()

    return run


def _open_links(rooted: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Confirmed links across components in the buckets that still hold more than one.

    Every member outside the bucket's main component asks all members. Both
    sides come in blocks of about BLOCK, so a task holds two blocks of sets
    and only true links leave it.
    """
    by_root = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    still = by_root.groupBy("bucket").agg(F.sum("n").alias("m"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks_of = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    rows = rooted.join(still, "bucket").withColumns({"qn": blocks_of(F.col("m") - F.col("most")), "mn": blocks_of(F.col("m")), "h": F.xxhash64("node")})
    ask = rows.where("root <> main").select("bucket", F.pmod("h", F.col("qn").cast("long")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("mn") - 1)).alias("mb"), F.lit(True).alias("asks"), "node", "root")
    told = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qb"), F.pmod("h", F.col("mn").cast("long")).cast("int").alias("mb"), F.lit(False).alias("asks"), "node", "root")
    key = ["bucket", "qb", "mb"]
    full = ask.unionByName(told).join(sets, "node").select(*key, "asks", "node", "root", "shingles")
    return full.repartition(*key).sortWithinPartitions(*key).mapInArrow(_block_links(similarity), "a binary, b binary").distinct()


def _grow(scratch: Scratch, links: DataFrame | None, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    grown = scratch.table(more if links is None else links.unionByName(more))
    if links is not None:
        scratch.drop(links)
    return grown, components(grown, scratch)


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: int = 75) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(spark, "neardup")
    docs = narrow(docs)
    found = scratch.table(docs.mapInArrow(_features, "doc_id long, n_shingles long, node binary, buckets array<long>"))
    sized = found.where("n_shingles > 0")
    classes = scratch.table(sized.groupBy("node").agg(F.min("doc_id").alias("low"), F.min("buckets").alias("buckets")))
    all_members = classes.select("node", F.explode("buckets").alias("bucket"))
    shared = all_members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = scratch.table(all_members.join(shared, "bucket").select("bucket", "node"))
    involved = members.select("node").distinct()
    # the texts are read a second time; only the sets of documents that share a bucket are shuffled
    words, bits = _bits(involved.select(F.conv(F.substring(F.hex("node"), 1, 16), 16, -10).cast("long").alias("key")))
    again = docs.select("text").mapInArrow(_sets_of(words, bits), "node binary, shingles array<long>")
    sets = scratch.table(again.groupBy("node").agg(F.first("shingles").alias("shingles")).join(involved, "node", "left_semi"))
    links, labels = None, None
    for turn in range(STAR_ROUNDS):
        rooted = members.select("bucket", "node", F.col("node").alias("root")) if labels is None else _rooted(members, labels)
        # a star around one member of each bucket that still holds two components; the centre moves from round to round
        key = F.struct(F.xxhash64("node", F.lit(turn)), "node", "root")
        centres = rooted.groupBy("bucket").agg(F.min(key).alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket", F.col("c.node").alias("b"), F.col("c.root").alias("rb"))
        pairs = rooted.join(centres, "bucket").where("root <> rb").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        links, labels = _grow(scratch, links, _confirmed(pairs, sets, similarity))
    rooted = _rooted(members, labels)
    links, labels = _grow(scratch, links, _open_links(rooted, sets, similarity))
    root = found.select("doc_id", "n_shingles", "node").join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
    # written first, so that a component of many rows can be split in the join
    lowest = scratch.table(root.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("low")))
    scratch.drop(classes, members, sets, links)  # the result reads found, labels and lowest only
    out = root.join(lowest, "root", "left").withColumn("component_id", F.coalesce("low", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
