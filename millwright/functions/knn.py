"""Exact k nearest rows through cells.

A tree of cuts, taken from a bounded sample on the driver, deals the rows to
cells of about BLOCK rows. A row asks its own cell first; the distance of its
k-th neighbour there rules out every cell whose bounding box is farther away,
and only the others are asked then. Inside a cell, rows stand in blocks and
asking rows in parts of bounded size, and a task compares one block with one
part. So a crowded cell is split, and no task holds all asking rows. In few
dimensions a row asks a handful of cells; in many, the boxes rule out little
and the work grows with the product of both sides, in bounded tasks.

Other measures than nan_euclidean have no boxes: every part meets every block.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, asking rows of a part; most cells; rows that the cuts are taken from.
BLOCK, PART, CELLS, SAMPLE = 2048, 4096, 4096, 20000


def nan_euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance over the features that both rows have, scaled up to all of them; NaN where they share none."""
    ha, hb = ~np.isnan(a), ~np.isnan(b)
    x, y = np.where(ha, a, 0.0), np.where(hb, b, 0.0)
    square = (x * x) @ hb.T.astype(float) + ha.astype(float) @ (y * y).T - 2 * x @ y.T
    shared = ha.astype(float) @ hb.T.astype(float)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.sqrt(np.where(shared > 0, np.maximum(square, 0) * a.shape[1] / shared, np.nan))


def cosine_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - cosine, the cosine rounded to six decimals; NaN where a row is zero or has a missing feature."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - np.round(a @ b.T / (np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]), 6)


def cuts(x: np.ndarray, leaves: int, first: int = 0):
    """Nested (feature, cut, below, above) down to cell numbers; the widest feature is cut at its median. Equal rows share a cell."""
    if leaves <= 1 or len(x) < 2:
        return first
    f = int(x.var(0).argmax())
    cut = float(np.median(x[:, f]))
    below = x[:, f] < cut
    if not below.any():
        cut = float(x[x[:, f] > cut, f].min(initial=np.inf))
        below = x[:, f] < cut
        if not np.isfinite(cut):
            return first
    half = leaves // 2
    return f, cut, cuts(x[below], half, first), cuts(x[~below], leaves - half, first + half)


def cells_of(tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int32)

    def walk(node, at: np.ndarray) -> None:
        if isinstance(node, int):
            out[at] = node
            return
        f, cut, below, above = node
        low = x[at, f] < cut
        walk(below, at[low])
        walk(above, at[~low])

    walk(tree, np.arange(len(x)))
    return out


def least_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How near a row can come to any row of each box. NaN bounds: some row of the cell misses the feature, which then counts nothing."""
    square, has = np.zeros((len(x), len(low))), ~np.isnan(x)
    for f in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, f] - x[:, f, None], x[:, f, None] - high[None, :, f]), 0.0)
        square += np.where(np.isnan(gap), 0.0, gap) ** 2
    return np.sqrt(square * x.shape[1] / np.maximum(has.sum(1), 1)[:, None])


def nearest_rows(asks: DataFrame, rows: DataFrame, key: str, features: list[str], k: int, carry: list[str] | None = None, measure: Callable[[np.ndarray, np.ndarray], np.ndarray] = nan_euclidean, block: int | None = None) -> DataFrame:
    """ask, near, distance, place and the carried columns of the near row; a row is never near itself; ties go to the smaller key."""
    carry, block = carry or [], block or BLOCK
    width, names = len(features), [f"_c{i}" for i in range(len(carry))]
    wide = [F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)]
    fs = [f"_f{i}" for i in range(width)]
    told = rows.select(F.col(key).cast("long").alias("_k"), *wide, *(F.col(c).cast("double").alias(n) for n, c in zip(names, carry, strict=True)))
    ask = asks.select(F.col(key).cast("long").alias("_k"), *wide)
    n = told.count()
    leaves = min(CELLS, -(-n // block)) if measure is nan_euclidean else 1
    tree, middle = 0, np.zeros(width)
    if leaves > 1:
        share = min(1.0, 1.2 * SAMPLE / n)
        sample = told.where(F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) / float(1 << 30) < share).select(*fs).limit(2 * SAMPLE).toPandas().to_numpy(float)
        with np.errstate(invalid="ignore"):
            middle = np.nan_to_num(np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in sample.T]))
        tree = cuts(np.where(np.isnan(sample), middle, sample), leaves)

    def cell(*columns: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in columns])
        return pd.Series(cells_of(tree, np.where(np.isnan(x), middle, x)))

    place = F.pandas_udf(cell, "int")(*fs) if leaves > 1 else F.lit(0)
    told, ask = told.withColumn("_cell", place), ask.withColumn("_cell", place)
    bounds = [f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(fs) for f in (F.min, F.max, F.count)]
    boxes = told.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), *bounds).orderBy("_cell").collect()  # at most CELLS rows
    numbers = np.array([b["_cell"] for b in boxes], int)
    edge = lambda f: np.array([[b[f"{f}{i}"] if b[f"count{i}"] == b["n"] else np.nan for i in range(width)] for b in boxes], float).reshape(len(boxes), width)
    low, high = edge("min"), edge("max")
    blocks = {b["_cell"]: -(-b["n"] // block) for b in boxes}
    schema = "_k long, near long, distance double" + "".join(f", {c} double" for c in names)
    plain = "_k long, " + ", ".join(f"{c} double" for c in fs)

    def deal(counted: DataFrame) -> dict[int, int]:
        """Parts of the asking rows of each cell."""
        return {r["_cell"]: -(-r["n"] // PART) for r in counted.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most CELLS rows

    def number(of: dict[int, int]) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in of.items() for x in pair)), F.col("_cell")), F.lit(0)) if of else F.lit(0)

    def pairs(asking: DataFrame, parts: dict[int, int]) -> DataFrame:
        """Blocks of rows beside parts of asking rows, by (_cell, _b, _q)."""
        m, p = number(blocks), number(parts)
        every = lambda size: F.explode(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")))
        one = lambda size, salt: F.pmod(F.xxhash64("_k", F.lit(salt)), F.greatest(size, F.lit(1)).cast("long")).cast("int")
        a = told.select("_cell", one(m, 1).alias("_b"), every(p).alias("_q"), F.lit(False).alias("_asks"), "_k", *fs, *names)
        b = asking.select("_cell", every(m).alias("_b"), one(p, 2).alias("_q"), F.lit(True).alias("_asks"), "_k", *fs, *(F.lit(None).cast("double").alias(c) for c in names))
        return a.unionByName(b)

    def search(part: pd.DataFrame) -> pd.DataFrame:
        told, asked = part[~part["_asks"]].sort_values("_k"), part[part["_asks"]]
        y, ids, out = told[fs].to_numpy(float), told["_k"].to_numpy(), []
        for a in range(0, len(asked) if len(told) else 0, 512):
            own = asked.iloc[a : a + 512]
            d = np.round(measure(own[fs].to_numpy(float), y), 9)
            d[own["_k"].to_numpy()[:, None] == ids[None, :]] = np.nan
            d[np.isnan(d)] = np.inf
            # what is no farther than the k-th, in order of distance and key; ids ascend
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
            r, c = np.nonzero((d <= kth[:, None]) & (d < np.inf))
            order = np.lexsort((c, d[r, c], r))
            r, c = r[order], c[order]
            first = np.r_[0, np.cumsum(np.bincount(r, minlength=len(d)))][:-1]
            few = np.arange(len(r)) - first[r] < k
            r, c = r[few], c[few]
            out.append(pd.DataFrame({"_k": own["_k"].to_numpy()[r], "near": ids[c], "distance": d[r, c]} | {n: told[n].to_numpy()[c] for n in names}))
        return pd.concat(out) if out else pd.DataFrame({"_k": [], "near": [], "distance": []} | {n: [] for n in names})

    def found_in(asking: DataFrame, parts: dict[int, int]) -> DataFrame:
        return pairs(asking, parts).groupBy("_cell", "_b", "_q").applyInPandas(search, schema)

    best = lambda found: found.withColumn("place", F.row_number().over(Window.partitionBy("_k").orderBy("distance", "near"))).where(F.col("place") <= k)
    found = found_in(ask, deal(ask))
    first = None
    if len(boxes) > 1:
        first = found = found.persist()  # read three times: for the reach, to count the parts, and in the result
        reach = best(found).groupBy("_k").agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n"))
        limited = ask.join(reach.where(F.col("n") >= k).select("_k", "d"), "_k", "left").select("_k", *fs, "_cell", F.coalesce("d", F.lit(float("inf"))).alias("_d"))

        def onward(batches):
            for batch in batches:
                for a in range(0, len(batch), 1024):
                    part = batch.iloc[a : a + 1024]
                    x = part[fs].to_numpy(float)
                    # distances are computed with cancellation; the margin covers it
                    margin = 1e-6 * (1 + np.sqrt(np.nansum(x * x, axis=1)))
                    near = least_distances(x, low, high) <= (part["_d"].to_numpy() + margin)[:, None]
                    near &= part["_cell"].to_numpy()[:, None] != numbers[None, :]
                    r, c = np.nonzero(near)
                    yield pd.DataFrame({"_k": part["_k"].to_numpy()[r]} | {f: x[r, i] for i, f in enumerate(fs)} | {"_cell": numbers[c].astype(np.int32)})

        more = limited.mapInPandas(onward, f"{plain}, _cell int")
        found = found.unionByName(found_in(more, deal(more)))
    out = best(found).withColumnsRenamed({"_k": "ask"} | dict(zip(names, carry, strict=True))).select("ask", "near", "distance", *carry, "place")
    if first is not None:
        weakref.finalize(out, first.unpersist)  # a frame made of it computes it anew if it has to
    return out
