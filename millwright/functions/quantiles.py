"""Exact quantiles at any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many rows one aggregation holds the values; beyond, ranges are narrowed in passes.
ONE_PASS = 2_000_000
BINS = 2048


def nth_values(df: DataFrame, column: str, places: list[int], few: int = 100_000) -> list[float]:
    """The values at the given places (from 0) of the sorted non-null column, by histograms over ever narrower ranges."""
    values = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    lo, hi = values.agg(F.min("v"), F.max("v")).first()
    open_ = [(p, p, lo, hi) for p in sorted(set(places))]
    done: dict[int, float] = {}
    while open_:
        # places that still share a range are narrowed by the same pass
        a, b = open_[0][2:]
        same = [x for x in open_ if x[2:] == (a, b)]
        open_ = [x for x in open_ if x[2:] != (a, b)]
        inside = values.where(F.col("v").between(a, b))
        if a == b:
            done |= {p: a for p, *_ in same}
            continue
        step = (b - a) / BINS
        rows = inside.groupBy(F.least(F.floor((F.col("v") - a) / step), F.lit(BINS - 1)).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("k").collect()
        for p, rest, *_ in same:
            for r in rows:
                if rest < r["n"]:
                    if r["n"] <= few:
                        got = sorted(x[0] for x in inside.where(F.col("v").between(r["lo"], r["hi"])).collect())
                        done[p] = got[rest]
                    else:
                        open_.append((p, rest, r["lo"], r["hi"]))
                    break
                rest -= r["n"]
    return [done[p] for p in places]


def quantiles(df: DataFrame, columns: list[str], probs: list[float], one_pass: int = ONE_PASS) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column; an empty column has None."""
    if not columns:
        return {}
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    small = [c for c in columns if counts[c] <= one_pass]
    out: dict[str, list[float | None]] = {}
    if small:
        row = df.agg(*(F.percentile(F.col(c).cast("double"), F.array(*(F.lit(float(p)) for p in probs))).alias(c) for c in small)).first()
        out |= {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in small}
    for c in columns:
        if c not in out:
            at = [p * (counts[c] - 1) for p in probs]
            places = sorted({int(f(x)) for x in at for f in (math.floor, math.ceil)})
            value = dict(zip(places, nth_values(df, c, places), strict=True))
            out[c] = [value[math.floor(x)] + (x - math.floor(x)) * (value[math.ceil(x)] - value[math.floor(x)]) for x in at]
    return {c: out[c] for c in columns}


def midpoint(df: DataFrame, column: str, probs: list[float]) -> list[float | None]:
    """Quantiles halfway between the two neighbouring values."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(probs)
    at = [p * (n - 1) for p in probs]
    places = sorted({int(f(x)) for x in at for f in (math.floor, math.ceil)})
    value = dict(zip(places, nth_values(df, column, places), strict=True))
    return [(value[math.floor(x)] + value[math.ceil(x)]) / 2 for x in at]
