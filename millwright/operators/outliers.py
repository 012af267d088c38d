"""Outliers: quartile fences, robust scores, local outlier factor, isolation forest."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data import Roles, numeric_columns
from ..functions.knn import nearest_rows
from ..functions.quantiles import quantiles
from .base import Fitted, columnwise, every, identity, step


def fences(df: DataFrame, columns: list[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    found = quantiles(df, columns, [0.25, 0.75])
    return {c: (a - factor * (b - a), b + factor * (b - a)) for c, (a, b) in found.items() if a is not None}


def _unless_empty(keep: Column):
    """The filter, or the whole frame where it would leave nothing."""

    def apply(d: DataFrame) -> DataFrame:
        kept = d.where(keep)
        return d if kept.isEmpty() else kept

    return apply


def removed_share(before: DataFrame, after: DataFrame) -> float:
    n = before.count()
    return round((1 - after.count() / n) * 100, 4) if n else 0.0


@step("outlier", "iqr")
def iqr(df: DataFrame, roles: Roles = Roles(), columns: list[str] | None = None, guard: bool = True) -> Fitted:
    """Rows whose numbers all lie within the fences of 1.5 quartile ranges."""
    names = columns or numeric_columns(df, roles)
    bounds = fences(df, names)
    keep = every([F.col(c).between(a, b) for c, (a, b) in bounds.items()])
    return Fitted(_unless_empty(keep) if guard else lambda d: d.where(keep), bounds)


@step("outlier", "none")
def no_outliers(df: DataFrame, roles: Roles = Roles()) -> Fitted:
    return Fitted(identity)


@step("outlier", "iqr_share", "zsb")
def by_share(df: DataFrame, roles: Roles, strategy: str = "zsb", threshold: float = 0.3, columns: list[str] | None = None) -> Fitted:
    """Rows whose share of outlying cells is at most the threshold (-1: none at all). zsb: robust z over 1.6."""
    names = columns or numeric_columns(df, roles)
    if strategy == "iqr_share":
        odd = [(F.col(c) < a) | (F.col(c) > b) for c, (a, b) in fences(df, names).items()]
    else:
        middle = {c: q[0] for c, q in quantiles(df, names, [0.5]).items() if q[0] is not None}
        spread = quantiles(df.select(*(F.abs(F.col(c) - F.lit(m)).alias(c) for c, m in middle.items())), list(middle), [0.5])
        odd = [F.abs((F.col(c) - F.lit(m)) / F.lit(1.4296 * spread[c][0])) > 1.6 if spread[c][0] else F.lit(False) for c, m in middle.items()]
    share = reduce(lambda a, b: a + b, [F.coalesce(o, F.lit(False)).cast("int") for o in odd], F.lit(0)) / F.lit(max(1, len(names)))
    keep = share <= 0 if threshold == -1 else share <= threshold
    return Fitted(lambda d: d.where(keep))


@step("outlier_cells", "iqr")
def cells(df: DataFrame, roles: Roles = Roles(), factor: float = 1.5, columns: list[str] | None = None) -> Fitted:
    """Numbers outside the fences become NULL; rows stay."""
    return Fitted(columnwise({c: F.when(F.col(c).between(a, b), F.col(c)) for c, (a, b) in fences(df, columns or numeric_columns(df, roles), factor).items()}))


def lof_scores(df: DataFrame, key: str, features: list[str], k: int = 5) -> DataFrame:
    """(key, lof): local reachability of a row's neighbours against its own, from one k-nearest table."""
    near = nearest_rows(df, df, key, features, k).select("ask", "near", "distance")
    radius = near.groupBy(F.col("ask").alias("near")).agg(F.max("distance").alias("radius"))
    reach = near.join(radius, "near").select("ask", "near", F.greatest("distance", "radius").alias("reach"))
    density = reach.groupBy("ask").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))
    other = density.select(F.col("ask").alias("near"), F.col("lrd").alias("near_lrd"))
    return near.join(other, "near").join(density, "ask").groupBy(F.col("ask").alias(key)).agg((F.avg("near_lrd") / F.first("lrd")).alias("lof"))


@step("outlier", "lof")
def lof(df: DataFrame, roles: Roles, k: int = 5, contamination: float | None = None, columns: list[str] | None = None) -> Fitted:
    """Rows with a local outlier factor up to 1.5, or below the contamination's quantile."""
    names, key = columns or numeric_columns(df, roles), roles.row_id
    scores = lof_scores(df.dropna(subset=names), key, names, k)
    limit = 1.5 if contamination is None else quantiles(scores, ["lof"], [1 - contamination])["lof"][0]
    return Fitted(lambda d: d.join(scores.where(F.col("lof") <= limit).select(key), key, "left_semi"), {"limit": limit})


def _tree(x: np.ndarray, rng: np.random.Generator, depth: int):
    if depth == 0 or len(x) <= 1 or (x.max(0) == x.min(0)).all():
        return len(x)
    f = rng.choice(np.flatnonzero(x.max(0) > x.min(0)))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < cut
    return int(f), float(cut), _tree(x[left], rng, depth - 1), _tree(x[~left], rng, depth - 1)


def _expected(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depth(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), _expected(tree))
    f, cut, left, right = tree
    out, low = np.empty(len(x)), x[:, f] < cut
    out[low], out[~low] = 1 + _depth(left, x[low]), 1 + _depth(right, x[~low])
    return out


def isolation_scores(df: DataFrame, roles: Roles, columns: list[str], trees: int = 50, rows: int = 256, seed: int = 0) -> Column:
    """A scoring expression of an isolation forest, grown on the driver from a bounded sample (trees x rows)."""
    n = max(1, df.count())
    share = min(1.0, 1.2 * trees * rows / n)
    rank = F.pmod(F.xxhash64(*(F.col(c).cast("double") for c in columns), F.lit(seed)), F.lit(1 << 30))
    drawn = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna().withColumn("_r", rank)
    if share < 1:  # equal rows share a hash, so each distinct row counts once here
        drawn = drawn.distinct().where(F.col("_r") / float(1 << 30) < share)
    sample = drawn.orderBy("_r", *columns).limit(trees * rows).select(*columns).toPandas().to_numpy(float)
    rng = np.random.default_rng(seed)
    size = min(rows, len(sample))
    forest = [_tree(sample[rng.choice(len(sample), size, replace=False)], rng, math.ceil(math.log2(max(2, size)))) for _ in range(trees)] if size else []
    normal = _expected(size) or 1.0

    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(float) for s in series])
        return pd.Series(2.0 ** (-np.mean([_depth(t, x) for t in forest], axis=0) / normal) if forest else np.zeros(len(x)))

    return F.pandas_udf(score, "double")(*(F.col(c).cast("double") for c in columns))


@step("outlier", "if")
def isolation(df: DataFrame, roles: Roles = Roles(), contamination: float = 0.2, columns: list[str] | None = None, seed: int = 0) -> Fitted:
    """Rows below the contamination's quantile of the isolation score."""
    names = columns or numeric_columns(df, roles)
    score = isolation_scores(df, roles, names, seed=seed)
    limit = quantiles(df.dropna(subset=names).select(score.alias("s")), ["s"], [1 - contamination])["s"][0]
    return Fitted(lambda d: d.withColumn("_s", score).where(F.col("_s") <= F.lit(limit)).drop("_s"), {"limit": limit})
