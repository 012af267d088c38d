"""Scaling, distribution shape and rank transforms."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data import Roles, numeric_columns
from ..functions.quantiles import quantiles
from .base import Fitted, columnwise, step


def _moments(df: DataFrame, columns: list[str], *kinds: str) -> dict[str, list[float | None]]:
    """Several statistics of all columns from one aggregation."""
    of = {"mean": F.avg, "std": F.stddev_pop, "std_samp": F.stddev_samp, "min": F.min, "max": F.max, "max_abs": lambda c: F.max(F.abs(c)), "skew": F.skewness}
    if not columns:
        return {}
    row = df.agg(*(of[k](c) for c in columns for k in kinds)).first()
    return {c: [None if x is None else float(x) for x in row[i * len(kinds) : (i + 1) * len(kinds)]] for i, c in enumerate(columns)}


def _linear(stats: dict[str, tuple[float | None, float | None]]) -> Fitted:
    """(x - shift) / scale; scale 0 counts as 1."""
    return Fitted(columnwise({c: (F.col(c) - F.lit(a)) / F.lit(s or 1.0) for c, (a, s) in stats.items() if a is not None and s is not None}), stats)


@step("normalization", "ss", "rs", "ma", "mm", "none", "zs", "mm_const", "ma_signed", "log10")
def scale(df: DataFrame, roles: Roles = Roles(), strategy: str = "ss", columns: list[str] | None = None) -> Fitted:
    """ss standard (population), rs robust, ma by largest magnitude, mm to 0..1; zs sample deviation (constant columns stay), mm_const constant to 0, ma_signed by the maximum, log10 of positive values."""
    names = columns or numeric_columns(df, roles)
    if strategy == "none":
        return Fitted(lambda d: d)
    if strategy == "ss":
        return _linear({c: (m, s) for c, (m, s) in _moments(df, names, "mean", "std").items()})
    if strategy == "rs":
        return _linear({c: (q[1], None if q[1] is None else q[2] - q[0]) for c, q in quantiles(df, names, [0.25, 0.5, 0.75]).items()})
    if strategy == "ma":
        return _linear({c: (0.0, m) for c, (m,) in _moments(df, names, "max_abs").items()})
    if strategy == "mm":
        return _linear({c: (a, None if a is None else b - a) for c, (a, b) in _moments(df, names, "min", "max").items()})
    if strategy == "zs":
        return _linear({c: (m, s) for c, (m, s) in _moments(df, names, "mean", "std_samp").items() if s})
    if strategy == "mm_const":
        found = _moments(df, names, "min", "max")
        return Fitted(columnwise({c: F.when(F.col(c).isNotNull(), F.lit(0.0)) if a == b else (F.col(c) - F.lit(a)) / F.lit(b - a) for c, (a, b) in found.items() if a is not None}), found)
    if strategy == "ma_signed":
        found = _moments(df, names, "max")
        return Fitted(columnwise({c: F.col(c) / F.lit(m) for c, (m,) in found.items() if m}), found)
    return Fitted(columnwise({c: F.when(F.col(c) > 0, F.log10(c)).otherwise(F.col(c)) for c in names}))


def interpolated(x: Column, edges: list[float], values: list[float]) -> Column:
    """Piecewise linear through (edges, values), flat outside; equal edges take the mean of their values."""
    xs, ys = np.unique(edges), []
    e, v = np.array(edges), np.array(values)
    for a in xs:
        ys.append(float(v[e == a].mean()))
    low, high = F.lit(float(xs[0])), F.lit(float(xs[-1]))
    table = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(p).alias("p"), F.lit(q).alias("q")) for a, b, p, q in zip(xs[:-1], xs[1:], ys[:-1], ys[1:], strict=True)))
    if len(xs) == 1:
        return F.when(x.isNotNull(), F.lit(ys[0]))
    # width of the table is bounded by the number of quantiles; the slot is the count of edges passed
    slot = F.get(F.filter(table, lambda s: (x >= s["a"]) & (x <= s["b"])), F.lit(0))
    inner = slot["p"] + (x - slot["a"]) / (slot["b"] - slot["a"]) * (slot["q"] - slot["p"])
    return F.when(x <= low, F.lit(ys[0])).when(x >= high, F.lit(ys[-1])).otherwise(inner)


@step("normalization", "quantile10")
def quantile_scale(df: DataFrame, roles: Roles = Roles(), columns: list[str] | None = None, n: int = 10, normal: bool = False) -> Fitted:
    """Rank transform through n quantiles, to 0..1 or to the standard normal."""
    names = columns or numeric_columns(df, roles)
    probs = [i / (n - 1) for i in range(n)]
    found = quantiles(df, names, probs)
    clip = 1e-7
    to = [NormalDist().inv_cdf(min(max(p, clip), 1 - clip)) for p in probs] if normal else probs
    return Fitted(columnwise({c: interpolated(F.col(c), q, to) for c, q in found.items() if q[0] is not None}), found)


@step("nonlinear_transform", "quantile", "power", "none")
def nonlinear(df: DataFrame, roles: Roles = Roles(), strategy: str = "quantile", columns: list[str] | None = None) -> Fitted:
    """quantile: to the normal through up to 100 quantiles; power: Yeo-Johnson, standardised."""
    if strategy == "none":
        return Fitted(lambda d: d)
    if strategy == "quantile":
        return quantile_scale(df, roles, columns, n=100, normal=True)
    return reshape(df, roles, "yeojohnson", columns, standardise=True)


def shifted(x: Column, low: float | None) -> Column:
    """Moved so that the smallest value is positive; not moved if none is negative."""
    return x if low is None or low >= 0 else x + F.lit(-low + 1e-6)


def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def best_lambda(df: DataFrame, columns: dict[str, Column], transform, jacobian, low: float = -2.0, high: float = 2.0, passes: int = 3, grid: int = 9) -> dict[str, float]:
    """The exponent of largest likelihood of each column: a grid of all columns in one aggregation, refined in passes."""
    span = dict.fromkeys(columns, (low, high))
    for _ in range(passes):
        tries = {c: [a + (b - a) * i / (grid - 1) for i in range(grid)] for c, (a, b) in span.items()}
        wanted = []
        for c, x in columns.items():
            wanted += [F.var_pop(transform(x, lam)) for lam in tries[c]] + [F.sum(jacobian(x)), F.count(x)]
        row, k = df.agg(*wanted).first(), 0
        for c in columns:
            var, (jac, n) = row[k : k + grid], row[k + grid : k + grid + 2]
            k += grid + 2
            fit = [-math.inf if not v or v <= 0 else -n / 2 * math.log(v) + (lam - 1) * jac for v, lam in zip(var, tries[c], strict=True)]
            best = max(range(grid), key=fit.__getitem__)
            span[c] = (tries[c][max(0, best - 1)], tries[c][min(grid - 1, best + 1)])
    return {c: (a + b) / 2 for c, (a, b) in span.items()}


@step("distribution_shape", "none", "log1p", "sqrt", "boxcox", "yeojohnson")
def reshape(df: DataFrame, roles: Roles = Roles(), strategy: str = "log1p", columns: list[str] | None = None, standardise: bool = False, lambdas: dict[str, float] | None = None) -> Fitted:
    """Logarithm, square root or power transforms; missing values are an error, as a fit would silently skip them."""
    names = columns or numeric_columns(df, roles)
    if strategy == "none" or not names:
        return Fitted(lambda d: d)
    row = df.agg(*(F.min(c).alias(c) for c in names), *(F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"_m{i}") for i, c in enumerate(names))).first()
    if any(row[f"_m{i}"] for i in range(len(names))):
        raise ValueError("missing values must be filled before the shape is corrected")
    low = {c: None if row[c] is None else float(row[c]) for c in names}
    if strategy in ("log1p", "sqrt"):
        f = F.log1p if strategy == "log1p" else F.sqrt
        return Fitted(columnwise({c: f(shifted(F.col(c), low[c])) for c in names}), low)
    if strategy == "boxcox":
        columns_ = {c: F.col(c).cast("double") + F.lit(0.0 if low[c] > 0 else -low[c] + 1e-6) for c in names}
        lambdas = lambdas or best_lambda(df, columns_, box_cox, F.log)
        out = {c: box_cox(x, lambdas[c]) for c, x in columns_.items()}
    else:
        columns_ = {c: F.col(c).cast("double") for c in names}
        lambdas = lambdas or best_lambda(df, columns_, yeo_johnson, lambda x: F.signum(x) * F.log1p(F.abs(x)))
        out = {c: yeo_johnson(x, lambdas[c]) for c, x in columns_.items()}
    if standardise:
        stats = _moments(df.select(*(x.alias(c) for c, x in out.items())), list(out), "mean", "std")
        out = {c: (x - F.lit(stats[c][0])) / F.lit(stats[c][1] or 1.0) for c, x in out.items()}
    return Fitted(columnwise(out), lambdas)


@step("log_skew", "log1p")
def unskew(df: DataFrame, roles: Roles = Roles(), columns: list[str] | None = None, least: float = 0.75) -> Fitted:
    """log1p of the columns with a population skewness of at least `least`."""
    names = columns or numeric_columns(df, roles)
    found = _moments(df, names, "skew")
    return Fitted(columnwise({c: F.log1p(c) for c, (s,) in found.items() if s is not None and s >= least}), found)


@step("unit_converter", "linear")
def convert(df: DataFrame, roles: Roles = Roles(), column: str | None = None, multiplier: float = 1.0, offset: float = 0.0) -> Fitted:
    """column * multiplier + offset; without a numeric column nothing happens."""
    if column not in numeric_columns(df):
        return Fitted(lambda d: d)
    return Fitted(columnwise({column: F.col(column) * multiplier + offset}))
