"""Associations, drift, similarity, quality and fairness metrics, constraints and patterns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from .quantiles import midpoint, quantiles


def missing_share(df: DataFrame) -> DataFrame:
    """One row: share of missing cells of each column; empty text counts as missing."""
    gone = lambda f: F.col(f.name).isNull() | (F.col(f.name) == "") if isinstance(f.dataType, StringType) else F.col(f.name).isNull()
    return df.agg(*(F.round(F.avg(gone(f).cast("double")), 6).alias(f.name) for f in df.schema.fields))


def pearson(df: DataFrame, a: str, b: str) -> float | None:
    return df.agg(F.corr(a, b)).first()[0]


def chi2(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """One row (chi2, dof) of the contingency table; two by two with a continuity correction."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ra, rb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    # the full grid of the two margins; both are sets of class values, and one row of totals
    grid = ra.crossJoin(F.broadcast(rb)).join(cells, ["a", "b"], "left").crossJoin(F.broadcast(total))
    expected = F.col("na") * F.col("nb") / F.col("t")
    gap = F.abs(F.coalesce("n", F.lit(0)) - expected)
    if yates:
        gap = F.when((F.col("ka") == 2) & (F.col("kb") == 2), F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))).otherwise(gap)
    return grid.agg(F.round(F.sum(gap * gap / expected), 6).alias("chi2"), F.first((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof"))


def two_sample_f(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row f: one-way F of two columns as two samples."""
    m = df.agg(F.count(a).alias("na"), F.count(b).alias("nb"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    mean = (F.col("na") * F.col("ma") + F.col("nb") * F.col("mb")) / (F.col("na") + F.col("nb"))
    between = F.col("na") * F.pow(F.col("ma") - mean, 2) + F.col("nb") * F.pow(F.col("mb") - mean, 2)
    within = (F.col("na") * F.col("va") + F.col("nb") * F.col("vb")) / (F.col("na") + F.col("nb") - 2)
    return m.select(F.round(F.try_divide(between, within), 6).alias("f"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row (f, eta2) of a value by group, from group moments."""
    g = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w"))
    between = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    return t.select(F.round(F.try_divide(between / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))), 6).alias("f"), F.round(F.try_divide(between, between + F.col("w")), 6).alias("eta2"))


def entropy(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """One row of bits; numbers may be put in equal bins first."""
    value = F.col(column)
    if bins:
        lo, hi = df.agg(F.min(column), F.max(column)).first()
        value = bin_of(value, float(lo), float(hi), bins)
    n = df.where(F.col(column).isNotNull()).groupBy(value.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.round(F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n"), 6).alias("entropy"))


def bin_of(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Place of the value among equal bins; the last is closed."""
    if hi <= lo:
        return F.when(x.isNotNull(), F.lit(0))
    return F.least(F.floor((x - lo) / ((hi - lo) / bins)).cast("int"), F.lit(bins - 1))


def kl_drift(p: DataFrame, q: DataFrame, column: str, bins: int = 10, eps: float = 1e-10) -> DataFrame:
    """One row kl: divergence of p from q; numbers over p's bin edges (outside values of q are left out), other values as classes."""
    numeric = isinstance(p.schema[column].dataType, NumericType)
    key = F.col(column)
    if numeric:
        lo, hi = (float(x) for x in p.agg(F.min(column), F.max(column)).first())
        q = q.where(F.col(column).between(lo, hi))
        key = bin_of(F.col(column), lo, hi, bins)
    a = p.where(F.col(column).isNotNull()).groupBy(key.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    c = q.where(F.col(column).isNotNull()).groupBy(key.alias("b")).agg(F.count(F.lit(1)).alias("m"))
    base = p.sparkSession.range(bins).select(F.col("id").cast("int").alias("b")) if numeric else a.select("b").union(c.select("b")).distinct()
    rows = base.join(a, "b", "left").join(c, "b", "left").select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"))
    total = rows.agg(F.sum("n").alias("tn"), F.sum("m").alias("tm"))
    pp, qq = F.col("n") / F.col("tn") + eps, F.col("m") / F.col("tm") + eps
    return rows.crossJoin(F.broadcast(total)).agg(F.round(F.sum(pp * F.log(pp / qq)), 6).alias("kl"))  # one row of totals


def kl_tables(p: DataFrame, q: DataFrame, columns: list[str], bins: int = 50, eps: float = 1e-10) -> float:
    """The divergences of all columns of two tables added: how far the data of one has drifted from the other's."""
    return round(sum(kl_drift(p, q, c, bins, eps).first()["kl"] or 0.0 for c in columns), 6)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column, kind: str = "cosine") -> Column:
    """cosine, pearson; euclidean and manhattan as 1 / (1 + distance)."""
    if kind == "cosine":
        return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    if kind == "pearson":
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
        n, sa, sb = F.size(a), total(a), total(b)
        return F.try_divide(dot(a, b) - sa * sb / n, F.sqrt(dot(a, a) - sa * sa / n) * F.sqrt(dot(b, b) - sb * sb / n))
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    if kind == "euclidean":
        return 1 / (1 + F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)))
    return 1 / (1 + F.aggregate(gap, F.lit(0.0), lambda s, x: s + F.abs(x)))


def _mean(x: Column, weight: str | None) -> Column:
    return F.avg(x) if weight is None else F.try_divide(F.sum(x.cast("double") * F.col(weight)), F.sum(F.when(x.isNotNull(), F.col(weight))).cast("double"))


def _count(hit: Column, weight: str | None) -> Column:
    return F.count_if(hit) if weight is None else F.coalesce(F.sum(F.when(hit, F.col(weight))), F.lit(0))


def _share(hit: Column, among: Column, weight: str | None) -> Column:
    return F.try_divide(_count(hit & among, weight).cast("double"), _count(among, weight).cast("double"))


METRICS = ("sp", "accuracy_score", "f-1", "mae", "rmse", "rmse_sqrt", "equalized_odds")


def metric(name: str, label: str, predicted: str, sensitive: str | None = None, weight: str | None = None) -> Column:
    """An aggregate that is lower for better models; sp is signed, rmse_sqrt is the square root of the error's root. A row counts as often as its weight says."""
    y, p = F.col(label), F.col(predicted)
    if name == "sp":
        return _mean(F.when(F.col(sensitive) == 1, p), weight) - _mean(F.when(F.col(sensitive) == 0, p), weight)
    if name == "accuracy_score":
        return 1 - _mean((y == p).cast("double"), weight)
    if name == "f-1":
        tp = _count((y == 1) & (p == 1), weight)
        return 1 - F.coalesce(F.try_divide(2.0 * tp, (2 * tp + _count((y == 1) & (p != 1), weight) + _count((y != 1) & (p == 1), weight)).cast("double")), F.lit(0.0))
    if name == "mae":
        return _mean(F.abs(y - p), weight)
    if name in ("rmse", "rmse_sqrt"):
        return F.pow(_mean((y - p) * (y - p), weight), F.lit(0.5 if name == "rmse" else 0.25))
    if name == "equalized_odds":
        s = F.col(sensitive)
        tpr = F.abs(_share(p == 1, (y == 1) & (s == 1), weight) - _share(p == 1, (y == 1) & (s == 0), weight))
        tnr = F.abs(_share(p == 0, (y == 0) & (s == 1), weight) - _share(p == 0, (y == 0) & (s == 0), weight))
        return F.greatest(tpr, tnr)
    raise ValueError(f"unknown metric {name}")


def utility(df: DataFrame, name: str, label: str, predicted: str, sensitive: str | None = None, weight: str | None = None) -> float:
    return df.agg(metric(name, label, predicted, sensitive, weight)).first()[0]


def model_profile(df: DataFrame, label: str, sensitive: str | None, classification: bool = True) -> dict:
    """Label difference and ratio between the groups, covariance with the sensitive attribute, class imbalance; or the label's median."""
    if not classification:
        return {"median": quantiles(df, [label], [0.5])[label][0]}
    y, s = F.col(label), F.col(sensitive)
    row = df.agg(F.avg(F.when(s == 1, y)).alias("a"), F.avg(F.when(s == 0, y)).alias("b"), F.avg((s == 1).cast("double")).alias("r"), F.covar_samp(label, sensitive).alias("c"), F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n")).first()
    low, high = sorted((row["p"], row["n"]))
    return {"diff_sensitive_attr": (row["a"] or 0) - (row["b"] or 0), "ratio_sensitive_attr": row["r"], "cov": row["c"], "class_imbalance_ratio": low / high if high else None}


def two_sigma_share(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: share of each column's values beyond two sample deviations of the mean."""
    stats = df.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    out = [F.round(F.avg((F.abs(F.col(c) - F.col(f"m_{c}")) > 2 * F.col(f"s_{c}")).cast("double")), 6).alias(c) for c in columns]
    return df.crossJoin(F.broadcast(stats)).agg(*out)  # one row of statistics


def quartile_report(df: DataFrame, column: str) -> list[float | None]:
    return midpoint(df, column, [0.25, 0.5, 0.75, 1.0])


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, missing, distinct, mean, std, skew, kurtosis): all columns from one aggregation."""
    got = df.agg(*(F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.count_distinct(c).alias("n_distinct"), F.round(F.avg(c), 5).alias("mean"), F.round(F.stddev_pop(c), 5).alias("std"), F.round(F.skewness(c), 4).alias("skew"), F.round(F.kurtosis(c), 4).alias("kurtosis")).alias(f"s{i}") for i, c in enumerate(columns)))
    return got.select(F.explode(F.array(*(F.col(f"s{i}") for i in range(len(columns))))).alias("s")).select("s.*")


@dataclass(frozen=True)
class Constraint:
    """Bounds of a column; None is not checked."""

    column: str
    type: str | None = None
    min: float | None = None
    max: float | None = None
    sign: str | None = None
    max_nulls: int | None = None
    no_duplicates: bool = False
    min_length: int | None = None
    max_length: int | None = None
    allowed_values: tuple[str, ...] | None = None

    def checks(self) -> dict[str, Column]:
        """Aggregates that are true where the constraint holds."""
        c, out = F.col(self.column), {}
        if self.min is not None:
            out["min"] = F.coalesce(F.min(c) >= self.min, F.lit(True))
        if self.max is not None:
            out["max"] = F.coalesce(F.max(c) <= self.max, F.lit(True))
        if self.sign:
            ok = {"positive": F.min(c) > 0, "non-negative": F.min(c) >= 0, "negative": F.max(c) < 0, "non-positive": F.max(c) <= 0}[self.sign]
            out["sign"] = F.coalesce(ok, F.lit(True))
        if self.max_nulls is not None:
            out["max_nulls"] = F.count_if(c.isNull()) <= self.max_nulls
        if self.no_duplicates:
            out["no_duplicates"] = F.count(c) == F.count_distinct(c)
        if self.min_length is not None:
            out["min_length"] = F.coalesce(F.min(F.length(c)) >= self.min_length, F.lit(True))
        if self.max_length is not None:
            out["max_length"] = F.coalesce(F.max(F.length(c)) <= self.max_length, F.lit(True))
        if self.allowed_values is not None:
            out["allowed_values"] = F.count_if(c.isNotNull() & ~c.isin(*self.allowed_values)) == 0
        return out


def discover(df: DataFrame, columns: list[str], most_values: int = 20) -> list[Constraint]:
    """The tightest constraints that hold, from one aggregation; value sets only of text columns with few values."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    aggs, texts = [], [c for c in columns if isinstance(fields[c], StringType)]
    for c in columns:
        low, high = (F.min(F.length(c)), F.max(F.length(c))) if c in texts else (F.min(c).cast("double"), F.max(c).cast("double")) if isinstance(fields[c], NumericType) else (F.lit(None), F.lit(None))
        aggs += [F.count_if(F.col(c).isNull()), F.count(c), F.count_distinct(c), low, high]
    row, out = df.agg(*aggs).first(), []
    for i, c in enumerate(columns):
        nulls, n, distinct, low, high = row[5 * i : 5 * i + 5]
        text, number = c in texts, isinstance(fields[c], NumericType)
        values = tuple(sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())) if text and distinct <= most_values else None
        sign = None if not number or low is None else "positive" if low > 0 else "non-negative" if low >= 0 else "negative" if high < 0 else "non-positive" if high <= 0 else None
        out.append(Constraint(c, fields[c].simpleString(), low if number else None, high if number else None, sign, nulls, n == distinct, low if text else None, high if text else None, values))
    return out


def check(df: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """(name, kind, ok) for every part of every constraint, from one aggregation."""
    parts = [(c.column, k, x) for c in constraints for k, x in c.checks().items()]
    got = df.agg(*(x.alias(f"c{i}") for i, (_, _, x) in enumerate(parts)))
    return got.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.col(f"c{i}").alias("ok")) for i, (n, k, _) in enumerate(parts)))).alias("x")).select("x.*")


def violations(df: DataFrame, column: str, patterns: list[str]) -> DataFrame:
    """Rows whose value matches none of the alternative patterns (whole value)."""
    ok = F.lit(False)
    for p in patterns:
        ok = ok | F.col(column).rlike(f"^(?:{p})$")
    return df.where(F.col(column).isNotNull() & ~ok)


def fuse_scores(df: DataFrame, score: str, cost: str, kind: str = "geometric", a: float = 0.5) -> DataFrame:
    """Adds fused: the weighted mean of the scaled score and one minus the scaled cost."""
    lim = df.agg(F.min(score).alias("_a"), F.max(score).alias("_b"), F.min(cost).alias("_c"), F.max(cost).alias("_d"))
    s = F.coalesce(F.try_divide(F.col(score) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(1.0))
    u = 1 - F.coalesce(F.try_divide(F.col(cost) - F.col("_c"), F.col("_d") - F.col("_c")), F.lit(0.0))
    if kind == "arithmetic":
        fused = a * s + (1 - a) * u
    elif kind == "harmonic":
        fused = F.coalesce(F.try_divide(F.lit(1.0), a / F.nullif(s, F.lit(0.0)) + (1 - a) / F.nullif(u, F.lit(0.0))), F.lit(0.0))
    else:
        fused = F.pow(s, F.lit(a)) * F.pow(u, F.lit(1 - a))
    return df.crossJoin(F.broadcast(lim)).withColumn("fused", F.round(fused, 6)).drop("_a", "_b", "_c", "_d")  # one row of limits


def f_tail(f: float, d1: int, d2: int, steps: int = 4000) -> float:
    """P(F > f) by Simpson's rule on the beta integral."""
    x = d2 / (d2 + d1 * f)
    a, b = d2 / 2, d1 / 2
    g = lambda t: math.exp((a - 1) * math.log(t) + (b - 1) * math.log1p(-t)) if 0 < t < 1 else 0.0
    h = x / steps
    area = sum(g(i * h) * (1 if i in (0, steps) else 4 if i % 2 else 2) for i in range(steps + 1)) * h / 3
    return area / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))
