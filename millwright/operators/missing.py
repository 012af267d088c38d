"""Missing and invalid values, floating-point noise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..data import Roles, numeric_columns, text_columns, without_nan
from ..functions.knn import nearest_rows
from ..functions.quantiles import quantiles
from .base import Fitted, columnwise, identity, literal, normal, step

#: Numbers that stand for "not recorded" (fixed values).
SENTINELS = (-999, -9999, 999, 9999, 99999)
#: Texts that stand for "not recorded", whatever their case (fixed values).
TOKENS = (r"\s*", "na", "n/a", "none", "null", "nan", "unknown", "missing", r"\?")


def means(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return df.agg(*(F.avg(c).alias(c) for c in columns)).first().asDict() if columns else {}


def modes(df: DataFrame, columns: list[str]) -> dict:
    """The most frequent non-null value of each column; ties go to the smallest. All columns of a type share one pass over (column, value) counts."""
    kinds: dict[str, list[str]] = {}
    for c in columns:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    out: dict = dict.fromkeys(columns)
    for names in kinds.values():
        cells = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(names))))
        counted = df.select(cells.alias("x")).select("x.c", "x.v").where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        top = counted.groupBy("c").agg(F.max("n").alias("n"))
        for r in counted.join(top, ["c", "n"]).groupBy("c").agg(F.min("v").alias("v")).collect():  # a row for each column
            out[names[r["c"]]] = r["v"]
    return out


def fill(values: dict) -> Fitted:
    kept = {c: v for c, v in values.items() if v is not None}
    return Fitted(columnwise({c: F.coalesce(c, F.lit(v)) for c, v in kept.items()}), values)


@step("missing_value", "drop")
def drop(df: DataFrame, roles: Roles = Roles()) -> Fitted:
    return Fitted(lambda d: without_nan(d).dropna("any"))


@step("missing_value", "mean", "median", "most_frequent", "none")
def impute(df: DataFrame, roles: Roles = Roles(), strategy: str = "mean", columns: list[str] | None = None) -> Fitted:
    """Fills by column; the mode also fills text. Numbers still missing after it get the mean."""
    if strategy == "none":
        return Fitted(identity)
    df = without_nan(df)
    numbers = columns or numeric_columns(df, roles)
    if strategy == "mean":
        values = means(df, numbers)
    elif strategy == "median":
        values = {c: q[0] for c, q in quantiles(df, numbers, [0.5]).items()}
    else:
        values = modes(df, columns or [*numbers, *text_columns(df, roles)])
    filled = fill(values)
    return Fitted(lambda d: filled(without_nan(d)), values)


@step("missing_value", "rand")
def impute_normal(df: DataFrame, roles: Roles = Roles(), columns: list[str] | None = None, seed: int = 42) -> Fitted:
    """Fills numbers with standard normal draws that follow from the row id (without one, from the partition)."""
    names = columns or numeric_columns(df, roles)
    draw = lambda k: normal(roles.row_id, seed + k) if roles.row_id else F.randn(seed + k)
    return Fitted(columnwise({c: F.coalesce(c, draw(k)) for k, c in enumerate(names)}))


@step("missing_value", "knn", "knn_weighted")
def impute_knn(df: DataFrame, roles: Roles, strategy: str = "knn", k: int = 5, columns: list[str] | None = None) -> Fitted:
    """Mean over the k nearest rows that have the feature (nan-euclidean); weighted: by inverse distance.

    Only rows with a gap ask; a donor list is made for each column. What no
    donor fills gets the column's mean.
    """
    names, key = columns or numeric_columns(df, roles), roles.row_id
    average = means(without_nan(df), names)

    def apply(d: DataFrame) -> DataFrame:
        d, donors = without_nan(d), without_nan(df)
        for c in names:
            gaps = d.where(F.col(c).isNull())
            near = nearest_rows(gaps.select(key, *names), donors.where(F.col(c).isNotNull()).select(key, *names), key, names, k, [c])
            if strategy == "knn":
                value = F.avg(c)
            else:
                weight = 1 / F.greatest(F.col("distance"), F.lit(1e-12))
                value = F.sum(F.col(c) * weight) / F.sum(weight)
            got = near.groupBy(F.col("ask").alias(key)).agg(value.alias("_got"))
            filled = d.join(got, key, "left").withColumn(f"_new_{c}", F.coalesce(c, "_got", literal(average[c]))).drop("_got")
            d = filled
        return d.withColumns({c: F.col(f"_new_{c}") for c in names}).drop(*(f"_new_{c}" for c in names))

    return Fitted(apply, average)


def _given(mean: np.ndarray, cov: np.ndarray, i: int) -> tuple[float, np.ndarray, float]:
    """Intercept, slopes and residual variance of column i given the others."""
    rest = [j for j in range(len(mean)) if j != i]
    beta = np.linalg.lstsq(cov[np.ix_(rest, rest)], cov[rest, i], rcond=None)[0] if rest else np.zeros(0)
    return float(mean[i] - beta @ mean[rest]), beta, float(max(0.0, cov[i, i] - beta @ cov[rest, i]))


@step("missing_value", "mice", "em", "iterative")
def impute_chained(df: DataFrame, roles: Roles = Roles(), strategy: str = "mice", columns: list[str] | None = None, rounds: int = 5) -> Fitted:
    """Linear regressions of each column on the others, which have their values of the round before where they miss one.

    A round is one aggregation of moments; em runs until the moments settle and
    adds the variance that a filled cell lacks to its column's. The rounds are
    expressions over expressions, so their number is bounded by `rounds`
    (em: four times as many) and a round starts from the last one's values.
    """
    df = without_nan(df)
    names = columns or numeric_columns(df, roles)
    average = means(df, names)
    steps: list[list[tuple[float, np.ndarray]]] = []

    def filled(d: DataFrame) -> DataFrame:
        """All columns as _v<i>, filled by the rounds so far."""
        d = d.withColumns({f"_v{i}": F.coalesce(F.col(c).cast("double"), literal(average[c])) for i, c in enumerate(names)})
        for fits in steps:
            new = {}
            for i, (base, beta) in enumerate(fits):
                rest = [j for j in range(len(names)) if j != i]
                value = F.lit(base) + sum((F.lit(float(b)) * F.col(f"_v{j}") for b, j in zip(beta, rest, strict=True)), F.lit(0.0))
                new[f"_v{i}"] = F.coalesce(F.col(names[i]).cast("double"), value)
            d = d.withColumns(new)
        return d

    last, lacking = None, np.zeros(len(names))
    for _ in range(rounds if strategy != "em" else 4 * rounds):
        full = filled(df)
        row = full.agg(*(F.avg(f"_v{i}") for i in range(len(names))), *(F.covar_pop(f"_v{i}", f"_v{j}") for i in range(len(names)) for j in range(len(names))), *(F.avg(F.col(c).isNull().cast("double")) for c in names)).first()
        n = len(names)
        mean, cov, gaps = np.array(row[:n], float), np.array(row[n : n + n * n], float).reshape(n, n), np.array(row[n + n * n :], float)
        if strategy == "em":
            cov = cov + np.diag(gaps * lacking)  # filled cells lie on the regression; their spread about it is put back
        fits = [_given(mean, cov, i) for i in range(n)]
        lacking = np.array([f[2] for f in fits])
        steps.append([(f[0], f[1]) for f in fits])
        if strategy == "em" and last is not None and np.allclose(mean, last, rtol=1e-9):
            break
        last = mean

    def apply(d: DataFrame) -> DataFrame:
        own = filled(without_nan(d))
        return own.select(*(F.coalesce(c, f"_v{names.index(c)}").alias(c) if c in names else F.col(c) for c in d.columns))

    return Fitted(apply)


def valid_number(column: str) -> Column:
    return F.when(~F.col(column).isin(*SENTINELS), F.col(column))


def valid_text(column: str) -> Column:
    core = F.trim(column)
    return F.when(~core.rlike("(?i)^(" + "|".join(TOKENS) + ")$"), F.col(column))


@step("invalid_value", "sentinel", "regex", "both", "none")
def invalid(df: DataFrame, roles: Roles = Roles(), strategy: str = "both") -> Fitted:
    """Sentinel numbers and placeholder texts become NULL."""
    numbers = numeric_columns(df, roles) if strategy in ("sentinel", "both") else []
    texts = text_columns(df, roles) if strategy in ("regex", "both") else []
    return Fitted(columnwise({c: valid_number(c) for c in numbers} | {c: valid_text(c) for c in texts}))


@step("floating_point", "snap", "round", "both", "none")
def stabilise(df: DataFrame, roles: Roles = Roles(), strategy: str = "both", tolerance: float = 1e-8, digits: int = 6) -> Fitted:
    """Snaps tiny numbers to 0 and rounds half to even."""
    out = {}
    for c in [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float") and f.name not in roles.kept_out()]:
        x = F.col(c)
        if strategy in ("snap", "both"):
            x = F.when(F.abs(x) < tolerance, F.lit(0.0)).otherwise(x)
        if strategy in ("round", "both"):
            x = F.bround(x, digits)
        out[c] = x
    return Fitted(columnwise({} if strategy == "none" else out))
