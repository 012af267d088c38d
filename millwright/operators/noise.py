"""Controlled damage: the inverse of the cleaning operators. Rows are chosen by lot, so a choice can be repeated."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data import Roles, numeric_columns, text_columns
from ..functions.quantiles import quantiles
from .base import normal
from .missing import SENTINELS
from .sampling import lot


def chosen(df: DataFrame, row_id: str, fraction: float, seed: int) -> DataFrame:
    """Row ids of max(1, ceil(fraction * n)) rows, of smallest lot."""
    n = df.count()
    return df.select(row_id, lot(row_id, seed).alias("_l")).orderBy("_l", row_id).limit(max(1, math.ceil(fraction * n))).select(row_id)


def _marked(df: DataFrame, roles: Roles, fraction: float, seed: int) -> DataFrame:
    hit = chosen(df, roles.row_id, fraction, seed).withColumn("_hit", F.lit(True))
    return df.join(hit, roles.row_id, "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))


def _set(df: DataFrame, roles: Roles, fraction: float, seed: int, values: dict[str, Column]) -> DataFrame:
    marked = _marked(df, roles, fraction, seed)
    out = {c: F.when(F.col("_hit"), v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    return marked.withColumns(out).select(*df.columns)


def missing(df: DataFrame, roles: Roles, fraction: float = 0.1, column: str | None = None, seed: int = 42) -> DataFrame:
    return _set(df, roles, fraction, seed, {column or numeric_columns(df, roles)[0]: F.lit(None)})


def outliers(df: DataFrame, roles: Roles, fraction: float = 0.1, columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Chosen rows get Q1 - 5 quartile ranges."""
    names = columns or numeric_columns(df, roles)
    q = quantiles(df, names, [0.25, 0.75])
    return _set(df, roles, fraction, seed, {c: F.lit(a - 5 * (b - a)) for c, (a, b) in q.items() if a is not None})


def class_imbalance(df: DataFrame, roles: Roles, share: float = 0.2, columns: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Flips the 0/1 label of rows outside a fence, and of a share chosen by lot."""
    names = columns or numeric_columns(df, roles)
    q = quantiles(df, names, [0.25, 0.75])
    out = F.lit(False)
    for c, (a, b) in q.items():
        if a is not None:
            out = out | F.coalesce((F.col(c) < a - 1.5 * (b - a)) | (F.col(c) > b + 1.5 * (b - a)), F.lit(False))
    marked = _marked(df, roles, share, seed)
    flipped = (1 - F.col(roles.target)).cast(df.schema[roles.target].dataType)
    return marked.withColumn(roles.target, F.when(F.col("_hit") | out, flipped).otherwise(F.col(roles.target))).select(*df.columns)


def invalid(df: DataFrame, roles: Roles, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """Chosen rows get a sentinel number or placeholder text in the first half of the columns of either kind."""
    half = lambda names: names[: max(1, math.ceil(len(names) / 2))] if names else []
    values = {c: F.lit(SENTINELS[0]) for c in half(numeric_columns(df, roles))} | {c: F.lit("unknown") for c in half(text_columns(df, roles))}
    return _set(df, roles, fraction, seed, values)


def duplicate_rows(df: DataFrame, roles: Roles, fraction: float = 0.1, seed: int = 42) -> DataFrame:
    return df.unionAll(df.join(chosen(df, roles.row_id, fraction, seed), roles.row_id, "left_semi").select(*df.columns))


def floating_point(df: DataFrame, roles: Roles, scale: float = 1e-9, seed: int = 42) -> DataFrame:
    """Normal noise on numbers with a fractional part."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float") and f.name not in roles.kept_out()]
    return df.withColumns({c: F.when(F.col(c) != F.floor(c), F.col(c) + normal(roles.row_id, seed + i) * scale).otherwise(F.col(c)) for i, c in enumerate(names)})


def distribution_shape(df: DataFrame, roles: Roles, kind: str = "skew_right", columns: list[str] | None = None, strength: float = 2.0, column_share: float = 0.5, row_share: float = 1.0, seed: int = 42) -> DataFrame:
    """Warps standardised columns and brings mean and deviation back.

    skew_right exp(strength z), skew_left -exp(strength z), heavy_tail
    z exp(|z| / strength); exp, neg_exp and heavy are exp(z), -exp(-z), z**3.
    Without named columns a share of them is hit, chosen by lot of their names,
    and a share of the rows, whose own moments count.
    """
    numbers = numeric_columns(df, roles)
    by_lot = sorted(numbers, key=lambda c: hashlib.md5(f"{c}#{seed}".encode()).hexdigest())
    names = columns or by_lot[: max(1, math.ceil(column_share * len(numbers)))] if numbers or columns else []
    if not names:
        return df
    marked = df.withColumn("_hit", F.lit(True)) if row_share >= 1 else _marked(df, roles, row_share, seed)
    inside = marked.where("_hit")
    row = inside.agg(*(f(c) for c in names for f in (F.avg, F.stddev_pop))).first()
    moments = {c: (row[2 * i], row[2 * i + 1]) for i, c in enumerate(names) if row[2 * i + 1]}
    if not moments:
        return df
    warp = {
        "skew_right": lambda z: F.exp(strength * z), "skew_left": lambda z: -F.exp(strength * z), "heavy_tail": lambda z: z * F.exp(F.abs(z) / max(1e-6, strength)),
        "exp": lambda z: F.exp(z), "neg_exp": lambda z: -F.exp(-z), "heavy": lambda z: z * z * z,
    }[kind]
    bent = {c: warp((F.col(c) - m) / s) for c, (m, s) in moments.items()}
    got = inside.agg(*(f(x) for x in bent.values() for f in (F.avg, F.stddev_pop))).first()
    out = {c: (bent[c] - F.lit(got[2 * i])) / F.lit(got[2 * i + 1] or 1.0) * F.lit(moments[c][1]) + F.lit(moments[c][0]) for i, c in enumerate(moments)}
    return marked.withColumns({c: F.when(F.col("_hit"), x).otherwise(F.col(c).cast("double")) for c, x in out.items()}).select(*df.columns)


def multicollinearity(df: DataFrame, roles: Roles, source: str, target: str, scale: float = 1e-5, seed: int = 42) -> DataFrame:
    return df.withColumn(target, F.col(source) + normal(roles.row_id, seed) * scale)


INJECTORS = {"missing_value": missing, "outlier": outliers, "class_imbalance": class_imbalance, "invalid_value": invalid, "duplicate_rows": duplicate_rows, "floating_point": floating_point, "distribution_shape": distribution_shape, "multicollinearity": multicollinearity}


def inject(df: DataFrame, roles: Roles, kinds: list[str], **parameters: dict) -> DataFrame:
    """The kinds one after another, each with its own parameters."""
    for k in kinds:
        df = INJECTORS[k](df, roles, **parameters.get(k, {}))
    return df
