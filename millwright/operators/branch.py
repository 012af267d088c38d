"""Conditional execution: a step on the rows of a mask only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Mask = dict | str | Callable[[DataFrame], Column]


def mask(df: DataFrame, condition: Mask) -> Column:
    """A dictionary (column: value or list), an SQL expression, or a function of the frame; null is false."""
    if callable(condition):
        out = condition(df)
    elif isinstance(condition, str):
        out = F.expr(condition)
    else:
        out = F.lit(True)
        for c, v in condition.items():
            out = out & (F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v))
    return F.coalesce(out, F.lit(False))


def branch(df: DataFrame, condition: Mask, step: Callable[[DataFrame], DataFrame], keeps_rows: bool = True, row_id: str | None = None) -> DataFrame:
    """Runs step where the mask holds and writes its columns back; a step that changes rows is put beside the rest."""
    hit = mask(df, condition)
    if keeps_rows and row_id is None:
        marked = step(df.withColumns({f"_old_{c}": F.col(c) for c in df.columns}).withColumn("_hit", hit))
        return marked.select(*(F.when(F.col("_hit"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in df.columns))
    return step(df.where(hit)).unionByName(df.where(~hit), allowMissingColumns=True)


def align(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """Exactly these columns in this order; absent ones are filled."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns))
