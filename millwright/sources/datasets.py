"""Loaders of known tables: a frame and the roles of its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..data import Roles, numeric_columns, text_columns
from ..operators.features import f_regression
from ..operators.missing import fill, modes
from ..functions.quantiles import quantiles
from .readers import drop_sparse, encode_union, read_any


def _with_id(df: DataFrame) -> DataFrame:
    """A row id that follows from the values, so that it does not depend on the partitioning; equal rows share it."""
    return df.withColumn("rid", F.xxhash64(*df.columns))


def mortgages(spark: SparkSession, train: str, test: str) -> tuple[DataFrame, DataFrame, Roles]:
    """Label action_taken, sensitive race."""
    roles = Roles(target="action_taken", sensitive="race", row_id="rid")
    return _with_id(read_any(spark, train)), _with_id(read_any(spark, test)), roles


def census(spark: SparkSession, train: str, test: str) -> tuple[DataFrame, DataFrame, Roles]:
    """Text columns coded over the values of both files; label income, sensitive Sex."""
    a, b = encode_union(read_any(spark, train), read_any(spark, test))
    return _with_id(a), _with_id(b), Roles(target="income", sensitive="Sex", row_id="rid")


def housing(spark: SparkSession, train: str, test: str, k: int = 15, target: str = "SalePrice") -> tuple[DataFrame, DataFrame, Roles]:
    """Sparse columns dropped, gaps filled by mode (text) and median (numbers) of the first file, text coded, the k best features by F."""
    a = drop_sparse(read_any(spark, train))
    b = read_any(spark, test)
    b = b.select(*(c for c in a.columns if c in b.columns))
    numbers = [c for c in numeric_columns(a) if c != target]
    filled = fill({c: q[0] for c, q in quantiles(a, numbers, [0.5]).items()} | modes(a, text_columns(a)))
    a, b = filled(a), fill({c: v for c, v in filled.statistics.items() if c in b.columns})(b)
    a, b = encode_union(a, b)
    score = f_regression(a, target, [c for c in numeric_columns(a) if c != target])
    best = sorted(score, key=lambda c: (-score[c], c))[:k]
    keep = lambda d: d.select(*(c for c in d.columns if c in best or c == target))
    return _with_id(keep(a)), _with_id(keep(b)), Roles(target=target, row_id="rid")
