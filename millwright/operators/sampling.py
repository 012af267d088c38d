"""Samples, splits and class balancing. Random choices follow md5(row id, seed), so any engine can repeat them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..data import Roles, numeric_columns
from ..functions.knn import nearest_rows
from .base import Fitted, step


def lot(row_id: str, seed: int = 42) -> Column:
    """A uniform text key of each row."""
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"#{seed}")))


def first_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of an order; a distributed top-n, not a full sort in one task."""
    return df.orderBy(*order).limit(n)


def of_smallest_lot(df: DataFrame, group: str, wanted: Column, key: str, seed: int, name: str) -> DataFrame:
    """Adds `name`: whether the row is among the first `wanted` of its group by lot; wanted is an expression over _n, the group's size.

    A group is dealt to 4096 ranges of lots by their first digits. The counts
    of the ranges say which one the cut falls into, and rows are numbered
    within a range only, so no task holds a whole class.
    """
    rows = df.withColumn("_l", lot(key, seed)).withColumn("_h", F.substring("_l", 1, 3))
    counts = rows.groupBy(F.col(group).alias("_g"), "_h").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_g").orderBy("_h"))
    counts = counts.withColumns({"_u": upto, "_n": F.sum("_c").over(Window.partitionBy("_g"))})
    counts = counts.withColumn("_want", F.least(wanted, F.col("_n")))
    cut = counts.where((F.col("_u") >= F.col("_want")) & (F.col("_u") - F.col("_c") < F.col("_want"))).select("_g", F.col("_h").alias("_cut"), (F.col("_want") - F.col("_u") + F.col("_c")).alias("_more"))
    place = F.row_number().over(Window.partitionBy(group, "_h").orderBy("_l", key))
    marked = rows.withColumn("_p", place).join(cut, F.col(group).eqNullSafe(F.col("_g")), "left")
    inside = (F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut")) & (F.col("_p") <= F.col("_more")))
    return marked.withColumn(name, F.coalesce(inside, F.lit(False))).select(*df.columns, name)


@step("sampling", "full")
def full(df: DataFrame, roles: Roles = Roles()) -> Fitted:
    return Fitted(lambda d: d)


@step("sampling", "random", "snapshot")
def sample(df: DataFrame, roles: Roles, strategy: str = "random", fraction: float = 0.3, n: int | None = None, seed: int = 42) -> Fitted:
    """Exactly ceil(fraction * rows) rows (or n): of smallest lot, or of smallest row id."""
    order = lot(roles.row_id, seed) if strategy == "random" else F.col(roles.row_id)
    return Fitted(lambda d: first_n(d, n if n is not None else math.ceil(fraction * d.count()), order, F.col(roles.row_id)))


@step("sampling", "stratified")
def stratified(df: DataFrame, roles: Roles, by: str | None = None, cap: int = 1000, seed: int = 42) -> Fitted:
    """As many rows of each group: the cap, or the smallest group's size."""

    def apply(d: DataFrame) -> DataFrame:
        group = by or roles.target
        sizes = [r["n"] for r in d.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()]
        return of_smallest_lot(d, group, F.lit(min([cap, *sizes])), roles.row_id, seed, "_in").where("_in").drop("_in")

    return Fitted(apply)


def split(df: DataFrame, roles: Roles, test: float = 0.2, by: str | None = None, seed: int = 42) -> DataFrame:
    """Adds `part`: the round(test * n) rows of smallest lot are 'test', in each group if one is named."""
    if by is None:  # the cut is one value, found without gathering the rows in one window
        total = df.count()
        wanted = math.floor(test * total + 0.5)
        cut = df.select(lot(roles.row_id, seed).alias("l"), F.col(roles.row_id).alias("k")).orderBy("l", "k").limit(wanted).agg(F.max(F.struct("l", "k")).alias("m")).first()["m"]
        if cut is None:
            return df.withColumn("part", F.lit("train"))
        return df.withColumn("part", F.when(F.struct(lot(roles.row_id, seed).alias("l"), F.col(roles.row_id).alias("k")) <= F.struct(F.lit(cut["l"]).alias("l"), F.lit(cut["k"]).alias("k")), "test").otherwise("train"))
    return of_smallest_lot(df, by, F.floor(F.col("_n") * test + 0.5), roles.row_id, seed, "_in").withColumn("part", F.when(F.col("_in"), "test").otherwise("train")).drop("_in")


@step("oversampling", "smote")
def smote(df: DataFrame, roles: Roles, k: int = 5, seed: int = 42) -> Fitted:
    """Grows every smaller class to the largest: a row plus a share of the way to one of its k neighbours in the class."""

    def apply(d: DataFrame) -> DataFrame:
        features, key, target = numeric_columns(d, roles), roles.row_id, roles.target
        sizes = {r[target]: r["n"] for r in d.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}
        out, top = d.withColumn("synthetic", F.lit(False)), max(sizes.values(), default=0)
        for value, n in sorted(sizes.items(), key=str):
            lack = top - n
            if not lack or n < 2:
                continue
            own = d.where(F.col(target) == value)
            near = nearest_rows(own, own, key, features, min(k, n - 1), features).withColumnsRenamed({c: f"_n_{c}" for c in features})
            # each row gets its share of the lacking rows, each towards a neighbour drawn by hash
            more = of_smallest_lot(own, target, F.lit(lack % n), key, seed, "_in").withColumn("_t", F.lit(lack // n) + F.col("_in").cast("int")).drop("_in").where("_t > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_t"))))
            more = more.withColumn("place", (F.pmod(F.xxhash64(key, "_i", F.lit(seed)), F.lit(min(k, n - 1))) + 1).cast("int")).withColumn("ask", F.col(key).cast("long"))
            u = F.pmod(F.xxhash64(key, "_i", F.lit(seed + 1)), F.lit(1 << 20)) / float(1 << 20)
            made = more.join(near.select("ask", "place", *(f"_n_{c}" for c in features)), ["ask", "place"]).withColumn("_u", u)
            cols = [(F.col(c) + F.col("_u") * (F.col(f"_n_{c}") - F.col(c))).cast(d.schema[c].dataType).alias(c) if c in features else F.col(c) for c in d.columns]
            out = out.unionByName(made.select(*cols, F.lit(True).alias("synthetic")))
        return out

    return Fitted(apply)


@step("undersampling", "allknn")
def all_knn(df: DataFrame, roles: Roles, k: int = 3, kind: str = "all", allow_minority: bool = False) -> Fitted:
    """For 1 .. k neighbours in turn, drops rows of the larger classes whose neighbours disagree: any of them (all) or most (mode)."""

    def apply(d: DataFrame) -> DataFrame:
        features, key, target = numeric_columns(d, roles), roles.row_id, roles.target
        sizes = {r[target]: r["n"] for r in d.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}
        minority = min(sizes, key=lambda c: (sizes[c], str(c))) if sizes else None
        for n in range(1, k + 1):
            near = nearest_rows(d if allow_minority else d.where(F.col(target) != minority), d, key, features, n)
            label = d.select(F.col(key).cast("long").alias("near"), F.col(target).alias("_near"))
            own = d.select(F.col(key).cast("long").alias("ask"), F.col(target).alias("_own"))
            votes = near.join(label, "near").join(own, "ask").groupBy("ask").agg(F.count_if(F.col("_near") == F.col("_own")).alias("same"), F.count(F.lit(1)).alias("n"))
            bad = votes.where(F.col("same") < F.col("n") if kind == "all" else 2 * F.col("same") < F.col("n")).select(F.col("ask").alias(key))
            d = d.join(bad, key, "left_anti")
        return d

    return Fitted(apply)


@step("resampling", "minority_ratio")
def to_ratio(df: DataFrame, roles: Roles, ratio: float = 1.0, seed: int = 42) -> Fitted:
    """Every larger class cut to ratio times the smallest, by lot."""

    def apply(d: DataFrame) -> DataFrame:
        sizes = [r["n"] for r in d.groupBy(roles.target).agg(F.count(F.lit(1)).alias("n")).collect()]
        return of_smallest_lot(d, roles.target, F.lit(math.ceil(ratio * min(sizes, default=0))), roles.row_id, seed, "_in").where("_in").drop("_in")

    return Fitted(apply)
