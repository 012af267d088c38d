"""Earlier runs as one wide table: strategy columns, profile columns, utility."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.profile import dot, similarity
from ..operators.models import elastic_net, least_squares


def strategy_space(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """Every strategy vector as rows: place numbers taken from one range by mixed radix, so no tables are crossed."""
    total = int(np.prod([n for n in counts.values()])) if counts else 0
    out, rest = [], F.col("id")
    for name, n in reversed(counts.items()):
        out.append((F.pmod(rest, F.lit(n)) + 1).cast("int").alias(name))
        rest = F.floor(rest / n)
    return spark.range(total).select(*reversed(out))


def sampled_vectors(counts: dict[str, int], n: int, seed: int = 42) -> list[tuple[int, ...]]:
    """n distinct random vectors (all, if there are fewer)."""
    total = int(np.prod(list(counts.values())))
    pick = np.random.default_rng(seed).choice(total, min(n, total), replace=False)
    out = []
    for k in sorted(pick.tolist()):
        v = []
        for size in reversed(counts.values()):
            k, r = divmod(k, size)
            v.append(r + 1)
        out.append(tuple(reversed(v)))
    return out


def orders(names: list[str], must_precede: tuple[tuple[str, str], ...] = ()) -> list[tuple[str, ...]]:
    return [p for p in itertools.permutations(names) if all(p.index(a) < p.index(b) for a, b in must_precede if a in p and b in p)]


def best_passing(history: DataFrame, utility: str, goal: float, tie: str) -> DataFrame:
    """The run of smallest utility among those whose magnitude is under the goal; the first on ties."""
    return history.where(F.abs(utility) < goal).orderBy(utility, tie).limit(1)


def failing(history: DataFrame, utility: str, goal: float) -> DataFrame:
    return history.where(F.abs(utility) >= goal)


def lookup(history: DataFrame, keys: dict[str, int], utility: str) -> DataFrame:
    """Utility of the runs with these strategies, rounded to five decimals."""
    out = history
    for c, v in keys.items():
        out = out.where(F.col(c) == v)
    return out.select(F.round(utility, 5).alias(utility))


def vector(columns: list[str]) -> Column:
    return F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns))


def _unit_totals(df: DataFrame, keys: list[str], profile: list[str], side: str) -> DataFrame:
    """For each key, the sums of the profiles at length 1 and their number; profiles of length 0 have no cosine."""
    v = vector(profile)
    units = df.select(*keys, *(F.try_divide(F.get(v, F.lit(i)), F.sqrt(dot(v, v))).alias(f"_{side}{i}") for i in range(len(profile))))
    return units.groupBy(*keys).agg(*(F.sum(f"_{side}{i}").alias(f"_{side}{i}") for i in range(len(profile))), F.count(f"_{side}0").cast("double").alias(f"_{side}"))


def profile_similarity(a: DataFrame, b: DataFrame, keys: list[str], profile: list[str]) -> DataFrame:
    """(keys, similarity): mean cosine of the profiles of runs with equal strategies.

    The mean over all pairs is the product of the sides' mean unit profiles, so no pair becomes a row.
    """
    both = _unit_totals(a, keys, profile, "x").join(_unit_totals(b, keys, profile, "y"), keys)
    total = sum((F.col(f"_x{i}") * F.col(f"_y{i}") for i in range(len(profile))), F.lit(0.0))
    return both.select(*keys, F.round(F.try_divide(total, F.col("_x") * F.col("_y")), 6).alias("similarity"))


def similarity_to(history: DataFrame, target: list[float], profile: list[str]) -> DataFrame:
    own = F.array(*(F.lit(float(x)) for x in target))
    return history.withColumn("similarity", F.round(F.coalesce(similarity(vector(profile), own), F.lit(0.0)), 6))


def rank_parameters(history: DataFrame, parameters: list[str], utility: str) -> list[tuple[str, float]]:
    """Parameters by magnitude of their least-squares coefficient."""
    _, coefficients = least_squares(history, parameters, utility)
    return sorted(coefficients.items(), key=lambda x: (-abs(x[1]), x[0]))


def predicted(history: DataFrame, features: list[str], utility: str):
    """A function from a feature row to the utility that an elastic net on the (small) history predicts."""
    rows = history.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features), F.col(utility).cast("double").alias("_u")).toPandas()
    x, y = rows[features].to_numpy(float), rows["_u"].to_numpy(float)
    m, s = x.mean(0), x.std(0)
    s[s == 0] = 1
    b, w = elastic_net((x - m) / s, y)
    return lambda row: float(b + ((np.asarray(row, float) - m) / s) @ w)


def minimal_pairs(runs: DataFrame, parameters: list[str], result: str = "result") -> DataFrame:
    """(param, value, kind): values seen in good runs only, in bad runs only, or in both."""
    ok = F.lower(F.col(result).cast("string")) == "true"
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("string").alias("value")) for p in parameters)))
    got = runs.select(pairs.alias("x"), ok.alias("ok")).groupBy("x.param", "x.value").agg(F.bool_and("ok").alias("all"), F.bool_or("ok").alias("any"))
    return got.select("param", "value", F.when(F.col("all"), "good").when(~F.col("any"), "bad").otherwise("mixed").alias("kind"))


def column_distances(bad: DataFrame, goods: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """(name, distance): for each column the largest of the rows' smallest differences to any good table."""
    joined = bad.select(key, *columns)
    for i, g in enumerate(goods):
        joined = joined.join(g.select(key, *(F.col(c).alias(f"_{i}_{c}") for c in columns)), key)
    gap = lambda c: F.least(*(F.abs(F.col(c) - F.col(f"_{i}_{c}")) for i in range(len(goods)))) if len(goods) > 1 else F.abs(F.col(c) - F.col(f"_0_{c}"))
    got = joined.agg(*(F.max(gap(c)).alias(c) for c in columns))
    return got.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.round(F.col(c).cast("double"), 6).alias("distance")) for c in columns))).alias("x")).select("x.*")


def report(history: DataFrame, group: str, value: str) -> DataFrame:
    """Midpoint quartiles of a value by group, from ranks."""
    own = Window.partitionBy(group)
    rows = history.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    rows = rows.withColumns({"r": F.row_number().over(own.orderBy("v")) - 1, "n": F.count(F.lit(1)).over(own)})
    pick = lambda p: (F.max(F.when(F.col("r") == F.floor(p * (F.col("n") - 1)), F.col("v"))) + F.max(F.when(F.col("r") == F.ceil(p * (F.col("n") - 1)), F.col("v")))) / 2
    return rows.groupBy(group).agg(pick(0.25).alias("q1"), pick(0.5).alias("median"), pick(0.75).alias("q3"), F.max("v").alias("top"))
