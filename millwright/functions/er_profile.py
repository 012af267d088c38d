"""Profiles of record tables and candidate pairs, and the profile of a cleaning step."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..data import Roles, numeric_columns, text_columns
from .profile import model_profile
from .quantiles import midpoint

QUARTERS = [0.25, 0.5, 0.75]


def dataset_size(tables: list[DataFrame]) -> int:
    return sum(t.count() for t in tables)


def record_lengths(tables: list[DataFrame], columns: list[str]) -> list[float | None]:
    """Midpoint quartiles of the number of whitespace tokens of a record."""
    text = F.concat_ws(" ", *columns)
    n = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    rows = tables[0].select(n.alias("n"))
    for t in tables[1:]:
        rows = rows.unionAll(t.select(n.alias("n")))
    return midpoint(rows, "n", QUARTERS)


def stop_word_share(df: DataFrame, key: str, columns: list[str], share: float = 0.1) -> list[float | None]:
    """Midpoint quartiles of a record's share of stop words: the int(share * distinct) most frequent tokens of the table, ties by token."""
    tokens = df.select(F.col(key).alias("k"), F.explode(F.filter(F.split(F.lower(F.concat_ws(" ", *columns)), r"\s+"), lambda w: w != "")).alias("t"))
    freq = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    stop = freq.orderBy(F.desc("n"), "t").limit(int(share * freq.count())).select("t", F.lit(1).alias("s"))
    per = tokens.join(stop, "t", "left").groupBy("k").agg(F.avg(F.coalesce("s", F.lit(0)).cast("double")).alias("share"))
    return midpoint(per, "share", QUARTERS)


def similarity_profile(scored: DataFrame, column: str = "sim") -> dict[str, float | None]:
    """Mean and midpoint quartiles over candidate pairs."""
    q = midpoint(scored, column, QUARTERS)
    return {"av_sim": scored.agg(F.avg(column)).first()[0], "sim_q1": q[0], "sim_q2": q[1], "sim_q3": q[2]}


def two_sigma(df: DataFrame, columns: list[str]) -> dict[str, float]:
    from .profile import two_sigma_share

    return two_sigma_share(df, columns).first().asDict() if columns else {}


def populate(df: DataFrame, roles: Roles, classification: bool = True) -> dict[str, float]:
    """corr_<c> and ot_<c> of every column against the target, and the label's own profile, rounded to two decimals.

    Numbers correlate with the target from one wide aggregation; text columns
    have the share of their variance that the target's groups explain.
    """
    numbers, texts, out = numeric_columns(df, roles), text_columns(df, roles), {}
    if numbers:
        row = df.agg(*(F.corr(F.col(c).cast("double"), F.col(roles.target).cast("double")).alias(c) for c in numbers)).first()
        out |= {f"corr_{c}": round(row[c], 2) if row[c] is not None and not math.isnan(row[c]) else 0.0 for c in numbers}
        out |= {f"ot_{c}": round(v or 0.0, 2) for c, v in two_sigma(df, numbers).items()}
    for c in texts:
        g = df.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.avg(roles.target).alias("m"), F.var_pop(roles.target).alias("v"))
        r = g.agg(F.sum("n"), F.sum(F.col("n") * F.col("m")), F.sum(F.col("n") * F.col("m") * F.col("m")), F.sum(F.col("n") * F.col("v"))).first()
        between = (r[2] or 0.0) - (r[1] or 0.0) ** 2 / (r[0] or 1)
        out[f"corr_{c}"] = round(between / (between + (r[3] or 0.0)), 2) if between + (r[3] or 0.0) else 0.0
    if classification and roles.sensitive is None:
        return out
    return out | {k: None if v is None else round(v, 2) for k, v in model_profile(df, roles.target, roles.sensitive, classification).items()}


def sampled_pairs(truth: DataFrame, records: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """The records that a share of the true pairs names; pairs are drawn by the md5 of their ids."""
    lot = F.conv(F.substring(F.md5(F.concat_ws("#", "id1", "id2", F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    ids = truth.where(lot < share)
    named = ids.select(F.col("id1").alias(key)).union(ids.select(F.col("id2").alias(key))).distinct()
    return records.join(named, key, "left_semi")
