"""Exact, token and edit-distance duplicates."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..data import Roles, shared_folder
from .base import Fitted, identity, step


@step("deduplication", "dd")
def first_rows(df: DataFrame, roles: Roles = Roles(), subset: list[str] | None = None, drop_missing: bool = True) -> Fitted:
    """The row of smallest row id of each group of equal values; rows with missing values go first."""

    def apply(d: DataFrame) -> DataFrame:
        d = d.dropna("any") if drop_missing else d
        names = subset or [c for c in d.columns if c != roles.row_id]
        if roles.row_id is None:
            return d.dropDuplicates(names)
        # the smallest id of each group by a partial aggregation, so a large group never meets in one sort
        lowest = d.groupBy(*names).agg(F.min(roles.row_id).alias(roles.row_id)).select(roles.row_id)
        return d.join(lowest, roles.row_id, "left_semi")

    return Fitted(apply)


@step("deduplication", "none")
def no_duplicates(df: DataFrame, roles: Roles = Roles()) -> Fitted:
    return Fitted(lambda d: d.dropna("any"))


@step("deduplication", "exact")
def exact(df: DataFrame, roles: Roles = Roles()) -> Fitted:
    return Fitted(lambda d: d.dropDuplicates())


def token_matches(df: DataFrame, key: str, columns: list[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (ra, rb) of classes, and the class of each row; linked classes have whitespace tokens of a Jaccard similarity of at least the threshold.

    Rows with equal token sets meet as one class. Candidates share a token of
    the rarest part of each class (a match has to), so frequent tokens join
    nothing; overlaps are counted on the arrays of the candidates.
    """
    joined = F.concat_ws("*", *(F.regexp_replace(F.col(c).cast("string"), " +", " ") for c in columns))
    tokens = F.array_sort(F.array_distinct(F.filter(F.split(F.trim(joined), r"\s+"), lambda t: t != "")))
    rows = df.select(F.col(key).alias("_id"), tokens.alias("_t")).where(F.size("_t") > 0)
    sets = rows.groupBy("_t").agg(F.min("_id").alias("_rep"))
    words = sets.select("_rep", F.size("_t").alias("_n"), F.explode("_t").alias("_w"))
    frequency = words.groupBy("_w").agg(F.count(F.lit(1)).alias("_df"))
    place = F.row_number().over(Window.partitionBy("_rep").orderBy("_df", "_w"))
    prefix = words.join(frequency, "_w").withColumn("_p", place).where(F.col("_p") <= F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9) + 1).select("_rep", "_w", "_n")
    a, b = prefix.select(F.col("_rep").alias("ra"), "_w", F.col("_n").alias("na")), prefix.select(F.col("_rep").alias("rb"), "_w", F.col("_n").alias("nb"))
    near = a.join(b, "_w").where((F.col("ra") < F.col("rb")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)).select("ra", "rb").distinct()
    ta, tb = sets.select(F.col("_rep").alias("ra"), F.col("_t").alias("ta")), sets.select(F.col("_rep").alias("rb"), F.col("_t").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    linked = near.join(ta, "ra").join(tb, "rb").where(common >= threshold * (F.size("ta") + F.size("tb") - common) - 1e-9).select("ra", "rb")
    return linked, rows.join(sets, "_t").select("_id", "_rep")


def token_duplicates(df: DataFrame, key: str, columns: list[str], threshold: float = 0.8) -> DataFrame:
    """Keys of the rows that match a row of smaller key: all but the first of a class, and the first of a class that matches an earlier one."""
    linked, member = token_matches(df, key, columns, threshold)
    later = linked.select(F.col("rb").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    return member.join(later, "_id", "left").where((F.col("_id") > F.col("_rep")) | F.col("_hit")).select(F.col("_id").alias(key))


@step("deduplication", "tokens")
def approximate(df: DataFrame, roles: Roles, columns: list[str] | None = None, threshold: float = 0.8) -> Fitted:
    names = columns or [c for c in df.columns if c != roles.row_id]
    return Fitted(lambda d: d.join(token_duplicates(d, roles.row_id, names, threshold), roles.row_id, "left_anti"))


def damerau(a: str, b: str) -> int:
    """Edits with swaps of neighbours (each part edited once)."""
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, raised for a common beginning of up to four letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    ua, ub = [False] * len(a), [False] * len(b)
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not ub[j] and b[j] == x:
                ua[i] = ub[j] = True
                break
    pa, pb = [x for x, u in zip(a, ua, strict=True) if u], [x for x, u in zip(b, ub, strict=True) if u]
    m = len(pa)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(pa, pb, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    start = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + 0.1 * start * (1 - jaro) if jaro > 0.7 else jaro


def distance(kind: str) -> Column:
    """dl Damerau, lm Levenshtein, jw 1 - Jaro-Winkler between columns a and b."""
    if kind == "lm":
        return F.levenshtein("a", "b").cast("double")
    f = {"dl": damerau, "jw": lambda a, b: 1 - jaro_winkler(a, b)}[kind]

    def each(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(f(p, q)) for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(each, "double")("a", "b")


def _edit_candidates(values: DataFrame, threshold: float, kind: str) -> tuple[DataFrame, DataFrame]:
    """(k1, k2) of values (k, s) that a number of edits below the limit can join, and few others; and (cost), the comparisons that each value's look-up takes at most.

    With d the segments that the allowed edits can spoil (one an edit, two
    where an edit swaps neighbours), any d + 1 segments of a value have one that
    stands unspoilt in the other value, shifted by no more than the edits. A
    value is cut into 2 * (d + 1) segments and, apart from that, into segments
    of two letters; the d + 1 rarest of the cheaper of the two are looked up.
    The shorter value is cut, the longer one is searched.
    """
    t, spoil = float(threshold), 2 if kind == "dl" else 1
    # the longest partner of a value of length n, and the edits that the limit with it allows
    edits = lambda n: F.ceil(F.greatest((F.ceil(n * (1 + t / 2) / (1 - t)) + n / 2) * t, F.lit(0.0)) + 1e-9).cast("int") - 1
    need = lambda n: spoil * edits(n) + 1
    ways = lambda n: F.explode(F.array_distinct(F.array(2 * need(n), F.greatest(2 * need(n), F.ceil(n / 2).cast("int")))))
    bound = lambda n, m, i: F.floor(i * n / m).cast("int")
    at = ["n", "m", "i", "w"]
    sized = values.where(F.length("s") > 0).select("k", "s", F.length("s").alias("n"))
    cut = sized.withColumn("m", ways(F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cut = cut.withColumn("from", bound(F.col("n"), F.col("m"), F.col("i")))
    cut = cut.withColumn("w", F.substr("s", F.col("from") + 1, bound(F.col("n"), F.col("m"), F.col("i") + 1) - F.col("from")))
    common = cut.groupBy(*at).agg(F.count(F.lit(1)).alias("df"))
    rare = F.row_number().over(Window.partitionBy("k", "m").orderBy("df", "i"))
    kept = cut.join(common, at).withColumn("r", rare).where(F.col("r") <= need(F.col("n")))
    best = kept.groupBy("k", "m").agg(F.sum("df").alias("cost")).groupBy("k").agg(F.min_by("m", F.struct("cost", "m")).alias("m"), F.min("cost").alias("cost"))
    kept = kept.join(best.select("k", "m"), ["k", "m"]).select(F.col("k").alias("k1"), *at)
    shortest = F.greatest(F.floor(F.col("n") * (1 - t) / (1 + t / 2)).cast("int"), F.lit(1))
    look = sized.select("k", "s", F.col("n").alias("own"), F.explode(F.sequence(shortest, F.col("n"))).alias("n"))
    look = look.withColumn("m", ways(F.col("n"))).withColumn("e", edits(F.col("n"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    look = look.withColumns({"from": bound(F.col("n"), F.col("m"), F.col("i")), "len": bound(F.col("n"), F.col("m"), F.col("i") + 1) - bound(F.col("n"), F.col("m"), F.col("i"))})
    look = look.withColumn("at", F.explode(F.sequence(F.greatest(F.col("from") - F.col("e"), F.lit(0)), F.greatest(F.col("from") - F.col("e"), F.lit(0), F.least(F.col("from") + F.col("e"), F.col("own") - F.col("len"))))))
    look = look.select(F.col("k").alias("k2"), "n", "m", "i", F.substr("s", F.col("at") + 1, F.col("len")).alias("w")).distinct()
    return kept.join(look, at).where("k1 <> k2").select("k1", "k2").distinct(), best.select("cost")


#: Longest value whose near spellings are listed; comparisons that are made without a look-up; share of all comparisons that a look-up may take.
SPELLED, DIRECT, SHARE = 64, 20_000_000, 0.1


def _one_edit(values: DataFrame, kind: str) -> DataFrame:
    """(ka, kb): for each value (k, s) the smallest earlier key among those that differ by one letter at a place, or by one swap, and every value one letter longer or shorter."""
    sized = values.withColumn("n", F.length("s")).where(F.col("n").between(1, SPELLED))
    left_out = F.concat(F.substr("s", F.lit(1), F.col("p") - 1), F.substr("s", F.col("p") + 1, F.col("n")))
    without = sized.withColumn("p", F.explode(F.sequence(F.lit(1), F.col("n")))).select("k", "n", "p", left_out.alias("w"))

    def earliest(spelled: DataFrame) -> DataFrame:
        first = F.min("k").over(Window.partitionBy("p", "w"))
        return spelled.withColumn("ka", first).where("ka < k").select("ka", F.col("k").alias("kb"))

    found = earliest(without)
    shorter = sized.select(F.col("k").alias("k2"), F.col("s").alias("w"), (F.col("n") + 1).alias("n"))
    lengths = F.broadcast(shorter.select("n").distinct())  # at most SPELLED numbers
    longer = without.join(lengths, "n", "left_semi").join(shorter, ["n", "w"])
    found = found.unionByName(longer.select(F.least("k", "k2").alias("ka"), F.greatest("k", "k2").alias("kb")))
    if kind != "lm":
        x, y = F.substr("s", F.col("p"), F.lit(1)), F.substr("s", F.col("p") + 1, F.lit(1))
        places = sized.where("n > 1").withColumn("p", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
        ordered = F.concat(F.substr("s", F.lit(1), F.col("p") - 1), F.least(x, y), F.greatest(x, y), F.substr("s", F.col("p") + 2, F.col("n")))
        found = found.unionByName(earliest(places.where(x != y).select("k", "p", ordered.alias("w"))))
    return found.distinct()


def edit_duplicates(df: DataFrame, key: str, column: str, threshold: float = 0.1, kind: str = "lm", blocks: int | None = None) -> DataFrame:
    """Keys of rows within (len(a) + len(b) / 2) * threshold of a row a of smaller key; equal values meet first.

    A value needs one earlier value near it, so those one edit away are asked
    first. Where the limit allows one edit only, that is all there is (lm, dl).
    Else the values still without one ask the others: lm and dl below a
    threshold of 0.4 where a rare segment is shared; jw, and larger
    thresholds, bound nothing that could be looked up: there they ask all
    values, block by block; so do they where they are few, or so much alike
    that a look-up would meet a tenth of all pairs anyhow.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("k"), F.col(column).alias("s")).where("s is not null")
    values = rows.groupBy("s").agg(F.min("k").alias("k"))
    limit = (F.length("a") + F.length("b") / 2) * threshold

    def measured(near: DataFrame) -> DataFrame:
        if kind in ("lm", "dl"):
            near = near.where(F.abs(F.length("a") - F.length("b")) < limit)
        else:  # no more letters can match than the shorter value has, and a common beginning makes up for two fifths at most
            near = near.where(0.2 * (1 - F.least(F.length("a"), F.length("b")) / F.greatest(F.length("a"), F.length("b"), F.lit(1))) < limit + 1e-9)
        if kind == "dl":  # a swap is two plain edits, so this rules out before Python is asked
            near = near.where(F.levenshtein("a", "b") < 2 * limit)
        return near.withColumn("_d", distance(kind)).where(F.col("_d") < limit).select(F.col("kb").alias("k")).distinct()

    def spelled(pair: DataFrame) -> DataFrame:
        return pair.join(values.select(F.col("k").alias("ka"), F.col("s").alias("a")), "ka").join(values.select(F.col("k").alias("kb"), F.col("s").alias("b")), "kb")

    longest, many = values.agg(F.max(F.length("s")), F.count(F.lit(1))).first()
    folder = f"{shared_folder(spark)}/edits-{uuid.uuid4().hex}"
    measured(spelled(_one_edit(values, kind))).write.parquet(folder)
    hit = spark.read.schema(values.select("k").schema).parquet(folder)
    if kind == "jw" or (longest or 0) > SPELLED or 1.5 * (longest or 0) * threshold > 2:
        rest = values.join(hit, "k", "left_anti")
        asking = many - hit.count()
        found = None
        if kind in ("lm", "dl") and threshold < 0.4 and blocks is None and asking * many > DIRECT:
            found, costs = _edit_candidates(values, threshold, kind)
            cost = costs.agg(F.sum("cost")).first()[0]
            found = found if (cost or 0) <= SHARE * many * asking else None
        if found is not None:
            pair = found.select(F.least("k1", "k2").alias("ka"), F.greatest("k1", "k2").alias("kb")).distinct()
            near = spelled(pair.join(rest.select(F.col("k").alias("kb")), "kb", "left_semi"))
        else:
            nb = blocks or max(1, -(-many // 4096))
            told = values.select(F.pmod(F.xxhash64("s"), F.lit(nb)).alias("_b"), F.col("k").alias("ka"), F.col("s").alias("a"))
            ask = rest.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("_b"), F.col("k").alias("kb"), F.col("s").alias("b"))
            near = told.join(ask, "_b").where(F.col("ka") < F.col("kb"))
        hit = hit.unionByName(measured(near))
    # rows of an equal value are at distance 0 of its first; the first is dropped if it is near an earlier value
    later = hit.withColumn("_hit", F.lit(True))
    same = rows.join(values.select("s", F.col("k").alias("_first")), "s").join(later, "k", "left")
    return same.where(((F.length("s") > 0) & (F.col("k") > F.col("_first"))) | F.col("_hit")).select(F.col("k").alias(key))


@step("deduplication", "metric")
def metric(df: DataFrame, roles: Roles, column: str = "", threshold: float = 0.1, kind: str = "lm") -> Fitted:
    return Fitted(lambda d: d.join(edit_duplicates(d, roles.row_id, column, threshold, kind), roles.row_id, "left_anti"))


@step("deduplication", "keep")
def keep(df: DataFrame, roles: Roles = Roles()) -> Fitted:
    return Fitted(identity)
