"""Entity resolution: blocks, cleaning, comparison weights, matching, clustering."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..data import shared_folder
from .text import runs_of


def tokens(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))


def qgrams(c: str | Column, q: int) -> Column:
    """All q-grams but the last of the lower-cased text."""
    every = runs_of(F.filter(F.split(F.lower(c), ""), lambda x: x != ""), q, "")
    return F.array_distinct(F.slice(every, F.lit(1), F.greatest(F.size(every) - 1, F.lit(0))))


def blocks(df: DataFrame, key: str, column: str, q: int = 0) -> DataFrame:
    """(rid, token): token blocks, or q-gram blocks for q > 0."""
    return df.select(F.col(key).alias("rid"), F.explode(qgrams(column, q) if q > 0 else tokens(column)).alias("token"))


def _number(members: DataFrame) -> Column:
    """Records of a group of members: a member stands for n records if there is a column n, or for one."""
    return F.sum("n") if "n" in members.columns else F.count(F.lit(1))


def block_sizes(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """(token, size): the number of comparisons of a block, the product of its sides (or of itself)."""
    a = left.groupBy("token").agg(_number(left).alias("n"))
    if right is None:
        return a.select("token", (F.col("n") * F.col("n")).alias("size"))
    b = right.groupBy("token").agg(_number(right).alias("m"))
    return a.join(b, "token").select("token", (F.col("n") * F.col("m")).alias("size"))


def purge(sizes: DataFrame, theta: float) -> DataFrame:
    """The int((1 - theta) * blocks) smallest blocks, ties by token; a distributed sort and limit."""
    keep = int((1 - theta) * sizes.count())
    return sizes.orderBy("size", "token").limit(keep)


def filter_blocks(members: DataFrame, theta: float) -> DataFrame:
    """Each record stays in its smallest blocks: those of rank r with r - 1 <= (1 - theta) * its blocks; blocks of one record go."""
    size = members.groupBy("token").agg(_number(members).alias("size"))
    sized = members.join(size, "token")
    own = Window.partitionBy("rid")
    kept = sized.withColumns({"_r": F.row_number().over(own.orderBy("size", "token")), "_b": F.count(F.lit(1)).over(own)})
    kept = kept.where(F.col("_r") - 1 <= F.col("_b") * F.lit(1 - theta)).select(members.columns)
    many = kept.groupBy("token").agg(_number(kept).alias("k")).where("k > 1").select("token")
    return kept.join(many, "token", "left_semi")


#: Records in a list that is paired with another list at once.
CHUNK = 512


@dataclass(frozen=True)
class Edges:
    """Candidate pairs between classes of records with equal blocks, and the records of each class.

    classes is (c1, c2, pairs, ...), a class having the smallest id of its
    records; left and right are (cls, rids), lists of some records of a class
    each. In one table (one) the two are the same, and c1 <= c2.
    """

    classes: DataFrame
    left: DataFrame
    right: DataFrame
    one: bool
    with_self: bool = False

    def expand(self) -> DataFrame:
        """(id1, id2, ...) of every pair of records; nothing is shuffled once pairs are listed."""
        rest = [c for c in self.classes.columns if c not in ("c1", "c2", "pairs")]
        a, b = self.left.select(F.col("cls").alias("c1"), F.col("rids").alias("ra")), self.right.select(F.col("cls").alias("c2"), F.col("rids").alias("rb"))
        lists = self.classes.drop("pairs").join(a, "c1").join(b, "c2")
        every = lists.select("c1", "c2", "rb", F.explode("ra").alias("id1"), *rest).select("c1", "c2", "id1", F.explode("rb").alias("id2"), *rest)
        if not self.one:
            return every.select("id1", "id2", *rest)
        own = F.col("id1") <= F.col("id2") if self.with_self else F.col("id1") < F.col("id2")
        return every.where((F.col("c1") < F.col("c2")) | own).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"), *rest)


def written(df: DataFrame) -> DataFrame:
    """The frame as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/blocks-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _classed(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cls, tokens, n) of the records with equal blocks, and (cls, rids) in lists of about CHUNK; both are written tables."""
    own = written(members.groupBy("rid").agg(F.array_sort(F.collect_list("token")).alias("tokens")))
    classes = written(own.groupBy("tokens").agg(F.min("rid").alias("cls"), F.count(F.lit(1)).alias("n")))
    part = F.pmod(F.xxhash64("rid"), F.ceil(F.col("n") / CHUNK))
    lists = own.join(classes, "tokens").groupBy("cls", part.alias("part")).agg(F.collect_list("rid").alias("rids")).select("cls", "rids")
    return classes, written(lists)


def edges(left: DataFrame, right: DataFrame | None = None, scheme: str = "common", with_self: bool = False) -> Edges:
    """Candidates that share a block, with their weight, or (scheme common) with the number of their common blocks.

    Records with equal blocks have equal weights with all others, so weights
    are found between classes of such records only.
    """
    one = right is None
    kinds1, lists1 = _classed(left)
    kinds2, lists2 = (kinds1, lists1) if one else _classed(right)
    return Edges(class_edges(kinds1, None if one else kinds2, scheme, with_self), lists1, lists2, one, with_self)


def class_edges(left: DataFrame, right: DataFrame | None = None, scheme: str = "common", with_self: bool = False) -> DataFrame:
    """(c1, c2, pairs, weight or common) between classes (cls, tokens, n) of n records each."""
    one = right is None
    kinds1, kinds2 = left, left if one else right
    blocks1, blocks2 = (x.select("n", F.explode("tokens").alias("token")) for x in (kinds1, kinds2))
    a = kinds1.select(F.col("cls").alias("c1"), F.col("n").alias("n1"), F.size("tokens").alias("b1"), F.explode("tokens").alias("token"))
    b = kinds2.select(F.col("cls").alias("c2"), F.col("n").alias("n2"), F.size("tokens").alias("b2"), F.explode("tokens").alias("token"))
    n, value = F.count(F.lit(1)), F.lit(0.0)
    if scheme == "arcs":
        a, value = a.join(block_sizes(blocks1, None if one else blocks2), "token"), F.sum(1 / F.col("size"))
    both = a.join(b, "token")
    if one:
        both = both.where(F.col("c1") <= F.col("c2"))
    met = both.groupBy("c1", "c2").agg(n.alias("common"), value.alias("weight"), *(F.first(c).alias(c) for c in ("n1", "n2", "b1", "b2")))
    if one:
        same = F.col("n1") * (F.col("n1") + (1 if with_self else -1)) / 2
        met = met.withColumn("pairs", F.when(F.col("c1") < F.col("c2"), F.col("n1") * F.col("n2")).otherwise(same.cast("long"))).where("pairs > 0")
    else:
        met = met.withColumn("pairs", F.col("n1") * F.col("n2"))
    if scheme == "common":
        return met.select("c1", "c2", "pairs", "common")
    if scheme == "ecbs":
        total = blocks1.unionByName(blocks2).select("token").distinct().count()
        w = F.col("common") * F.log2(F.lit(float(total)) / F.col("b1")) * F.log2(F.lit(float(total)) / F.col("b2"))
    elif scheme == "js":
        w = F.col("common") / (F.col("b1") + F.col("b2") - F.col("common"))
    elif scheme in ("cbs", "arcs"):
        w = F.col("common" if scheme == "cbs" else "weight")
    else:
        raise ValueError(f"unknown scheme {scheme}")
    return met.select("c1", "c2", "pairs", w.cast("double").alias("weight"))


def pairs(left: DataFrame, right: DataFrame | None = None, with_self: bool = False) -> DataFrame:
    """(id1, id2, common): candidates that share a block, and how many. One table: unordered, id1 < id2 (or <=)."""
    return edges(left, right, with_self=with_self).expand()


def weights(members: DataFrame, scheme: str, right: DataFrame | None = None) -> DataFrame:
    """(id1, id2, weight): cbs common blocks; arcs sum of 1 / comparisons; ecbs and js discount records of many blocks."""
    return edges(members, right, scheme).expand()


def prune(found: Edges) -> Edges:
    """prune_edges() before pairs are listed: a class pair counts as often as it has pairs of records."""
    return replace(found, classes=prune_classes(found.classes))


def prune_classes(classes: DataFrame) -> DataFrame:
    mean = classes.agg(F.round(F.sum(F.col("weight") * F.col("pairs")) / F.sum("pairs"), 5).alias("m"))
    return classes.crossJoin(F.broadcast(mean)).where(F.round("weight", 5) >= F.col("m")).drop("m")  # one row


def prune_edges(edges: DataFrame) -> DataFrame:
    """Edges of at least the mean weight, both rounded to five decimals."""
    mean = edges.agg(F.round(F.avg("weight"), 5).alias("m"))
    return edges.crossJoin(F.broadcast(mean)).where(F.round("weight", 5) >= F.col("m")).drop("m")  # one row


def word_set(c: str | Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.replace(F.lower(c), F.lit(","), F.lit("")), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; two empty ones are equal."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common.cast("double"), (F.size(a) + F.size(b) - common).cast("double")), F.lit(1.0))


def similarities(candidates: DataFrame, left: DataFrame, right: DataFrame, key1: str, key2: str, columns: list[tuple[str, str]]) -> DataFrame:
    """candidates with sim: the mean word Jaccard of the column pairs."""
    a = left.select(F.col(key1).alias("id1"), *(word_set(x).alias(f"_a{i}") for i, (x, _) in enumerate(columns)))
    b = right.select(F.col(key2).alias("id2"), *(word_set(y).alias(f"_b{i}") for i, (_, y) in enumerate(columns)))
    sims = [jaccard(F.col(f"_a{i}"), F.col(f"_b{i}")) for i in range(len(columns))]
    full = candidates.join(a, "id1").join(b, "id2")
    return full.select(*candidates.columns, (sum(sims[1:], sims[0]) / len(sims)).alias("sim"))


def cached_similarities(candidates: DataFrame, left: DataFrame, right: DataFrame, key1: str, key2: str, columns: list[tuple[str, str]], path: str) -> DataFrame:
    """similarities() through a table of pairs already compared: known pairs are read, the others are compared and added to it."""
    spark = candidates.sparkSession
    schema = spark.range(0).join(candidates.select("id1", "id2").limit(0), F.lit(True)).select("id1", "id2", F.lit(0.0).alias("sim")).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    known = spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
    new = candidates.select("id1", "id2").distinct().join(known, ["id1", "id2"], "left_anti")
    similarities(new, left, right, key1, key2, columns).write.mode("append").parquet(path)
    return candidates.join(spark.read.schema(schema).parquet(path), ["id1", "id2"])


def match(scored: DataFrame, theta: float = 0.75) -> DataFrame:
    return scored.where(F.col("sim") >= theta)


def perfect_match(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    return candidates.join(truth, ["id1", "id2"], "left_semi")


def confusion(scored: DataFrame, truth: DataFrame, thetas: list[float]) -> DataFrame:
    """theta, tp, fp, tn, fn, precision, recall, f, accuracy over all thresholds from one pass; truth that is no candidate is a miss."""
    known = truth.select("id1", "id2").distinct().withColumn("_true", F.lit(True))
    rows = scored.select("id1", "id2", "sim").join(known, ["id1", "id2"], "full")
    rows = rows.withColumns({"sim": F.coalesce("sim", F.lit(-1.0)), "_true": F.coalesce("_true", F.lit(False))})
    aggs = []
    for i, t in enumerate(thetas):
        hit = F.col("sim") >= t
        aggs += [F.count_if(hit & F.col("_true")).alias(f"tp{i}"), F.count_if(hit & ~F.col("_true")).alias(f"fp{i}"), F.count_if(~hit & ~F.col("_true")).alias(f"tn{i}"), F.count_if(~hit & F.col("_true")).alias(f"fn{i}")]
    one = rows.agg(*aggs)
    long = one.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("theta"), *(F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "tn", "fn"))) for i, t in enumerate(thetas)))).alias("x")).select("x.*")
    return rates(long)


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f and accuracy, rounded to five decimals; 0 where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({"precision": F.round(ratio(tp, tp + fp), 5), "recall": F.round(ratio(tp, tp + fn), 5), "f": F.round(ratio(2 * tp, 2 * tp + fp + fn), 5), "accuracy": F.round(ratio(tp + tn, tp + fp + tn + fn), 5)})


def k_center(df: DataFrame, key: str, items: Column, k: int, first=None) -> DataFrame:
    """(key, center, distance): farthest-first centres under 1 - Jaccard; each round is one aggregation, ties go to the smaller key."""
    rows = df.select(F.col(key).alias("id"), items.alias("items"))
    start = rows.agg(F.min("id")).first()[0] if first is None else first
    centres, distance, centre = [], None, None
    nxt = start
    for _ in range(k):
        got = rows.where(F.col("id") == nxt).select("items").first()
        if got is None:
            break
        own = F.array(*(F.lit(x) for x in got["items"])) if got["items"] else F.array().cast("array<string>")
        d = F.round(1 - jaccard(F.col("items"), own), 9)
        centre = F.lit(nxt) if distance is None else F.when(d < distance, F.lit(nxt)).otherwise(centre)
        distance = d if distance is None else F.least(distance, d)
        centres.append(nxt)
        nxt = rows.select("id", distance.alias("d")).agg(F.max_by("id", F.struct("d", -F.col("id")))).first()[0]
    return rows.select(F.col("id").alias(key), centre.alias("center"), distance.alias("distance"))


def cluster_precision(clusters: DataFrame, key: str, cluster: str, truth: str) -> DataFrame:
    """tp and pairs inside clusters from group sizes, without listing pairs; precision rounded to five decimals."""
    cells = clusters.groupBy(cluster, truth).agg(F.count(F.lit(1)).alias("n"))
    choose = lambda n: n * (n - 1) / 2
    tp = cells.agg(F.sum(choose(F.col("n"))).cast("long").alias("tp"))
    every = cells.groupBy(cluster).agg(F.sum("n").alias("n")).agg(F.sum(choose(F.col("n"))).cast("long").alias("pairs"))
    return tp.crossJoin(every).withColumn("precision", F.round(F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("pairs").cast("double")), F.lit(0.0)), 5))


def all_pairs(left: DataFrame, right: DataFrame, key1: str, key2: str, column: str, theta: float) -> DataFrame:
    """(id1, id2, sim) of every pair with a word Jaccard of at least theta > 0: only pairs that share a rare word of each side meet."""
    a = left.select(F.col(key1).alias("id1"), word_set(column).alias("a")).where(F.size("a") > 0)
    b = right.select(F.col(key2).alias("id2"), word_set(column).alias("b")).where(F.size("b") > 0)
    freq = a.select(F.explode("a").alias("t")).unionAll(b.select(F.explode("b").alias("t"))).groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def prefix(rows: DataFrame, key: str, items: str) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(key).orderBy("n", "t"))
        sized = rows.select(key, F.size(items).alias("_s"), F.explode(items).alias("t")).join(freq, "t").withColumn("_p", place)
        return sized.where(F.col("_p") <= F.col("_s") - F.ceil(F.col("_s") * theta - 1e-9) + 1).select(key, "t")

    near = prefix(a, "id1", "a").join(prefix(b, "id2", "b"), "t").select("id1", "id2").distinct()
    sim = jaccard(F.col("a"), F.col("b"))
    return near.join(a, "id1").join(b, "id2").select("id1", "id2", sim.alias("sim")).where(F.col("sim") >= theta)
