"""Queries of missing and invalid values, scaling, shape, outliers and duplicates, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..data import Roles, table
from ..operators import duplicates, outliers
from ..operators.base import fit
from ..operators.branch import branch
from ..plans.plan import Executor, Plan
from .registry import query

ROLES = Roles(row_id="rid")
_KEY = "l_orderkey * 10 + l_linenumber"
_GAPS = f"SELECT {_KEY} AS rid, CASE WHEN l_orderkey % 10 = 3 THEN NULL ELSE l_quantity END AS qty, CASE WHEN l_partkey % 7 = 2 THEN NULL ELSE l_extendedprice END AS price, l_discount AS disc, CASE WHEN l_suppkey % 9 = 1 THEN NULL ELSE l_returnflag END AS flag FROM lineitem"
_NUMS = f"SELECT {_KEY} AS rid, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc FROM lineitem"
_SUPP = "SELECT s_suppkey AS rid, CASE WHEN s_suppkey % 5 = 2 THEN NULL ELSE s_acctbal END AS bal, CAST(s_nationkey AS DOUBLE) AS nat, CAST(s_suppkey % 17 AS DOUBLE) AS x FROM supplier"


def gaps(spark: SparkSession, d: str) -> DataFrame:
    """lineitem with values taken out by key arithmetic, since the tables have no gaps of their own."""
    c = lambda cond, v: F.when(~F.expr(cond), F.col(v))
    return table(spark, d, "lineitem").select(F.expr(_KEY).alias("rid"), c("l_orderkey % 10 = 3", "l_quantity").alias("qty"), c("l_partkey % 7 = 2", "l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), c("l_suppkey % 9 = 1", "l_returnflag").alias("flag"))


def nums(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.expr(_KEY).alias("rid"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"))


def supp(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("rid"), F.when(F.expr("s_suppkey % 5 <> 2"), F.col("s_acctbal")).alias("bal"), F.col("s_nationkey").cast("double").alias("nat"), F.expr("cast(s_suppkey % 17 as double)").alias("x"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _fills(center: str) -> str:
    return f"WITH g AS ({_GAPS}), s AS (SELECT {center} FROM g) SELECT rid, round(coalesce(qty, mq), 4) AS qty, round(coalesce(price, mp), 4) AS price, disc, flag FROM g, s"


@query("impute_mean", _fills("avg(qty) AS mq, avg(price) AS mp"))
def _(spark, d):
    df = gaps(spark, d)
    return rounded(fit("missing_value", "mean", df, ROLES)(df), "qty", "price", digits=4)


@query("impute_median", _fills("quantile_cont(qty, 0.5) AS mq, quantile_cont(price, 0.5) AS mp"))
def _(spark, d):
    df = gaps(spark, d)
    return rounded(fit("missing_value", "median", df, ROLES)(df), "qty", "price", digits=4)


def _mode(c: str) -> str:
    return f"(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("impute_mode", f"WITH g AS ({_GAPS}) SELECT rid, round(coalesce(qty, {_mode('qty')}), 4) AS qty, round(coalesce(price, {_mode('price')}), 4) AS price, disc, coalesce(flag, {_mode('flag')}) AS flag FROM g")
def _(spark, d):
    df = gaps(spark, d)
    return rounded(fit("missing_value", "most_frequent", df, ROLES)(df), "qty", "price", digits=4)


@query("impute_drop", f"SELECT * FROM ({_GAPS}) WHERE qty IS NOT NULL AND price IS NOT NULL AND flag IS NOT NULL")
def _(spark, d):
    df = gaps(spark, d)
    return fit("missing_value", "drop", df, ROLES)(df)


def _knn_sql(value: str) -> str:
    return f"""
WITH g AS ({_SUPP}),
p AS (SELECT a.rid AS ask, b.rid AS near, b.bal AS bal, round(sqrt(3.0 / 2 * ((a.nat - b.nat) * (a.nat - b.nat) + (a.x - b.x) * (a.x - b.x))), 9) AS dist
  FROM g a, g b WHERE a.bal IS NULL AND b.bal IS NOT NULL AND a.rid <> b.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY dist, near) AS k FROM p),
v AS (SELECT ask, {value} AS v FROM r WHERE k <= 5 GROUP BY ask)
SELECT g.rid, round(coalesce(g.bal, v.v), 4) AS bal, g.nat, g.x FROM g LEFT JOIN v ON v.ask = g.rid"""


@query("impute_knn", _knn_sql("avg(bal)"))
def _(spark, d):
    df = supp(spark, d)
    return rounded(fit("missing_value", "knn", df, ROLES, k=5)(df), "bal", digits=4)


@query("impute_knn_weighted", _knn_sql("sum(bal / greatest(dist, 1e-12)) / sum(1 / greatest(dist, 1e-12))"))
def _(spark, d):
    df = supp(spark, d)
    return rounded(fit("missing_value", "knn_weighted", df, ROLES, k=5)(df), "bal", digits=4)


@query("impute_random")
def _(spark, d):
    df = gaps(spark, d)
    return fit("missing_value", "rand", df, ROLES)(df)


@query("impute_mice")
def _(spark, d):
    df = gaps(spark, d)
    return fit("missing_value", "mice", df, ROLES)(df)


@query("impute_em")
def _(spark, d):
    df = gaps(spark, d)
    return fit("missing_value", "em", df, ROLES)(df)


_BADNUM = f"SELECT {_KEY} AS rid, CASE WHEN l_orderkey % 11 = 4 THEN -999.0 WHEN l_orderkey % 13 = 5 THEN 99999.0 ELSE l_quantity END AS qty, CASE l_partkey % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN ' unknown ' WHEN 2 THEN '?' WHEN 3 THEN '   ' ELSE l_returnflag END AS flag FROM lineitem"


def bad(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(f"{_KEY} AS rid", "CASE WHEN l_orderkey % 11 = 4 THEN -999.0D WHEN l_orderkey % 13 = 5 THEN 99999.0D ELSE l_quantity END AS qty", "CASE l_partkey % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN ' unknown ' WHEN 2 THEN '?' WHEN 3 THEN '   ' ELSE l_returnflag END AS flag")


_NUM_OK = "CASE WHEN qty NOT IN (-999, -9999, 999, 9999, 99999) THEN qty END AS qty"
_TEXT_OK = "CASE WHEN NOT regexp_matches(lower(trim(flag)), '^(\\s*|na|n/a|none|null|nan|unknown|missing|\\?)$') THEN flag END AS flag"


@query("invalid_sentinel", f"SELECT rid, {_NUM_OK}, flag FROM ({_BADNUM})")
def _(spark, d):
    df = bad(spark, d)
    return fit("invalid_value", "sentinel", df, ROLES)(df)


@query("invalid_regex", f"SELECT rid, qty, {_TEXT_OK} FROM ({_BADNUM})")
def _(spark, d):
    df = bad(spark, d)
    return fit("invalid_value", "regex", df, ROLES)(df)


@query("invalid_both", f"SELECT rid, {_NUM_OK}, {_TEXT_OK} FROM ({_BADNUM})")
def _(spark, d):
    df = bad(spark, d)
    return fit("invalid_value", "both", df, ROLES)(df)


_TINY = f"SELECT {_KEY} AS rid, CASE WHEN l_orderkey % 4 = 1 THEN l_discount * 1e-9 ELSE l_extendedprice / 7.0 END AS v FROM lineitem"


def tiny(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(f"{_KEY} AS rid", "CASE WHEN l_orderkey % 4 = 1 THEN l_discount * 1e-9D ELSE l_extendedprice / 7.0D END AS v")


@query("float_snap", f"SELECT rid, CASE WHEN abs(v) < 1e-8 THEN 0.0 ELSE v END AS v FROM ({_TINY})")
def _(spark, d):
    df = tiny(spark, d)
    return fit("floating_point", "snap", df, ROLES)(df)


@query("float_round", f"SELECT rid, round(v, 6) AS v FROM ({_TINY})")
def _(spark, d):
    df = tiny(spark, d)
    return fit("floating_point", "round", df, ROLES)(df)


@query("float_both", f"SELECT rid, round(CASE WHEN abs(v) < 1e-8 THEN 0.0 ELSE v END, 6) AS v FROM ({_TINY})")
def _(spark, d):
    df = tiny(spark, d)
    return fit("floating_point", "both", df, ROLES)(df)


def _scaled(name: str, strategy: str, stats: dict[str, str], expr: str) -> None:
    """A scaling query: per-column statistics and an expression over {c} and them."""
    cols = ("qty", "price", "disc")
    agg = ", ".join(f"{f.format(c=c)} AS {k}_{c}" for c in cols for k, f in stats.items()) or "count(*) AS n"
    out = ", ".join("round({}, 6) AS {}".format(expr.format(c=c, **{k: f"{k}_{c}" for k in stats}), c) for c in cols)

    @query(name, f"WITH g AS ({_NUMS}), s AS (SELECT {agg} FROM g) SELECT rid, {out} FROM g, s")
    def run(spark, d):
        df = nums(spark, d)
        return rounded(fit("normalization", strategy, df, ROLES)(df), *cols)


_scaled("scale_standard", "ss", {"m": "avg({c})", "s": "stddev_pop({c})"}, "({c} - {m}) / CASE WHEN {s} = 0 THEN 1 ELSE {s} END")
_scaled("scale_robust", "rs", {"m": "quantile_cont({c}, 0.5)", "a": "quantile_cont({c}, 0.25)", "b": "quantile_cont({c}, 0.75)"}, "({c} - {m}) / CASE WHEN {b} = {a} THEN 1 ELSE {b} - {a} END")
_scaled("scale_maxabs", "ma", {"m": "max(abs({c}))"}, "{c} / {m}")
_scaled("scale_minmax", "mm", {"a": "min({c})", "b": "max({c})"}, "({c} - {a}) / ({b} - {a})")
_scaled("scale_minmax_const", "mm_const", {"a": "min({c})", "b": "max({c})"}, "CASE WHEN {a} = {b} THEN 0.0 ELSE ({c} - {a}) / ({b} - {a}) END")
_scaled("scale_max_signed", "ma_signed", {"m": "max({c})"}, "{c} / {m}")
_scaled("scale_zscore_samp", "zs", {"m": "avg({c})", "s": "stddev_samp({c})"}, "({c} - {m}) / {s}")
_scaled("scale_log10", "log10", {}, "CASE WHEN {c} > 0 THEN log10({c}) ELSE {c} END")


@query(
    "scale_quantile10",
    f"""WITH g AS ({_NUMS}), q AS (SELECT quantile_cont(price, [0, 1/9.0, 2/9.0, 3/9.0, 4/9.0, 5/9.0, 6/9.0, 7/9.0, 8/9.0, 1]) AS q FROM g),
    e AS (SELECT unnest(range(1, 10)) AS i), t AS (SELECT i, q[i] AS a, q[i+1] AS b FROM e, q)
    SELECT rid, round((t.i - 1 + (price - a) / (b - a)) / 9.0, 6) AS price FROM g JOIN t ON price > a AND price <= b
    UNION ALL SELECT rid, 0.0 FROM g, q WHERE price = q[1]""",
)
def _(spark, d):
    df = nums(spark, d).select("rid", "price")
    return rounded(fit("normalization", "quantile10", df, ROLES)(df), "price")


def _shifted(c: str) -> str:
    return f"CASE WHEN lo >= 0 THEN {c} ELSE {c} + (-lo + 1e-6) END"


for _name, _f in (("log1p", "ln(1 + ({}))"), ("sqrt", "sqrt({})")):

    @query(f"shape_{_name}", f"WITH s AS (SELECT min(c_acctbal) AS lo FROM customer) SELECT c_custkey AS rid, round({_f.format(_shifted('c_acctbal'))}, 6) AS bal FROM customer, s")
    def _(spark, d, name=_name):
        df = table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), F.col("c_acctbal").alias("bal"))
        return rounded(fit("distribution_shape", name, df, ROLES)(df), "bal")


_YJ = "CASE WHEN v >= 0 THEN (pow(v + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - v, 1.5) - 1) / 1.5 END"


@query("shape_yeojohnson_fixed", f"SELECT c_custkey AS rid, round({_YJ}, 6) AS bal FROM (SELECT c_custkey, c_acctbal / 1000.0 AS v FROM customer)")
def _(spark, d):
    df = table(spark, d, "customer").select(F.col("c_custkey").alias("rid"), (F.col("c_acctbal") / 1000).alias("bal"))
    return rounded(fit("distribution_shape", "yeojohnson", df, ROLES, lambdas={"bal": 0.5})(df), "bal")


@query("shape_boxcox_fixed", "SELECT p_partkey AS rid, round((pow(p_retailprice, 0.25) - 1) / 0.25, 6) AS price FROM part")
def _(spark, d):
    df = table(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.col("p_retailprice").alias("price"))
    return rounded(fit("distribution_shape", "boxcox", df, ROLES, lambdas={"price": 0.25})(df), "price")


@query("shape_yeojohnson_mle")
def _(spark, d):
    df = nums(spark, d)
    return fit("distribution_shape", "yeojohnson", df, ROLES)(df)


@query("nonlinear_quantile")
def _(spark, d):
    df = nums(spark, d)
    return fit("nonlinear_transform", "quantile", df, ROLES)(df)


@query("nonlinear_power")
def _(spark, d):
    df = nums(spark, d)
    return fit("nonlinear_transform", "power", df, ROLES)(df)


@query("log_skew", "WITH m AS (SELECT avg(l_extendedprice) AS a FROM lineitem), k AS (SELECT avg(pow(l_extendedprice - a, 3)) / pow(avg(pow(l_extendedprice - a, 2)), 1.5) AS s FROM lineitem, m) SELECT l_orderkey * 10 + l_linenumber AS rid, round(CASE WHEN s >= 0.75 THEN ln(1 + l_extendedprice) ELSE l_extendedprice END, 6) AS price FROM lineitem, k")
def _(spark, d):
    df = nums(spark, d).select("rid", "price")
    return rounded(fit("log_skew", "log1p", df, ROLES)(df), "price")


@query("unit_convert", f"SELECT rid, qty * 2.5 + 1 AS qty, price, disc FROM ({_NUMS})")
def _(spark, d):
    df = nums(spark, d)
    return fit("unit_converter", "linear", df, ROLES, column="qty", multiplier=2.5, offset=1.0)(df)


_FENCE = "SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in ("qty", "price", "disc"))
_IN = "{c} BETWEEN a_{c} - 1.5 * (b_{c} - a_{c}) AND b_{c} + 1.5 * (b_{c} - a_{c})"
_SPIKED = f"SELECT {_KEY} AS rid, l_quantity AS qty, CASE WHEN l_orderkey % 50 = 7 THEN l_extendedprice * 10 ELSE l_extendedprice END AS price, l_discount AS disc FROM lineitem"


def spiked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(f"{_KEY} AS rid", "l_quantity AS qty", "CASE WHEN l_orderkey % 50 = 7 THEN l_extendedprice * 10 ELSE l_extendedprice END AS price", "l_discount AS disc")


@query("outlier_iqr", f"WITH g AS ({_SPIKED}), f AS ({_FENCE} FROM g) SELECT rid, qty, price, disc FROM g, f WHERE {' AND '.join(_IN.format(c=c) for c in ('qty', 'price', 'disc'))}")
def _(spark, d):
    df = spiked(spark, d)
    return fit("outlier", "iqr", df, ROLES)(df)


@query("outlier_iqr_cells", f"WITH g AS ({_SPIKED}), f AS ({_FENCE} FROM g) SELECT rid, {', '.join('CASE WHEN ' + _IN.format(c=c) + f' THEN {c} END AS {c}' for c in ('qty', 'price', 'disc'))} FROM g, f")
def _(spark, d):
    df = spiked(spark, d)
    return fit("outlier_cells", "iqr", df, ROLES)(df)


@query("outlier_iqr_share", f"WITH g AS ({_SPIKED}), f AS ({_FENCE} FROM g) SELECT rid, qty, price, disc FROM g, f WHERE ({' + '.join('CASE WHEN ' + _IN.format(c=c) + ' THEN 0 ELSE 1 END' for c in ('qty', 'price', 'disc'))}) / 3.0 <= 0.3")
def _(spark, d):
    df = spiked(spark, d)
    return fit("outlier", "iqr_share", df, ROLES, threshold=0.3)(df)


@query(
    "outlier_zsb",
    f"""WITH g AS ({_SPIKED}), m AS (SELECT median(qty) AS mq, median(price) AS mp, median(disc) AS md FROM g),
    s AS (SELECT median(abs(qty - mq)) AS sq, median(abs(price - mp)) AS sp, median(abs(disc - md)) AS sd FROM g, m)
    SELECT rid, qty, price, disc FROM g, m, s WHERE (CASE WHEN sq > 0 AND abs((qty - mq) / (1.4296 * sq)) > 1.6 THEN 1 ELSE 0 END + CASE WHEN sp > 0 AND abs((price - mp) / (1.4296 * sp)) > 1.6 THEN 1 ELSE 0 END + CASE WHEN sd > 0 AND abs((disc - md) / (1.4296 * sd)) > 1.6 THEN 1 ELSE 0 END) / 3.0 <= 0.3""",
)
def _(spark, d):
    df = spiked(spark, d)
    return fit("outlier", "zsb", df, ROLES, threshold=0.3)(df)


@query(
    "outlier_lof",
    """WITH g AS (SELECT s_suppkey AS rid, s_acctbal / 1000.0 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier),
    p AS (SELECT a.rid AS ask, b.rid AS near, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS d FROM g a, g b WHERE a.rid <> b.rid),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY d, near) AS r FROM p) WHERE r <= 5),
    rad AS (SELECT ask AS near, max(d) AS rad FROM k GROUP BY ask), rch AS (SELECT k.ask, k.near, greatest(k.d, rad.rad) AS reach FROM k JOIN rad ON rad.near = k.near),
    den AS (SELECT ask, 1 / (avg(reach) + 1e-10) AS lrd FROM rch GROUP BY ask)
    SELECT k.ask AS rid, round(avg(o.lrd) / min(m.lrd), 6) AS lof FROM k JOIN den o ON o.ask = k.near JOIN den m ON m.ask = k.ask GROUP BY k.ask""",
)
def _(spark, d):
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("rid"), (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return rounded(outliers.lof_scores(df, "rid", ["x", "y"], 5), "lof")


@query("outlier_isolation")
def _(spark, d):
    df = spiked(spark, d)
    return fit("outlier", "if", df, ROLES, contamination=0.05)(df)


@query("dedup_first", "SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def _(spark, d):
    df = table(spark, d, "documents").select("doc_id", "text", "lang")
    return fit("deduplication", "dd", df, Roles(row_id="doc_id"), subset=["text", "lang"])(df)


@query("dedup_exact", "SELECT DISTINCT p_name, p_brand FROM part")
def _(spark, d):
    df = table(spark, d, "part").select("p_name", "p_brand")
    return fit("deduplication", "exact", df, Roles())(df)


@query(
    "dup_token_jaccard",
    """WITH t AS (SELECT p_partkey AS k, list_distinct(list_filter(string_split_regex(trim(p_name || '*' || p_type), '\\s+'), lambda x: x <> '')) AS w FROM part),
    u AS (SELECT k, len(w) AS n, unnest(w) AS x FROM t),
    p AS (SELECT a.k AS a, b.k AS b, min(a.n) AS na, min(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.k < b.k GROUP BY 1, 2)
    SELECT DISTINCT b AS p_partkey FROM p WHERE c >= 0.6 * (na + nb - c) - 1e-9""",
)
def _(spark, d):
    return duplicates.token_duplicates(table(spark, d, "part"), "p_partkey", ["p_name", "p_type"], 0.6)


@query("dup_levenshtein", "SELECT DISTINCT b.c_custkey AS c_custkey FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey WHERE levenshtein(a.c_name, b.c_name) < (length(a.c_name) + length(b.c_name) / 2.0) * 0.05")
def _(spark, d):
    return duplicates.edit_duplicates(table(spark, d, "customer"), "c_custkey", "c_name", 0.05, "lm")


@query("dup_damerau", "SELECT DISTINCT b.s_suppkey AS s_suppkey FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE damerau_levenshtein(a.s_name, b.s_name) < (length(a.s_name) + length(b.s_name) / 2.0) * 0.05")
def _(spark, d):
    return duplicates.edit_duplicates(table(spark, d, "supplier"), "s_suppkey", "s_name", 0.05, "dl")


@query("dup_jaro_winkler", "SELECT DISTINCT b.s_suppkey AS s_suppkey FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE 1 - jaro_winkler_similarity(a.s_name, b.s_name) < (length(a.s_name) + length(b.s_name) / 2.0) * 0.001")
def _(spark, d):
    return duplicates.edit_duplicates(table(spark, d, "supplier"), "s_suppkey", "s_name", 0.001, "jw")


_HIGH = "l_returnflag = 'R' AND l_linestatus IN ('F', 'O')"


@query("branch_apply", f"WITH g AS (SELECT {_KEY} AS rid, l_quantity AS qty, l_returnflag, l_linestatus FROM lineitem) SELECT rid, CASE WHEN {_HIGH} THEN qty * 2 ELSE qty END AS qty, l_returnflag, l_linestatus FROM g")
def _(spark, d):
    df = table(spark, d, "lineitem").select(F.expr(_KEY).alias("rid"), F.col("l_quantity").alias("qty"), "l_returnflag", "l_linestatus")
    return branch(df, {"l_returnflag": "R", "l_linestatus": ["F", "O"]}, lambda x: x.withColumn("qty", F.col("qty") * 2))


@query("branch_rows", f"SELECT rid, qty FROM (SELECT {_KEY} AS rid, l_quantity AS qty, l_discount FROM lineitem) WHERE NOT (l_discount > 0.05) OR qty > 25")
def _(spark, d):
    df = table(spark, d, "lineitem").select(F.expr(_KEY).alias("rid"), F.col("l_quantity").alias("qty"), "l_discount")
    return branch(df, "l_discount > 0.05", lambda x: x.where("qty > 25"), keeps_rows=False).select("rid", "qty")


_FLAG_SQL = f"""
WITH g AS ({_GAPS}), m AS (SELECT avg(qty) AS mq, avg(price) AS mp FROM g),
f AS (SELECT rid, coalesce(qty, mq) AS qty, coalesce(price, mp) AS price, disc FROM g, m),
z AS (SELECT avg(qty) AS aq, stddev_pop(qty) AS sq, avg(price) AS ap, stddev_pop(price) AS sp, avg(disc) AS ad, stddev_pop(disc) AS sd FROM f),
n AS (SELECT rid, (qty - aq) / sq AS qty, (price - ap) / sp AS price, (disc - ad) / sd AS disc FROM f, z),
q AS ({_FENCE} FROM n)
SELECT count(*) AS n, round(avg(qty), 6) AS qty, round(avg(price), 6) AS price, round(avg(disc), 6) AS disc FROM n, q WHERE {' AND '.join(_IN.format(c=c) for c in ('qty', 'price', 'disc'))}"""


@query("flagship_cleaning_plan", _FLAG_SQL)
def _(spark, d):
    df = gaps(spark, d).drop("flag")
    plan = Plan((("missing_value", "mean"), ("normalization", "ss"), ("outlier", "iqr")))
    out = Executor(df, ROLES).run(plan)
    return out.agg(F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in ("qty", "price", "disc")))
