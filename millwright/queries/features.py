"""Queries of selection, encoding, binning, polynomials, sampling and noise, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..data import Roles, table
from ..operators import features, noise, sampling
from ..operators.base import fit
from .preparation import _NUMS, ROLES, nums, rounded
from .registry import query


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


_ORD = "SELECT o_orderkey AS rid, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price FROM orders"


@query("encode_label", f"WITH g AS ({_ORD}), v AS (SELECT status, CAST(row_number() OVER (ORDER BY status) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT status FROM g)), w AS (SELECT priority, CAST(row_number() OVER (ORDER BY priority) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT priority FROM g)) SELECT g.*, v.code AS status__le, w.code AS priority__le FROM g JOIN v USING (status) JOIN w USING (priority)")
def _(spark, d):
    df = _orders(spark, d)
    return fit("encoding", "label_encoder", df, ROLES)(df)


@query("encode_label_unseen", f"WITH g AS ({_ORD}), v AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS code FROM (SELECT DISTINCT status FROM g WHERE price < 1000)) SELECT g.*, CAST(coalesce(v.code, -1) AS INTEGER) AS status__le FROM g LEFT JOIN v USING (status)")
def _(spark, d):
    df = _orders(spark, d)
    return fit("encoding", "label_encoder", df.where("price < 1000"), ROLES, columns=["status"])(df)


@query("encode_onehot", f"SELECT rid, price, priority, CAST(status = 'F' AS INTEGER) AS \"status_F\", CAST(status = 'O' AS INTEGER) AS \"status_O\", CAST(status = 'P' AS INTEGER) AS \"status_P\" FROM ({_ORD})")
def _(spark, d):
    df = _orders(spark, d)
    return fit("encoding", "onehot", df, ROLES, columns=["status"])(df)


@query("encode_label_binarizer", f"SELECT rid, price, priority, CAST(status = 'O' AS INTEGER) AS \"status_O\", CAST(status = 'P' AS INTEGER) AS \"status_P\" FROM ({_ORD})")
def _(spark, d):
    df = _orders(spark, d)
    return fit("encoding", "label_binarizer", df, ROLES, columns=["status"])(df)


@query("encode_binarizer", f"SELECT rid, status, priority, CASE WHEN price > 1000 THEN 1 WHEN price IS NOT NULL THEN 0 END AS price FROM ({_ORD})")
def _(spark, d):
    df = _orders(spark, d)
    return fit("encoding", "binarizer", df, ROLES, threshold=1000.0)(df)


@query("encode_frequency", f"WITH g AS ({_ORD}), f AS (SELECT status, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM g) AS s FROM g GROUP BY status) SELECT g.*, round(f.s, 6) AS status__freq FROM g JOIN f USING (status)")
def _(spark, d):
    df = _orders(spark, d)
    return rounded(fit("encoding", "frequency", df, ROLES, columns=["status"])(df), "status__freq")


@query("encode_low_cardinality", "WITH v AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS code FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS x FROM part)), b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey AS rid, p_size, part.p_brand, CAST(b.code AS INTEGER) AS p_brand__le, CAST(v.code AS INTEGER) AS p_size__le FROM part JOIN v ON v.x = CAST(p_size AS VARCHAR) JOIN b ON b.p_brand = part.p_brand")
def _(spark, d):
    df = table(spark, d, "part").select(F.col("p_partkey").alias("rid"), "p_size", "p_brand")
    return fit("encoding", "label_encoder", df, ROLES, cat_max_unique=60)(df)


@query("encode_kbins", "WITH q AS (SELECT quantile_cont(p_retailprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM part), b AS (SELECT p_partkey AS rid, p_retailprice AS price, CAST(p_retailprice >= q[1] AS INTEGER) + CAST(p_retailprice >= q[2] AS INTEGER) + CAST(p_retailprice >= q[3] AS INTEGER) + CAST(p_retailprice >= q[4] AS INTEGER) AS b FROM part, q) SELECT rid, price, CAST(b = 0 AS INTEGER) AS price_bin0, CAST(b = 1 AS INTEGER) AS price_bin1, CAST(b = 2 AS INTEGER) AS price_bin2, CAST(b = 3 AS INTEGER) AS price_bin3, CAST(b = 4 AS INTEGER) AS price_bin4 FROM b")
def _(spark, d):
    df = table(spark, d, "part").select(F.col("p_partkey").alias("rid"), F.col("p_retailprice").alias("price"))
    return fit("encoding", "kbins", df, ROLES)(df)


@query("bin_uniform", f"WITH g AS ({_NUMS}), s AS (SELECT min(price) AS a, max(price) AS b FROM g) SELECT rid, price, CAST(price >= a + (b - a) * 1 / 5 AS INTEGER) + CAST(price >= a + (b - a) * 2 / 5 AS INTEGER) + CAST(price >= a + (b - a) * 3 / 5 AS INTEGER) + CAST(price >= a + (b - a) * 4 / 5 AS INTEGER) AS price_binned FROM g, s")
def _(spark, d):
    df = nums(spark, d).select("rid", "price")
    return fit("binning", "uniform", df, ROLES)(df)


@query("bin_quantile", f"WITH g AS ({_NUMS}), s AS (SELECT quantile_cont(price, [0.2, 0.4, 0.6, 0.8]) AS q FROM g) SELECT rid, price, CAST(price >= q[1] AS INTEGER) + CAST(price >= q[2] AS INTEGER) + CAST(price >= q[3] AS INTEGER) + CAST(price >= q[4] AS INTEGER) AS price_binned FROM g, s")
def _(spark, d):
    df = nums(spark, d).select("rid", "price")
    return fit("binning", "quantile", df, ROLES)(df)


@query("bin_kmeans")
def _(spark, d):
    df = nums(spark, d).select("rid", "price")
    return fit("binning", "kmeans", df, ROLES)(df)


@query("bucket_thresholds", "SELECT o_orderkey AS rid, CASE WHEN o_totalprice >= 2000 THEN 'high' WHEN o_totalprice >= 1000 THEN 'middle' ELSE 'low' END AS band FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.when(F.col("o_totalprice") >= 2000, "high").when(F.col("o_totalprice") >= 1000, "middle").otherwise("low").alias("band"))


@query("select_missing_ratio", "WITH g AS (SELECT CASE WHEN l_orderkey % 2 = 0 OR l_orderkey % 3 = 0 THEN NULL ELSE l_quantity END AS a, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_discount END AS b FROM lineitem) SELECT round(avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0.0 END), 6) AS a, round(avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0.0 END), 6) AS b, avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0.0 END) > 0.4 AS a_dropped, avg(CASE WHEN b IS NULL THEN 1.0 ELSE 0.0 END) > 0.4 AS b_dropped FROM g")
def _(spark, d):
    df = table(spark, d, "lineitem").selectExpr("CASE WHEN l_orderkey % 2 <> 0 AND l_orderkey % 3 <> 0 THEN l_quantity END AS a", "CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS b")
    got = fit("fselection", "missing_ratio", df, Roles()).statistics
    return spark.createDataFrame([(round(got["scores"]["a"], 6), round(got["scores"]["b"], 6), "a" in got["dropped"], "b" in got["dropped"])], "a double, b double, a_dropped boolean, b_dropped boolean")


@query("select_variance", "SELECT round(var_pop(l_quantity), 4) AS qty, round(var_pop(l_discount), 6) AS disc, var_pop(l_quantity) <= 0.01 AS qty_dropped, var_pop(l_discount) <= 0.01 AS disc_dropped FROM lineitem")
def _(spark, d):
    df = nums(spark, d).select("qty", "disc")
    got = fit("fselection", "variance", df, Roles()).statistics
    return spark.createDataFrame([(round(got["scores"]["qty"], 4), round(got["scores"]["disc"], 6), "qty" in got["dropped"], "disc" in got["dropped"])], "qty double, disc double, qty_dropped boolean, disc_dropped boolean")


@query("select_collinear", f"SELECT rid, qty, disc FROM ({_NUMS})")
def _(spark, d):
    df = nums(spark, d).select("rid", "qty", (F.col("qty") * 3 + 1).alias("copy"), "disc")
    return fit("fselection", "collinear", df, ROLES, threshold=0.95)(df)


@query("vif_keep", f"SELECT rid, qty, disc, price FROM ({_NUMS})")
def _(spark, d):
    df = nums(spark, d).withColumn("zmix", F.col("disc") * 7 + 2)
    df = df.select("rid", "zmix", "qty", "disc", "price")
    kept = fit("multicollinearity", "drop_high_vif", df, ROLES)(df)
    return kept.select("rid", "qty", *(F.col(c).alias("disc") if c == "disc" else ((F.col(c) - 2) / 7).alias("disc") for c in kept.columns if c in ("disc", "zmix")), "price").withColumn("disc", F.round("disc", 2))


@query(
    "select_chi2",
    "WITH g AS (SELECT CASE l_returnflag WHEN 'R' THEN 1 ELSE 0 END AS y, l_quantity AS qty, l_discount AS disc FROM lineitem), c AS (SELECT y, count(*) AS n, sum(qty) AS q, sum(disc) AS d FROM g GROUP BY y), t AS (SELECT sum(n) AS n, sum(q) AS q, sum(d) AS d FROM c) SELECT round(sum(pow(c.q - t.q * c.n / t.n, 2) / (t.q * c.n / t.n)), 4) AS qty, round(sum(pow(c.d - t.d * c.n / t.n, 2) / (t.d * c.n / t.n)), 4) AS disc FROM c, t",
)
def _(spark, d):
    df = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"))
    got = fit("fselection", "chi2", df, Roles(target="y")).statistics["scores"]
    return spark.createDataFrame([(round(got["qty"], 4), round(got["disc"], 4))], "qty double, disc double")


@query("select_f_regression", "WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS q, corr(l_discount, l_extendedprice) AS d, count(*) AS n FROM lineitem) SELECT round(q * q / (1 - q * q) * (n - 2), 3) AS qty, round(d * d / (1 - d * d) * (n - 2), 3) AS disc FROM r")
def _(spark, d):
    got = features.f_regression(nums(spark, d), "price", ["qty", "disc"])
    return spark.createDataFrame([(round(got["qty"], 3), round(got["disc"], 3))], "qty double, disc double")


def _bins(c: str) -> str:
    return " + ".join(f"CAST({c} >= quantile_{c}[{i}] AS INTEGER)" for i in range(1, 10))


def _edges(c: str) -> str:
    return f"(SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS quantile_{c} FROM g)"


def _mi(c: str) -> str:
    return f"(SELECT sum(n / t * ln(n * t / (na * nb))) FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM (SELECT {c}_b AS a, price_b AS b, CAST(count(*) AS DOUBLE) AS n FROM k GROUP BY 1, 2)))"


@query("select_mutual_info", f"WITH g AS ({_NUMS}), k AS (SELECT {_bins('qty')} AS qty_b, {_bins('disc')} AS disc_b, {_bins('price')} AS price_b FROM g, {_edges('qty')}, {_edges('disc')}, {_edges('price')}) SELECT 'qty' AS name, round({_mi('qty')}, 6) AS score UNION ALL SELECT 'disc', round({_mi('disc')}, 6)")
def _(spark, d):
    got = features.mutual_information(nums(spark, d), "price", ["qty", "disc"])
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(got.items())], "name string, score double")


@query("select_tree")
def _(spark, d):
    df = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.col("l_quantity").alias("qty"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"))
    got = fit("fselection", "tree", df, Roles(target="y")).statistics["weights"]
    return spark.createDataFrame(sorted(got.items()), "name string, weight double")


@query("poly_degree2", f"SELECT rid, qty, disc, round(qty * qty, 6) AS qty_x_qty, round(qty * disc, 6) AS qty_x_disc, round(disc * disc, 6) AS disc_x_disc FROM ({_NUMS})")
def _(spark, d):
    df = nums(spark, d).select("rid", "qty", "disc")
    return rounded(fit("poly_pca", "poly", df, ROLES)(df), "qty_x_qty", "qty_x_disc", "disc_x_disc")


for _s in ("pca", "sparsepca", "minibatchsparsepca", "kernelpca"):

    @query(f"poly_{_s}")
    def _(spark, d, s=_s):
        df = nums(spark, d)
        return fit("poly_pca", s, df, ROLES, k=2)(df)


_LOT = "md5(CAST({} AS VARCHAR) || '#42')"


@query("sample_snapshot", "SELECT o_orderkey AS rid, o_totalprice AS price FROM orders ORDER BY o_orderkey LIMIT (SELECT CAST(ceil(0.1 * count(*)) AS BIGINT) FROM orders)")
def _(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.col("o_totalprice").alias("price"))
    return fit("sampling", "snapshot", df, ROLES, fraction=0.1)(df)


@query("sample_random", f"SELECT o_orderkey AS rid, o_totalprice AS price FROM orders ORDER BY {_LOT.format('o_orderkey')}, o_orderkey LIMIT (SELECT CAST(ceil(0.3 * count(*)) AS BIGINT) FROM orders)")
def _(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.col("o_totalprice").alias("price"))
    return fit("sampling", "random", df, ROLES)(df)


@query("sample_stratified", f"WITH n AS (SELECT least(100, min(n)) AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)), r AS (SELECT o_orderkey AS rid, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_LOT.format('o_orderkey')}, o_orderkey) AS k FROM orders) SELECT rid, priority FROM r, n WHERE k <= n.n")
def _(spark, d):
    df = _orders(spark, d).select("rid", "priority")
    return fit("sampling", "stratified", df, ROLES, by="priority", cap=100)(df)


@query("split_random", f"WITH r AS (SELECT o_orderkey AS rid, row_number() OVER (ORDER BY {_LOT.format('o_orderkey')}, o_orderkey) AS k, (SELECT count(*) FROM orders) AS n FROM orders) SELECT rid, CASE WHEN k <= floor(0.2 * n + 0.5) THEN 'test' ELSE 'train' END AS part FROM r")
def _(spark, d):
    return sampling.split(_orders(spark, d).select("rid"), ROLES)


@query("split_stratified", f"WITH r AS (SELECT o_orderkey AS rid, o_orderstatus AS status, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_LOT.format('o_orderkey')}, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT rid, status, CASE WHEN k <= floor(n * 0.2 + 0.5) THEN 'test' ELSE 'train' END AS part FROM r")
def _(spark, d):
    return sampling.split(_orders(spark, d).select("rid", "status"), ROLES, by="status")


@query("resample_ratio", f"WITH n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)), r AS (SELECT o_orderkey AS rid, o_orderstatus AS status, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_LOT.format('o_orderkey')}, o_orderkey) AS k FROM orders) SELECT rid, status FROM r, n WHERE k <= ceil(1.5 * n.n)")
def _(spark, d):
    df = _orders(spark, d).select("rid", "status")
    return fit("resampling", "minority_ratio", df, Roles(row_id="rid", target="status"), ratio=1.5)(df)


_CLS = "SELECT s_suppkey AS rid, CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS y, CAST(s_nationkey AS DOUBLE) AS a, CAST(s_suppkey % 13 AS DOUBLE) AS b FROM supplier"


def _cls(spark, d):
    return table(spark, d, "supplier").selectExpr("s_suppkey AS rid", "CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS y", "CAST(s_nationkey AS DOUBLE) AS a", "CAST(s_suppkey % 13 AS DOUBLE) AS b")


@query(
    "allknn",
    f"""WITH g AS ({_CLS}), mn AS (SELECT y FROM g GROUP BY y ORDER BY count(*), CAST(y AS VARCHAR) LIMIT 1),
    p1 AS (SELECT a.rid AS ask, a.y AS ya, b.y AS yb, row_number() OVER (PARTITION BY a.rid ORDER BY round(sqrt((a.a-b.a)*(a.a-b.a)+(a.b-b.b)*(a.b-b.b)), 9), b.rid) AS k FROM g a, g b, mn WHERE a.rid <> b.rid AND a.y <> mn.y),
    g1 AS (SELECT * FROM g WHERE rid NOT IN (SELECT ask FROM p1 WHERE k <= 1 AND ya <> yb)),
    p2 AS (SELECT a.rid AS ask, a.y AS ya, b.y AS yb, row_number() OVER (PARTITION BY a.rid ORDER BY round(sqrt((a.a-b.a)*(a.a-b.a)+(a.b-b.b)*(a.b-b.b)), 9), b.rid) AS k FROM g1 a, g1 b, mn WHERE a.rid <> b.rid AND a.y <> mn.y)
    SELECT * FROM g1 WHERE rid NOT IN (SELECT ask FROM p2 WHERE k <= 2 AND ya <> yb)""",
)
def _(spark, d):
    df = _cls(spark, d)
    return fit("undersampling", "allknn", df, Roles(row_id="rid", target="y"), k=2)(df)


@query("smote")
def _(spark, d):
    df = _cls(spark, d)
    return fit("oversampling", "smote", df, Roles(row_id="rid", target="y"))(df)


_PICK = f"SELECT o_orderkey AS rid FROM orders ORDER BY {_LOT.format('o_orderkey')}, o_orderkey LIMIT (SELECT greatest(1, CAST(ceil(0.1 * count(*)) AS BIGINT)) FROM orders)"


@query("noise_missing", f"WITH p AS ({_PICK}) SELECT g.rid, status, priority, CASE WHEN p.rid IS NULL THEN price END AS price FROM ({_ORD}) g LEFT JOIN p ON p.rid = g.rid")
def _(spark, d):
    return noise.missing(_orders(spark, d), ROLES)


@query("noise_outlier", f"WITH p AS ({_PICK}), q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders) SELECT g.rid, status, priority, round(CASE WHEN p.rid IS NULL THEN price ELSE a - 5 * (b - a) END, 4) AS price FROM q, ({_ORD}) g LEFT JOIN p ON p.rid = g.rid")
def _(spark, d):
    return rounded(noise.outliers(_orders(spark, d), ROLES), "price", digits=4)


@query("noise_invalid", f"WITH p AS ({_PICK}) SELECT g.rid, CASE WHEN p.rid IS NULL THEN status ELSE 'unknown' END AS status, priority, CASE WHEN p.rid IS NULL THEN price ELSE -999.0 END AS price FROM ({_ORD}) g LEFT JOIN p ON p.rid = g.rid")
def _(spark, d):
    return noise.invalid(_orders(spark, d), ROLES)


@query("noise_duplicates", f"WITH p AS ({_PICK}) SELECT * FROM ({_ORD}) UNION ALL SELECT g.* FROM ({_ORD}) g JOIN p ON p.rid = g.rid")
def _(spark, d):
    return noise.duplicate_rows(_orders(spark, d), ROLES)


@query("noise_class_imbalance", f"WITH g AS (SELECT o_orderkey AS rid, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, o_totalprice AS price FROM orders), p AS ({_PICK.replace('0.1 *', '0.2 *')}), q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM g) SELECT g.rid, CASE WHEN p.rid IS NOT NULL OR price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a) THEN 1 - y ELSE y END AS y, price FROM q, g LEFT JOIN p ON p.rid = g.rid")
def _(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), F.col("o_totalprice").alias("price"))
    return noise.class_imbalance(df, Roles(row_id="rid", target="y"))


@query(
    "noise_shape",
    "WITH g AS (SELECT o_orderkey AS rid, o_totalprice AS p FROM orders), s AS (SELECT avg(p) AS m, stddev_pop(p) AS s FROM g), w AS (SELECT rid, exp((p - m) / s) AS e FROM g, s), t AS (SELECT avg(e) AS em, stddev_pop(e) AS es FROM w) SELECT rid, round((e - em) / es * s + m, 4) AS price FROM w, s, t",
)
def _(spark, d):
    return rounded(noise.distribution_shape(_orders(spark, d).select("rid", "price"), ROLES, "exp"), "price", digits=4)


@query("noise_float")
def _(spark, d):
    return noise.floating_point(_orders(spark, d), ROLES)


@query("noise_collinear")
def _(spark, d):
    return noise.multicollinearity(nums(spark, d), ROLES, "qty", "price")


@query("noise_then_clean", f"WITH p AS ({_PICK}) SELECT g.rid, CASE WHEN p.rid IS NULL THEN status END AS status, priority, CASE WHEN p.rid IS NULL THEN price END AS price FROM ({_ORD}) g LEFT JOIN p ON p.rid = g.rid")
def _(spark, d):
    hurt = noise.inject(_orders(spark, d), ROLES, ["invalid_value"])
    return fit("invalid_value", "both", hurt, ROLES)(hurt)
