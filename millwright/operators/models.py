"""Terminal operators: models fitted and evaluated on the frame they get, and clustering."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..data import Roles, numeric_columns
from ..functions.graph import components
from ..functions.profile import utility
from ..functions.quantiles import quantiles
from .features import moment_matrix

#: mnb: multinomial naive Bayes on numbers of 0 or more; mars: a lasso on hinges at the quartiles of each number.
FAMILIES = ("lr", "nb", "mnb", "rf", "dt", "svm", "nn", "reg", "lasso", "mars")

#: Distinct rows of a task of a weighed fit: each of its passes is a job, which for few rows takes longer than the rows do.
TASK_ROWS = 100_000
#: Families whose loss adds up over the rows, so that equal rows can be one row of their number as weight.
WEIGHED = ("lr",)


def _estimator(family: str, label: str, width: int, classes: int, seed: int):
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    return {
        "lr": lambda: C.LogisticRegression(labelCol=label, maxIter=50),
        "nb": lambda: C.NaiveBayes(labelCol=label, modelType="gaussian"),
        "mnb": lambda: C.NaiveBayes(labelCol=label, modelType="multinomial"),
        "mars": lambda: R.LinearRegression(labelCol=label, elasticNetParam=1.0, regParam=0.001),
        "rf": lambda: C.RandomForestClassifier(labelCol=label, numTrees=20, seed=seed),
        "dt": lambda: C.DecisionTreeClassifier(labelCol=label, seed=seed),
        "svm": lambda: C.LinearSVC(labelCol=label, maxIter=30),
        "nn": lambda: C.MultilayerPerceptronClassifier(labelCol=label, layers=[width, 16, max(2, classes)], maxIter=50, seed=seed),
        "reg": lambda: R.LinearRegression(labelCol=label),
        "lasso": lambda: R.LinearRegression(labelCol=label, elasticNetParam=1.0, regParam=0.01),
    }[family]()


def predict(df: DataFrame, roles: Roles, family: str = "lr", train: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """df without rows that miss a value, and `prediction`; fitted on the same rows unless train is given."""
    from pyspark.ml.feature import VectorAssembler

    features = numeric_columns(df, roles)
    bent: dict = {}
    if family == "mars":
        for c, knots in quantiles(df if train is None else train, features, [0.25, 0.5, 0.75]).items():
            for i, q in enumerate(sorted({q for q in knots if q is not None})):
                bent |= {f"_up_{c}_{i}": F.greatest(F.col(c) - q, F.lit(0.0)), f"_down_{c}_{i}": F.greatest(q - F.col(c), F.lit(0.0))}
    build = VectorAssembler(inputCols=list(bent) or features, outputCol="_features")
    ready = lambda d: build.transform(d.dropna(subset=[*features, roles.target]).withColumns(bent | {"_label": F.col(roles.target).cast("double")}))
    data, fit_on = ready(df), ready(df if train is None else train)
    classes = int(fit_on.agg(F.max("_label")).first()[0]) + 1 if family == "nn" else 0
    model = _estimator(family, "_label", len(features), classes, seed).setFeaturesCol("_features").fit(fit_on)
    return model.transform(data).select(*df.columns, "prediction")


def _weighed(df: DataFrame, roles: Roles, family: str, metric: str) -> float:
    """evaluate() by one pass over the rows: the model and its metric get each distinct row once, with its number as weight."""
    from pyspark.ml.feature import VectorAssembler

    names = numeric_columns(df, roles)
    used = list(dict.fromkeys(c for c in (*names, roles.target, roles.sensitive) if c))
    rows = df.select(*used).dropna(subset=[*names, roles.target]).groupBy(*used).agg(F.count(F.lit(1)).alias("_n")).cache()
    try:
        few = rows.coalesce(max(1, -(-rows.count() // TASK_ROWS)))
        data = VectorAssembler(inputCols=names, outputCol="_features").transform(few.withColumns({"_label": F.col(roles.target).cast("double"), "_weight": F.col("_n").cast("double")}))
        model = _estimator(family, "_label", len(names), 0, 0).setFeaturesCol("_features").setWeightCol("_weight").fit(data)
        return utility(model.transform(data), metric, roles.target, "prediction", roles.sensitive, "_n")
    finally:
        rows.unpersist()


def evaluate(df: DataFrame, roles: Roles, family: str = "lr", metric: str = "accuracy_score", train: DataFrame | None = None) -> float:
    """The utility of a fitted model, lower is better."""
    if train is None and family in WEIGHED:
        return _weighed(df, roles, family, metric)
    return utility(predict(df, roles, family, train), metric, roles.target, "prediction", roles.sensitive)


def cross_validate(df: DataFrame, roles: Roles, family: str = "lr", metric: str = "accuracy_score", folds: int = 5, seed: int = 42) -> list[float]:
    """The utility on each of a number of held-out parts, dealt by a hash of the row id, of models fitted on the others."""
    part = F.pmod(F.xxhash64(F.col(roles.row_id).cast("string"), F.lit(seed)), F.lit(folds))
    return [evaluate(df.where(part == k), roles, family, metric, train=df.where(part != k)) for k in range(folds)]


def least_squares(df: DataFrame, features: list[str], target: str, ridge: float = 0.0) -> tuple[float, dict[str, float]]:
    """Intercept and coefficients from one aggregation of moments."""
    mean, cov, _ = moment_matrix(df, [*features, target])
    n = len(features)
    beta = np.linalg.lstsq(cov[:n, :n] + ridge * np.eye(n), cov[:n, n], rcond=None)[0]
    return float(mean[n] - beta @ mean[:n]), dict(zip(features, map(float, beta), strict=True))


def elastic_net(x: np.ndarray, y: np.ndarray, ratios=(0.1, 0.5, 0.9), alphas: int = 30, folds: int = 5, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Intercept and coefficients on history tables (small): coordinate descent, the penalty chosen by cross validation."""
    def solve(a: np.ndarray, b: np.ndarray, alpha: float, ratio: float, w: np.ndarray) -> np.ndarray:
        square, rest = (a * a).mean(0), b - a @ w
        for _ in range(rounds):
            old = w.copy()
            for j in range(a.shape[1]):
                if square[j]:
                    rho = (a[:, j] * rest).mean() + square[j] * w[j]
                    new = np.sign(rho) * max(abs(rho) - alpha * ratio, 0) / (square[j] + alpha * (1 - ratio))
                    rest += a[:, j] * (w[j] - new)
                    w[j] = new
            if np.abs(w - old).max(initial=0) < 1e-8:
                break
        return w

    n = len(y)
    mx, my = x.mean(0), y.mean()
    top = max(np.abs((x - mx).T @ (y - my)).max(initial=0) / max(n, 1), 1e-12)
    best = (np.inf, 0.0, 0.5)
    fold = np.arange(n) % min(folds, max(n, 2))
    for ratio in ratios:
        grid = top / ratio * np.logspace(0, -3, alphas)
        error = np.zeros(alphas)
        for f in np.unique(fold):
            tr, te = fold != f, fold == f
            if not tr.any():
                continue
            m, c, w = x[tr].mean(0), y[tr].mean(), np.zeros(x.shape[1])
            for k, alpha in enumerate(grid):
                w = solve(x[tr] - m, y[tr] - c, alpha, ratio, w)
                error[k] += ((y[te] - c - (x[te] - m) @ w) ** 2).sum()
        k = int(error.argmin())
        if error[k] < best[0]:
            best = (error[k], grid[k], ratio)
    w = solve(x - mx, y - my, best[1], best[2], np.zeros(x.shape[1]))
    return float(my - mx @ w), w


def multinomial_importance(df: DataFrame, features: list[str], target: str) -> list[tuple[str, float]]:
    """Features by the mean magnitude of their multinomial coefficients."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    data = StringIndexer(inputCol=target, outputCol="_y").fit(df).transform(df.dropna(subset=[*features, target]))
    model = LogisticRegression(labelCol="_y", family="multinomial", maxIter=50).fit(VectorAssembler(inputCols=features, outputCol="features").transform(data))
    weight = np.abs(model.coefficientMatrix.toArray()).mean(0)
    return sorted(zip(features, map(float, weight), strict=True), key=lambda x: (-x[1], x[0]))


def lda(df: DataFrame, roles: Roles) -> DataFrame:
    """Linear discriminant with a shared covariance, from one grouped aggregation; adds prediction."""
    names = numeric_columns(df, roles)
    rows = df.dropna(subset=[*names, roles.target])
    stats = rows.groupBy(roles.target).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(names)), *(F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i)).orderBy(roles.target).collect()
    total = sum(r["n"] for r in stats)
    cov = np.zeros((len(names), len(names)))
    for r in stats:
        for i in range(len(names)):
            for j in range(i, len(names)):
                v = r["n"] / total * r[f"c{i}_{j}"]
                cov[i, j] += v
                cov[j, i] += v if i != j else 0
    inv = np.linalg.pinv(cov)
    score = []
    for r in stats:
        m = np.array([r[f"m{i}"] for i in range(len(names))])
        w, b = inv @ m, -0.5 * m @ inv @ m + np.log(r["n"] / total)
        score.append(F.struct((sum((F.lit(float(x)) * F.col(c) for x, c in zip(w, names, strict=True)), F.lit(float(b)))).alias("s"), F.lit(r[roles.target]).alias("c")))
    return rows.withColumn("prediction", F.array_max(F.array(*score))["c"])


def kmeans(df: DataFrame, columns: list[str], ks=(2, 3, 4, 5), seed: int = 42) -> tuple[DataFrame, int]:
    """df with `cluster` for the number of clusters of best silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna(subset=columns)).cache()
    best = None
    for k in ks:
        out = KMeans(k=k, seed=seed, predictionCol="cluster").fit(data).transform(data)
        s = ClusteringEvaluator(predictionCol="cluster").evaluate(out) if out.select("cluster").distinct().count() > 1 else -1.0
        if best is None or s > best[0]:
            best = (s, out, k)
    data.unpersist()
    return best[1].drop("features"), best[2]


def bisecting(df: DataFrame, columns: list[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Divisive hierarchical clusters."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=columns, outputCol="features").transform(df.dropna(subset=columns))
    return BisectingKMeans(k=k, seed=seed, predictionCol="cluster").fit(data).transform(data).drop("features")


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, least: int) -> DataFrame:
    """(key, cluster): density clusters; the cluster is the smallest core key, -1 is noise.

    Rows meet through a grid of cells of side eps, so only neighbouring cells
    are joined; linked core rows become components by contraction, in a number
    of rounds that grows with the logarithm of a cluster's diameter.
    """
    cells = [F.floor(F.col(c) / eps).cast("long") for c in columns]
    rows = df.select(F.col(key).alias("id"), *(F.col(c).cast("double").alias(c) for c in columns), F.array(*cells).alias("_cell")).dropna(subset=columns)
    around = F.array(*(F.array(*(F.get("_cell", F.lit(i)) + step for i, step in enumerate(way))) for way in itertools.product((-1, 0, 1), repeat=len(columns))))
    a = rows.select(F.col("id").alias("a"), *(F.col(c).alias(f"_a{i}") for i, c in enumerate(columns)), F.explode(around).alias("_cell"))
    b = rows.select(F.col("id").alias("b"), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(columns)), "_cell")
    square = sum(((F.col(f"_a{i}") - F.col(f"_b{i}")) ** 2 for i in range(len(columns))), F.lit(0.0))
    near = a.join(b, "_cell").where(square <= eps * eps).select("a", "b")
    core = near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("a").alias("id"))
    links = near.join(core, F.col("a") == F.col("id"), "left_semi")
    inner = links.join(core, F.col("b") == F.col("id"), "left_semi")
    label = components(inner, core).withColumnRenamed("root", "cluster")
    border = links.join(label, F.col("a") == F.col("id")).groupBy(F.col("b").alias("id")).agg(F.min("cluster").alias("cluster"))
    return rows.select("id").join(border, "id", "left").select(F.col("id").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
