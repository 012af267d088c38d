"""Collinearity, feature selection, encoding, binning, polynomials and reducers."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..data import Roles, numeric_columns, text_columns
from ..functions.profile import f_tail
from ..functions.quantiles import quantiles
from .base import Fitted, columnwise, step


def moment_matrix(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, population covariances and the row count of all columns, from one aggregation over complete rows."""
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    got = rows.agg(F.count(F.lit(1)), *(F.avg(c) for c in columns), *(F.covar_pop(columns[i], columns[j]) for i, j in pairs)).first()
    mean = np.array([np.nan if x is None else x for x in got[1 : len(columns) + 1]], float)
    cov = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, got[len(columns) + 1 :], strict=True):
        cov[i, j] = cov[j, i] = np.nan if v is None else v
    return mean, cov, got[0]


def correlations(df: DataFrame, columns: list[str]) -> np.ndarray:
    _, cov, _ = moment_matrix(df, columns)
    s = np.sqrt(np.diag(cov))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((s[:, None] > 0) & (s[None, :] > 0), cov / np.outer(s, s), np.where(np.eye(len(columns)) > 0, 1.0, 0.0))


def inflation(corr: np.ndarray) -> np.ndarray:
    """Variance inflation of each column; the share explained by the others is capped just below 1."""
    out = []
    for i in range(len(corr)):
        rest = [j for j in range(len(corr)) if j != i]
        r2 = corr[i, rest] @ np.linalg.pinv(corr[np.ix_(rest, rest)]) @ corr[rest, i] if rest else 0.0
        out.append(1 / (1 - min(max(r2, 0.0), 0.999999999)))
    return np.array(out)


@step("multicollinearity", "drop_high_vif", "none")
def drop_collinear(df: DataFrame, roles: Roles = Roles(), strategy: str = "drop_high_vif", limit: float = 10.0, rounds: int = 50, least: int = 2, columns: list[str] | None = None) -> Fitted:
    """Drops the column of largest inflation while it exceeds the limit; the correlations are aggregated once."""
    names = list(columns or numeric_columns(df, roles))
    if strategy == "none" or len(names) < 2:
        return Fitted(lambda d: d)
    corr, dropped = correlations(df, names), []
    for _ in range(rounds):
        left = [i for i, c in enumerate(names) if c not in dropped]
        if len(left) <= least:
            break
        vif = inflation(corr[np.ix_(left, left)])
        if vif.max() <= limit:
            break
        dropped.append(names[left[int(vif.argmax())]])
    return Fitted(lambda d: d.drop(*dropped), {"dropped": dropped})


def missing_ratios(df: DataFrame) -> dict[str, float]:
    row = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns)).first()
    return {c: row[c] or 0.0 for c in df.columns}


def chi2_scores(df: DataFrame, target: str, columns: list[str]) -> dict[str, float]:
    """Chi-squared of the class sums of each non-negative column against those expected from the class sizes."""
    rows = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).cast("double").alias(c) for c in columns)).collect()
    n = sum(r["_n"] for r in rows)
    out = {}
    for c in columns:
        total = sum(r[c] or 0.0 for r in rows)
        out[c] = sum(((r[c] or 0.0) - total * r["_n"] / n) ** 2 / (total * r["_n"] / n) for r in rows) if total else float("nan")
    return out


def f_regression(df: DataFrame, target: str, columns: list[str]) -> dict[str, float]:
    """r^2 / (1 - r^2) * (n - 2) of each column with the target."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *(F.corr(c, target).alias(c) for c in columns)).first()
    out = {}
    for c in columns:
        r2 = (row[c] or 0.0) ** 2
        out[c] = math.inf if r2 >= 1 else r2 / (1 - r2) * (row["_n"] - 2)
    return out


def anova_chance(df: DataFrame, target: str, column: str) -> float:
    """The chance of an F of the column by the target's classes at least as large as the one found."""
    g = df.where(F.col(target).isNotNull() & F.col(column).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.avg(column).alias("m"), F.var_pop(column).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("w")).first()
    if not t["n"] or t["k"] < 2 or t["n"] <= t["k"]:
        return 1.0
    between = max(0.0, t["q"] - t["s"] ** 2 / t["n"])
    if not t["w"]:
        return 0.0 if between else 1.0
    return f_tail(between / (t["k"] - 1) / (t["w"] / (t["n"] - t["k"])), t["k"] - 1, t["n"] - t["k"])


def mutual_information(df: DataFrame, target: str, columns: list[str], bins: int = 10) -> dict[str, float]:
    """Mutual information in nats between each column's quantile bins and the target's values (its bins, if it has many)."""
    edges = quantiles(df, [c for c in (*columns, target) if c in numeric_columns(df)], [i / bins for i in range(1, bins)])
    many = target in edges and df.agg(F.approx_count_distinct(target)).first()[0] > 2 * bins
    code = lambda c: bin_code(F.col(c), sorted(set(edges[c])))
    label = code(target) if many else F.col(target)
    out = {}
    for c in columns:
        joint = df.where(F.col(c).isNotNull() & F.col(target).isNotNull()).groupBy(code(c).alias("a"), label.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
        n = sum(r["n"] for r in joint)
        pa: dict = {}
        pb: dict = {}
        for r in joint:
            pa[r["a"]] = pa.get(r["a"], 0) + r["n"]
            pb[r["b"]] = pb.get(r["b"], 0) + r["n"]
        out[c] = sum(r["n"] / n * math.log(r["n"] * n / (pa[r["a"]] * pb[r["b"]])) for r in joint) if n else 0.0
    return out


@step("fselection", "none", "variance_off", "variance", "mutual_info", "missing_ratio", "collinear", "chi2", "f_regression", "spread", "fpr")
def select(df: DataFrame, roles: Roles = Roles(), strategy: str = "none", threshold: float | None = None, share: float = 1.0, k: int | None = None) -> Fitted:
    """Drops numeric features: variance (> threshold, default 0.01), mutual_info / chi2 / f_regression (best share or k), fpr (analysis of variance by class with a chance below the threshold, default 0.05), missing_ratio (> threshold of all columns), collinear (the later of each pair over the threshold), spread (deviation below a percentile). variance_off keeps all, as the source operator does."""
    names = numeric_columns(df, roles)
    dropped: list[str] = []
    scores: dict = {}
    if strategy == "variance":
        row = df.agg(*(F.var_pop(c).alias(c) for c in names)).first()
        scores = {c: row[c] for c in names}
        dropped = [c for c in names if not (row[c] or 0) > (0.01 if threshold is None else threshold)]
    elif strategy == "missing_ratio":
        scores = missing_ratios(df)
        dropped = [c for c, r in scores.items() if r > (0.4 if threshold is None else threshold) and c not in roles.kept_out()]
    elif strategy == "collinear":
        corr, limit = np.abs(correlations(df, names)), 0.9 if threshold is None else threshold
        dropped = [c for j, c in enumerate(names) if any(corr[i, j] > limit for i in range(j))]
    elif strategy == "spread":
        row = df.agg(*(F.stddev_samp(c).alias(c) for c in names)).first()
        scores = {c: row[c] or 0.0 for c in names}
        limit = float(np.percentile(list(scores.values()), threshold or 0)) if scores else 0.0
        dropped = [c for c in names if scores[c] < limit]
    elif strategy == "fpr":
        scores = {c: anova_chance(df, roles.target, c) for c in names}
        dropped = [c for c in names if not scores[c] < (0.05 if threshold is None else threshold)]
    elif strategy in ("mutual_info", "chi2", "f_regression"):
        if strategy == "chi2":
            low = df.agg(*(F.min(c).alias(c) for c in names)).first()
            names = [c for c in names if low[c] is not None and low[c] >= 0]
        scores = {"mutual_info": mutual_information, "chi2": chi2_scores, "f_regression": f_regression}[strategy](df, roles.target, names)
        best = sorted(scores, key=lambda c: (-(scores[c] if scores[c] == scores[c] else -1), c))[: k or math.ceil(share * len(names))]
        dropped = [c for c in names if c not in best]
    return Fitted(lambda d: d.drop(*dropped), {"dropped": dropped, "scores": scores})


@step("fselection", "svc", "tree", "l1", "imp")
def select_by_model(df: DataFrame, roles: Roles, strategy: str = "tree", share: float = 0.8) -> Fitted:
    """The features of largest importance (tree, imp: gradient-boosted trees) or coefficient (svc, l1)."""
    from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    names = numeric_columns(df, roles)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(df.dropna(subset=[*names, roles.target]))
    if strategy == "tree":
        weight = RandomForestClassifier(labelCol=roles.target, numTrees=20, seed=42).fit(data).featureImportances.toArray()
    elif strategy == "imp":
        weight = GBTClassifier(labelCol=roles.target, maxIter=10, seed=42).fit(data).featureImportances.toArray()
    elif strategy == "svc":
        weight = LinearSVC(labelCol=roles.target, maxIter=30).fit(data).coefficients.toArray()
    else:
        weight = LinearRegression(labelCol=roles.target, regParam=0.01, elasticNetParam=1.0).fit(data).coefficients.toArray()
    best = {names[i] for i in np.argsort(-np.abs(weight), kind="stable")[: math.ceil(share * len(names))]}
    return Fitted(lambda d: d.drop(*(c for c in names if c not in best)), {"weights": dict(zip(names, map(float, weight), strict=True))})


def classes(df: DataFrame, column: str, most: int = 10_000) -> list[str]:
    """The sorted distinct values as text; more than `most` is an error, since they become columns or a broadcast table."""
    rows = df.select(F.col(column).cast("string").alias("v")).where("v is not null").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} classes")
    return sorted(r["v"] for r in rows)


def label_code(column: str, values: list[str]) -> Column:
    """Place of the value among the sorted classes; unseen is -1."""
    if not values:
        return F.lit(-1)
    table = F.create_map(*(x for k, v in enumerate(values) for x in (F.lit(v), F.lit(k))))
    return F.when(F.col(column).isNotNull(), F.coalesce(F.try_element_at(table, F.col(column).cast("string")), F.lit(-1)))


@step("encoding", "label_encoder", "onehot", "label_binarizer", "binarizer", "frequency", "kbins")
def encode(df: DataFrame, roles: Roles = Roles(), strategy: str = "onehot", columns: list[str] | None = None, threshold: float = 0.0, bins: int = 5, prefix: str = "", cat_max_unique: int | None = None) -> Fitted:
    """label_encoder adds c__le; onehot and label_binarizer (without the first class) add c_v of 0 and 1 and drop c; binarizer x > threshold; frequency adds c__freq; kbins one-hot quantile bins. cat_max_unique: numbers with so few values count as classes."""
    if strategy == "binarizer":
        return Fitted(columnwise({c: F.when(F.col(c) > threshold, F.lit(1)).when(F.col(c).isNotNull(), F.lit(0)) for c in columns or numeric_columns(df, roles)}))
    if strategy == "kbins":
        return binning(df, roles, "quantile", columns, bins=bins, onehot=True)
    names = columns or text_columns(df, roles)
    if cat_max_unique is not None and columns is None:
        numbers = numeric_columns(df, roles)
        row = df.agg(*(F.count_distinct(c).alias(c) for c in numbers)).first() if numbers else {}
        names = [*names, *(c for c in numbers if row[c] <= cat_max_unique)]
    if strategy == "frequency":
        n = max(1, df.count())

        def apply(d: DataFrame) -> DataFrame:
            for c in names:
                share = df.groupBy(c).agg((F.count(F.lit(1)) / n).alias(f"{c}__freq"))
                d = d.join(share, c, "left")
            return d

        return Fitted(apply)
    found = {c: classes(df, c) for c in names}
    if strategy == "label_encoder":
        return Fitted(columnwise({f"{c}__le": label_code(c, v) for c, v in found.items()}), found)
    first = 1 if strategy == "label_binarizer" else 0
    out = {f"{prefix or c}_{v}": (F.coalesce(F.col(c).cast("string") == v, F.lit(False))).cast("int") for c, values in found.items() for v in values[first:]}
    return Fitted(lambda d: d.withColumns(out).drop(*names) if out else d.drop(*names), found)


def bin_code(x: Column, edges: list[float]) -> Column:
    """How many inner edges the value has reached."""
    if not edges:
        return F.when(x.isNotNull(), F.lit(0))
    return F.when(x.isNotNull(), F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: x >= e)))


def centres_1d(df: DataFrame, column: str, k: int, rounds: int = 20) -> list[float]:
    """One-dimensional k-means from evenly spread quantiles; each round is one aggregation."""
    centres = sorted(set(quantiles(df, [column], [(i + 0.5) / k for i in range(k)])[column]))
    for _ in range(rounds):
        edges = [(a + b) / 2 for a, b in zip(centres[:-1], centres[1:], strict=True)]
        rows = df.where(F.col(column).isNotNull()).groupBy(bin_code(F.col(column), edges).alias("b")).agg(F.avg(column).alias("m")).collect()
        new = sorted(float(r["m"]) for r in rows)
        if new == centres:
            break
        centres = new
    return centres


@step("binning", "uniform", "quantile", "kmeans")
def binning(df: DataFrame, roles: Roles = Roles(), strategy: str = "uniform", columns: list[str] | None = None, bins: int = 5, onehot: bool = False) -> Fitted:
    """Adds c_binned (0 .. bins - 1), or one column c_bin<i> for each bin."""
    names = columns or numeric_columns(df, roles)
    edges: dict[str, list[float]] = {}
    if strategy == "uniform":
        row = df.agg(*(f(c).cast("double").alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max))).first()
        edges = {c: [row[f"min_{c}"] + (row[f"max_{c}"] - row[f"min_{c}"]) * i / bins for i in range(1, bins)] if row[f"min_{c}"] is not None else [] for c in names}
    elif strategy == "quantile":
        edges = {c: sorted({q for q in found if q is not None}) for c, found in quantiles(df, names, [i / bins for i in range(1, bins)]).items()}
    else:
        for c in names:
            centres = centres_1d(df, c, bins)
            edges[c] = [(a + b) / 2 for a, b in zip(centres[:-1], centres[1:], strict=True)]
    if not onehot:
        return Fitted(columnwise({f"{c}_binned": bin_code(F.col(c), edges[c]) for c in names}), edges)
    return Fitted(columnwise({f"{c}_bin{i}": (bin_code(F.col(c), edges[c]) == i).cast("int") for c in names for i in range(len(edges[c]) + 1)}), edges)


def degree_two(columns: list[str]) -> dict[str, Column]:
    """The columns, their squares and their products."""
    out = {c: F.col(c).cast("double") for c in columns}
    return out | {f"{a}_x_{b}": F.col(a).cast("double") * F.col(b).cast("double") for a, b in itertools.combinations_with_replacement(columns, 2)}


def _sparse_axes(cov: np.ndarray, k: int, penalty: float, rounds: int = 200) -> np.ndarray:
    """Sparse principal axes by soft-thresholded power steps with deflation."""
    out, rest = [], cov.copy()
    for _ in range(k):
        v = np.linalg.eigh(rest)[1][:, -1]
        for _ in range(rounds):
            w = rest @ v
            w = np.sign(w) * np.maximum(np.abs(w) - penalty * np.abs(w).max(), 0)
            n = np.linalg.norm(w)
            if not n:
                break
            w /= n
            if np.allclose(w, v, atol=1e-10):
                break
            v = w
        out.append(v)
        rest = rest - np.outer(v, v) * (v @ rest @ v)
    return np.array(out)


def _online_axes(moments: list[np.ndarray], k: int, penalty: float, passes: int = 20) -> np.ndarray:
    """Sparse axes by one soft-thresholded step on each part's second moments in turn, with steps that grow smaller."""
    total = sum(moments) / len(moments)
    v = np.linalg.eigh(total)[1][:, ::-1][:, :k].T.copy()
    seen = 0
    for _ in range(passes):
        for part in moments:
            seen += 1
            for i in range(k):
                w = part @ v[i]
                for j in range(i):  # apart from the axes before it
                    w -= (v[j] @ w) * v[j]
                w = np.sign(w) * np.maximum(np.abs(w) - penalty * np.abs(w).max(), 0)
                if (size := np.linalg.norm(w)) > 0:
                    w = v[i] + (w / size * np.sign(w @ v[i] or 1.0) - v[i]) / np.sqrt(seen)
                    v[i] = w / max(np.linalg.norm(w), 1e-12)
    small = np.abs(v) < penalty * np.abs(v).max(1, keepdims=True)
    v[small] = 0.0
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _moments_by_part(rows: DataFrame, columns: list[str], batches: int) -> list[np.ndarray]:
    """Second moments of the standardised columns in each of a number of parts, from one aggregation."""
    pairs = list(itertools.combinations_with_replacement(range(len(columns)), 2))
    part = F.pmod(F.xxhash64(*columns), F.lit(batches))
    out = []
    for r in rows.groupBy(part.alias("_part")).agg(*(F.avg(F.col(columns[i]) * F.col(columns[j])).alias(f"p{n}") for n, (i, j) in enumerate(pairs))).orderBy("_part").collect():  # at most `batches` rows
        m = np.zeros((len(columns), len(columns)))
        for n, (i, j) in enumerate(pairs):
            m[i, j] = m[j, i] = r[f"p{n}"]
        out.append(m)
    return out


@step("poly_pca", "none", "poly", "pca", "sparsepca", "minibatchsparsepca", "kernelpca")
def reduce(df: DataFrame, roles: Roles = Roles(), strategy: str = "pca", k: int = 3, columns: list[str] | None = None, penalty: float = 0.1, landmarks: int = 256, gamma: float | None = None, batches: int = 16) -> Fitted:
    """Degree-two expansion, then principal axes of the standardised terms (pc0 ..); the moment matrix is one aggregation. kernelpca: centred radial kernel on at most `landmarks` distinct rows, each weighted by the number of rows nearest to it; exact for a table of no more distinct rows. minibatchsparsepca: online steps over `batches` parts of the rows, dealt by a hash of their values."""
    names = columns or numeric_columns(df, roles)
    if strategy == "none":
        return Fitted(lambda d: d)
    terms = degree_two(names)
    if strategy == "poly":
        return Fitted(columnwise({c: x for c, x in terms.items() if c not in names}))
    wide = df.select(*(x.alias(c) for c, x in terms.items()))
    mean, cov, _ = moment_matrix(wide, list(terms))
    scale = np.sqrt(np.where(np.diag(cov) > 0, np.diag(cov), 1.0))
    unit = [(x - F.lit(float(m))) / F.lit(float(s)) for x, m, s in zip(terms.values(), mean, scale, strict=True)]
    k = min(k, len(terms))
    if strategy == "kernelpca":
        distinct = df.select(*(F.col(c).cast("double").alias(c) for c in names)).dropna().groupBy(*names).agg(F.count(F.lit(1)).alias("_n")).select(*(x.alias(c) for c, x in degree_two(names).items()), "_n")
        rows = distinct.orderBy(F.xxhash64(*terms)).limit(landmarks).select(*terms).toPandas().to_numpy(float)
        z = (rows - mean) / scale
        g = gamma or 1 / z.shape[1]

        def nearest(*cols):
            import pandas as pd

            x = (np.column_stack([c.to_numpy(float) for c in cols]) - mean) / scale
            return pd.Series(((z * z).sum(1)[None, :] - 2 * x @ z.T).argmin(1).astype(np.int32))

        # each row of the table counts at its nearest landmark
        weight = np.zeros(len(z))
        for r in distinct.groupBy(F.pandas_udf(nearest, "int")(*terms).alias("i")).agg(F.sum("_n").alias("n")).collect():  # at most `landmarks` rows
            weight[r["i"]] = r["n"]
        root, weight = np.sqrt(weight), weight / max(1.0, weight.sum())
        plain = np.exp(-g * ((z[:, None, :] - z[None, :, :]) ** 2).sum(2))
        # centred in the kernel's space about the mean of all rows
        mean_of = plain @ weight
        gram = root[:, None] * (plain - mean_of[:, None] - mean_of[None, :] + weight @ mean_of) * root[None, :]
        value, vector = np.linalg.eigh(gram)
        axes = root[:, None] * vector[:, ::-1][:, :k] / np.sqrt(np.maximum(value[::-1][:k], 1e-12))

        def project(*cols):
            import pandas as pd

            x = np.column_stack([c.to_numpy(float) for c in cols])
            d = (x * x).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * x @ z.T
            near = np.exp(-g * np.maximum(d, 0))
            return pd.Series(list((near - (near @ weight)[:, None] - mean_of[None, :] + weight @ mean_of) @ axes))

        vec = F.pandas_udf(project, "array<double>")(*unit)
        return Fitted(lambda d: d.withColumn("_pc", vec).withColumns({f"pc{i}": F.get("_pc", F.lit(i)) for i in range(k)}).drop("_pc", *names))
    corr = cov / np.outer(scale, scale)
    if strategy == "minibatchsparsepca":
        standard = df.select(*(x.alias(f"_s{i}") for i, x in enumerate(unit))).dropna()
        parts = _moments_by_part(standard, standard.columns, batches)
        axes = _online_axes(parts, k, penalty) if parts else np.eye(len(terms))[:k]
    else:
        axes = np.linalg.eigh(corr)[1][:, ::-1][:, :k].T if strategy == "pca" else _sparse_axes(corr, k, penalty)
    axes = axes * np.where(axes[np.arange(k), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
    out = {f"pc{i}": sum((F.lit(float(a)) * x for a, x in zip(axes[i], unit, strict=True)), F.lit(0.0)) for i in range(k)}
    return Fitted(lambda d: d.withColumns(out).drop(*names), {"axes": axes.tolist()})
