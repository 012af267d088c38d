"""Operators that deal rows to cells, blocks and ranges against brute force on small blocks; plans, repair, answering and matching."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millwright.data import Roles
from millwright.functions import knn
from millwright.functions.graph import components
from millwright.functions.profile import utility
from millwright.operators import duplicates, entities, features, models, noise, postings, sampling, tiles
from millwright.operators import retrieval as R
from millwright.operators.base import fit
from millwright.plans import answering, matching, repair, search
from millwright.plans.plan import Executor, Plan, with_neighbours

ID = Roles(row_id="id")
SF = "/root/testdata/sf0.001"


def brute_near(asks, rows, k):
    ids = np.array([r[0] for r in rows])
    y = np.array([r[1] for r in rows], float)
    out = []
    for i, v in asks:
        d = np.round(knn.nan_euclidean(np.array([v], float), y)[0], 9)
        d[ids == i] = np.nan
        order = sorted((x, int(j)) for x, j in zip(d, ids, strict=True) if not np.isnan(x))[:k]
        out += [(i, j, x, n + 1) for n, (x, j) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 2, 7])
def test_nearest_rows_through_cells_equal_brute_force(spark, monkeypatch, width):
    rng = np.random.default_rng(width)
    x = np.round(rng.standard_normal((300, width)) * [2.0**k for k in range(width)], 3)
    x[40:90] = x[0]  # a crowded place
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    names = [f"f{i}" for i in range(width)]
    df = spark.createDataFrame([(i, *(None if np.isnan(c) else c for c in v)) for i, v in rows], "id long, " + ", ".join(f"{n} double" for n in names))
    monkeypatch.setattr(knn, "PART", 16)
    for asking, block in ((df, 30), (df.where("id % 7 = 0"), 30), (df, 1000)):
        asked = [rows[r["id"]] for r in asking.select("id").collect()]
        got = sorted((r["ask"], r["near"], r["distance"], r["place"]) for r in knn.nearest_rows(asking, df, "id", names, 4, block=block).collect())
        want = brute_near(asked, rows, 4)
        assert [g[::3] for g in got] == [w[::3] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-6)
        assert len({g[:2] for g in got} ^ {w[:2] for w in want}) <= 0.02 * len(want)  # rounding of distances may turn a tie
    none = knn.nearest_rows(df, df.limit(0), "id", names, 3).collect()
    assert none == []


def test_boxes_rule_out_no_neighbour():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((50, 3)), rng.standard_normal((200, 3))
    x[rng.random(x.shape) < 0.2] = np.nan
    tree = knn.cuts(y, 9)
    cell = knn.cells_of(tree, y)
    assert len(set(cell.tolist())) == 9
    low, high = (np.array([f(y[cell == c], 0) for c in sorted(set(cell.tolist()))]) for f in (np.min, np.max))
    least = knn.least_distances(x, low, high)
    d = knn.nan_euclidean(x, y)
    for n, c in enumerate(sorted(set(cell.tolist()))):
        near = np.nanmin(np.where(np.isnan(d), np.inf, d)[:, cell == c], axis=1)
        assert (least[:, n] <= near + 1e-9).all()


@pytest.mark.parametrize("kind", ["lm", "dl"])
def test_edit_duplicates_equal_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 25))) for _ in range(60)]
    for w in list(words[:40]):
        at = int(rng.integers(len(w)))
        words += [w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + w[at : at + 2][::-1] + w[at + 2 :]]
    rows = [(i, w) for i, w in enumerate(words)] + [(900, None), (901, ""), (902, ""), (903, words[0])]
    df = spark.createDataFrame(rows, "id long, s string")

    def plain(a, b):
        now = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, now = now, [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        return now[-1]

    measure = plain if kind == "lm" else duplicates.damerau
    for threshold in (0.05, 0.1, 0.25, 0.39, 0.6):
        got = {r["id"] for r in duplicates.edit_duplicates(df, "id", "s", threshold, kind).collect()}
        want = {j for (i, a), (j, b) in itertools.combinations([r for r in rows if r[1] is not None], 2) if measure(a, b) < (len(a) + len(b) / 2) * threshold}
        assert got == want, threshold


def test_cuts_by_lot_equal_a_sort(spark):
    df = spark.range(0, 900).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 2 > 0, F.lit("b")).alias("y"))
    got = sampling.of_smallest_lot(df, "y", F.floor(F.col("_n") * 0.31), "id", 7, "in").collect()
    lots = {r["id"]: r["l"] for r in df.select("id", sampling.lot("id", 7).alias("l")).collect()}
    for y in ("hot", "b", None):
        own = sorted((lots[r["id"]], r["id"]) for r in got if r["y"] == y)
        assert {r["id"] for r in got if r["y"] == y and r["in"]} == {i for _, i in own[: int(len(own) * 0.31)]}
    assert len(got) == 900 and not any(r["in"] for r in sampling.of_smallest_lot(df, "y", F.lit(0), "id", 7, "in").collect())


def test_sparse_axes_of_parts(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal(3000)
    df = spark.createDataFrame([(i, float(v), float(v + 0.1 * rng.standard_normal()), float(rng.standard_normal())) for i, v in enumerate(a)], "id long, a double, b double, c double")
    whole, parts = (np.array(fit("poly_pca", s, df, ID, k=2).statistics["axes"]) for s in ("sparsepca", "minibatchsparsepca"))
    assert np.allclose((parts**2).sum(1), 1) and (parts == 0).any() and not np.allclose(whole, parts)
    assert abs(whole[0] @ parts[0]) > 0.9


def test_shape_noise_follows_its_formulas(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal(200) * 3 + 5
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, v double")
    z = (x - x.mean()) / x.std()
    for kind, warped in (("skew_right", np.exp(2 * z)), ("skew_left", -np.exp(2 * z)), ("heavy_tail", z * np.exp(np.abs(z) / 2))):
        got = [r["v"] for r in noise.distribution_shape(df, ID, kind).orderBy("id").collect()]
        assert np.allclose(got, (warped - warped.mean()) / warped.std() * x.std() + x.mean(), rtol=1e-9)
    some = noise.distribution_shape(df, ID, "skew_right", row_share=0.25).join(df.withColumnRenamed("v", "old"), "id").where("abs(v - old) > 1e-12").count()
    assert 40 <= some <= 50
    first, second = (sorted(map(tuple, noise.multicollinearity(df.repartition(n), ID, "v", "w").collect())) for n in (1, 5))
    assert first == second


def test_chained_imputation(spark):
    rng = np.random.default_rng(3)
    a = rng.standard_normal(400)
    b = 2 * a + 1 + 0.01 * rng.standard_normal(400)
    gap = rng.random(400) < 0.2
    df = spark.createDataFrame([(i, float(x), None if g else float(y)) for i, (x, y, g) in enumerate(zip(a, b, gap, strict=True))], "id long, a double, b double")
    for strategy in ("mice", "em", "iterative"):
        got = [r["b"] for r in fit("missing_value", strategy, df, ID)(df).orderBy("id").collect()]
        assert np.abs(np.array(got) - b).max() < 0.1, strategy


def test_modes_of_several_types(spark):
    from millwright.operators.missing import modes

    df = spark.createDataFrame([("b", 1, 1.0), ("a", 1, None), ("a", 2, None), ("b", 2, None), (None, None, None)], "t string, n int, v double").withColumn("w", F.lit(None).cast("string"))
    assert modes(df, ["t", "n", "v", "w"]) == {"t": "a", "n": 1, "v": 1.0, "w": None}


def test_selection_by_chance_and_importance(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, float(rng.standard_normal() + 3 * (i % 2)), float(rng.standard_normal()), i % 2) for i in range(300)], "id long, good double, noise double, y int")
    roles = Roles(row_id="id", target="y")
    assert "good" not in fit("fselection", "fpr", df, roles).statistics["dropped"]
    assert features.anova_chance(df, "y", "good") < 1e-10 < features.anova_chance(df, "y", "noise")
    assert fit("fselection", "imp", df, roles, share=0.5)(df).columns == ["id", "good", "y"]
    scores = models.cross_validate(df, roles, "lr", folds=3)
    assert len(scores) == 3 and max(scores) < 0.2
    assert models.evaluate(df.withColumns({c: F.abs(c) for c in ("good", "noise")}), roles, "mnb") < 0.5
    curve = df.select("id", "good", (F.abs(F.col("good") - 1.5)).alias("y"))
    assert models.evaluate(curve, roles, "mars", "rmse") < 0.6 * models.evaluate(curve, roles, "reg", "rmse")


def test_best_first_is_the_sorted_space():
    for sizes, coefficients in (([3, 4, 2], [0.5, -0.25, 0.0]), ([2, 2, 2, 3], [0.0, 0.0, 0.0, 0.0]), ([1, 5], [-1.0, 2.0]), ([3, 0], [1.0, 1.0])):
        want = sorted(itertools.product(*(range(1, n + 1) for n in sizes)), key=lambda v: (sum(c * x for c, x in zip(coefficients, v, strict=True)), v))
        assert list(search.best_first(sizes, coefficients)) == want
    big = search.best_first([50] * 12, [1.0] * 12)
    assert next(big) == (1,) * 12 and sum(next(big)) == 13  # of 50 ** 12 vectors


def test_neighbours_count_as_strategies():
    assert with_neighbours("missing_value", 2) == ("mean", {}) and with_neighbours("missing_value", 5) == ("knn", {"k": 1}) and with_neighbours("missing_value", 9) == ("knn", {"k": 30})


def test_profiles_lead_to_the_repair(spark):
    got = {r["method"]: (r["evaluations"], r["met"]) for r in entry.queries()["repair_glass_box"](spark, SF).collect()}
    assert got["glass box"][1] and got["grid"][1] and got["glass box"][0] < got["grid"][0]


def test_history_and_snapshots(spark, tmp_path):
    rows = [(i, float(i % 50), float(i % 7), int(i % 50 > 25)) for i in range(600)]
    clean = spark.createDataFrame(rows, "id long, a double, b double, y int")
    roles = Roles(row_id="id", target="y")
    space = {"missing_value": ("mean", "drop"), "outlier": ("none", "iqr"), "model": ("lr",)}
    past = repair.write_history(spark, Executor(clean, roles), list(space), 10, f"{tmp_path}/h.parquet", strategies=space)
    back = spark.read.parquet(f"{tmp_path}/h.parquet")
    assert past.count() == back.count() == 4 and {"missing_value", "outlier", "model", "profile_corr_a", "utility_accuracy_score"} <= set(back.columns)
    hurt = noise.outliers(clean, roles, 0.1, ["a"])
    target = repair.passing_profile(past, "utility_accuracy_score", 0.05)
    run, start = Executor(hurt, roles), Plan((("missing_value", "mean"), ("outlier", "none"), ("model", "lr")))
    actions = [a for a in search.interventions(start) if a.kind == "change" and a.strategy in space[a.step]]
    assert repair.by_profiles(run, start, actions, target)[0].strategy == "iqr"
    best = repair.before_and_after(run, start, actions, target)[0]
    assert best[0].strategy == "iqr" and best[2] > best[1]


def test_matching_parameters_reach_the_best_of_the_grid(spark):
    rows = [(i, f"{w} item n{i // 2} {'x' if i % 2 else 'y'}", "b") for i, w in enumerate(["red", "blue", "green", "white"] * 15)]
    df = spark.createDataFrame(rows, "id long, title string, brand string")
    truth = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(30)], "id1 long, id2 long")
    matcher, space = matching.Matcher(df, truth, "id", ["title"]), matching.Space(block=(0.05, 0.5), scheme=(1, 3), match=(0.3, 0.6))
    past = matching.history(spark, matcher, space)
    top = max(r["f"] for r in past.collect())
    got = matching.search(matcher, space, past, (1, 1, 1, 1), top)
    assert past.count() == 16 and got.met and got.evaluations <= 16 and top > 0.5
    halves = matching.Matcher(df.where("id % 2 = 0"), truth, "id", ["title"], right=df.where("id % 2 = 1"))
    assert halves.f_scores(True, 0.05, "js", [0.3])[0.3] > 0.5


TEXTS = [(1, "the quick brown fox jumps over the lazy dog"), (2, "the quick brown fox sleeps"), (3, "a slow green turtle"), (4, None), (5, "quick quick brown foxes and dogs run over hills"), (6, "")]


def test_matrix_and_joined_scores_agree(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    asks = spark.createDataFrame([(1, "quick brown fox"), (2, "green turtle dog"), (3, "unknownword"), (4, "hills run")], "qid long, query string")
    for kind in ("bm25", "dense"):
        own = R.index(docs, "doc_id", "text", kind)
        matrix = sorted(map(tuple, R.retrieve(asks, own, k=3).collect()))
        with monkeypatch.context() as m:
            m.setattr(R, "CELLS", 4)
            assert sorted(map(tuple, R.retrieve(asks, own, k=3).collect())) == matrix
            m.setattr(R, "ASKING", 0)
            assert sorted(map(tuple, R.retrieve(asks, own, k=3).collect())) == matrix
        assert {r[0] for r in matrix} == ({1, 2, 4} if kind == "bm25" else {1, 2, 3, 4})  # "own" is in brown too


@pytest.mark.parametrize("kind", ["bm25", "dense"])
def test_scores_need_no_row_for_each_term_of_a_document(spark, monkeypatch, kind):
    rng = np.random.default_rng(6)
    words = ["fox", "straße", "naïve", "日本語", "hill", "quick", "brown", "ab", "x1", "𝒳𝒴"]
    rows = [(i, None if i == 7 else "\n".join(" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(3))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asks = spark.createDataFrame([(1, "quick brown fox"), (2, "straße 日本語 hill x1"), (3, "unknownword"), (4, "𝒳𝒴 naïve ab ab")], "qid int, query string")
    found = {}
    for way in ("small vocabulary", "any vocabulary", "joined"):
        with monkeypatch.context() as m:
            m.setattr(R, "VOCABULARY", 0 if way == "any vocabulary" else 1_000_000)
            m.setattr(R, "BUCKET", 100)
            m.setattr(R, "ASKING", 0 if way == "joined" else 400_000)
            own = R.index(docs, "doc_id", "text", kind)
            found[way] = sorted(map(tuple, R.retrieve(asks, own, k=5).collect()))
            assert (own._tables is None) == (way != "joined")
    assert found["small vocabulary"] == found["joined"] == found["any vocabulary"] and len(found["joined"]) >= 15


def test_a_task_keeps_the_first_of_each_query():
    best = postings._Best(2, 3)
    best.limit = 4
    rng = np.random.default_rng(1)
    every = [(q, d, s) for d, (q, s) in enumerate(zip(rng.integers(0, 2, 200).tolist(), np.round(rng.random(200), 2).tolist(), strict=True))]
    for q, d, s in every:
        best.add(np.array([q]), np.array([d]), np.array([s]))
    got = sorted(zip(*(x.tolist() for x in best.cut()), strict=True))
    for q in (0, 1):
        own = sorted((x for x in every if x[0] == q), key=lambda x: -x[2])
        assert [g for g in got if g[0] == q] == sorted(x for x in own if x[2] >= own[2][2] - postings.MARGIN)


def test_quoted_items_equal_containment(spark):
    items = [(1, "quick brown fox"), (2, "uick brown fox jumps ove"), (3, "the"), (4, "brown  fox"), (5, ""), (6, None), (7, "fox jumps over the lazy dog"), (8, "k b"), (9, "quick brown fox jumps over the lazy dog and cat")]
    docs, asked = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(items, "qid long, query string")
    got = sorted(map(tuple, R.quoting(docs, asked).collect()))
    assert got == sorted((q, d) for q, i in items for d, t in TEXTS if i is not None and t is not None and i in t)


def test_contexts_without_what_overlaps(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d x"), (3, "p q r"), (4, "a z")], "doc_id long, text string")
    found = spark.createDataFrame([(7, 1, 1), (7, 2, 2), (7, 3, 3), (7, 4, 4)], "qid long, doc_id long, rank int")
    assert [tuple(r) for r in R.diverse_context(found, docs, 100).collect()] == [(7, "a b c d e\n\np q r\n\na z", 3)]
    assert [tuple(r) for r in R.diverse_context(found, docs, 7).collect()] == [(7, "a b c d e", 1)] or R.diverse_context(found, docs, 7).first()["n_docs"] == 1
    local = R.retrieve_local(spark.createDataFrame([("the Fox ran", ["a dog", "the fox", None, "fox ran the"]), (None, None)], "query string, docs array<string>"), "bm25@2").collect()
    assert local[0]["retrieved"] == ["fox ran the", "the fox"] and local[0]["retrieval_scores"] == [3.0, 2.0] and local[1]["retrieved"] == []
    assert R.retrieve_local(spark.createDataFrame([("x",)], "query string")).first()["retrieved"] == []
    soft = R.score_profile(spark.createDataFrame([(1, 1, 2.0), (1, 2, 0.0)], "qid long, rank int, score double")).first()
    assert abs(soft["max_softmax"] - 1 / (1 + np.exp(-2.0))) < 1e-6 and soft["score_spread"] == 1.0


def test_answering_plans(spark):
    docs = spark.createDataFrame(TEXTS[:3], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "Quick, brown FOX!"), (2, "green turtle")], "qid long, query string")
    corpus, truth = answering.Corpus(docs), spark.createDataFrame([(1, 1), (2, 3)], "qid long, doc_id long")
    for vector in ((2, 1, 1, 1, 1), (2, 5, 2, 3, 2), (3, 4, 3, 4, 2)):
        plan = answering.from_vector(vector)
        assert answering.run(plan, asks, corpus).count() == 2 and answering.utility(plan, asks, corpus, truth) == 0.0
    with pytest.raises(ValueError):
        answering.Answering({"retriever": "bm25@7"}).of("retriever")


def test_components_of_long_chains(spark):
    links = spark.range(0, 500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(1000, 1001), (1001, 1001)], "a long, b long"))
    nodes = spark.range(0, 501).unionByName(spark.createDataFrame([(1000,), (1001,), (2000,)], "id long"))
    got = {r["id"]: r["root"] for r in components(links, nodes).collect()}
    assert len(got) == 504 and {got[i] for i in range(501)} == {0} and got[1001] == 1000 and got[2000] == 2000
    assert components(links.limit(0), nodes).where("id <> root").count() == 0


def test_products_of_brands_that_are_new(spark, tmp_path):
    from millwright.sources import readers

    first = [{"asin": "a1", "title": "t", "price": 1.0, "brand": "X", "categories": [["c"]]}, {"asin": "a2", "title": "t", "brand": "X"}, {"asin": "a3", "title": "no brand"}]
    (tmp_path / "1.json").write_text("\n".join(json.dumps(x) for x in first))
    (tmp_path / "2.json").write_text("\n".join([json.dumps({"asin": "b1", "brand": "X"}), "{'asin': 'b2', 'brand': 'Y', 'title': 'q'}", json.dumps({"asin": "b3", "brand": ""})]))
    assert sorted(r["asin"] for r in readers.product_metadata(spark, str(tmp_path)).collect()) == ["a1", "a2", "b2"]
    readers.write_csv(spark.createDataFrame([(1, [1.5, 2.0])], "id long, v array<double>"), f"{tmp_path}/out", "overwrite")
    assert readers.read_csv(spark, f"{tmp_path}/out", "id long, v string").first()["v"] == "[1.5,2.0]"


def test_loaders_of_known_tables(spark, tmp_path):
    from millwright.sources import datasets

    (tmp_path / "a.csv").write_text("x,race,action_taken\n1,0,1\n2,1,0\n")
    train, test, roles = datasets.mortgages(spark, f"{tmp_path}/a.csv", f"{tmp_path}/a.csv")
    assert roles.target in train.columns and roles.sensitive in test.columns and train.select("rid").distinct().count() == 2
    (tmp_path / "c.csv").write_text("Sex,job,income\n1,b,0\n0,a,1\n")
    (tmp_path / "d.csv").write_text("Sex,job,income\n1,c,0\n")
    a, b, _ = datasets.census(spark, f"{tmp_path}/c.csv", f"{tmp_path}/d.csv")
    assert sorted(r["job"] for r in a.collect()) == [0, 1] and b.first()["job"] == 2
    lines = ["area,rooms,kind,empty,SalePrice"] + [f"{50 + i},{i % 4},{'ab'[i % 2]},,{1000 * i}" for i in range(20)]
    (tmp_path / "h.csv").write_text("\n".join(lines) + "\n")
    train, test, roles = datasets.housing(spark, f"{tmp_path}/h.csv", f"{tmp_path}/h.csv", k=1)
    assert set(train.columns) == {"area", "SalePrice", "rid"} == set(test.columns) and roles.target == "SalePrice"


def test_pairs_already_compared_are_read(spark, tmp_path):
    from millwright.operators import entities

    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "b c")], "id long, t string")
    one, two = spark.createDataFrame([(1, 2)], "id1 long, id2 long"), spark.createDataFrame([(1, 2), (1, 3)], "id1 long, id2 long")
    path = f"{tmp_path}/known"
    assert [tuple(r) for r in entities.cached_similarities(one, df, df, "id", "id", [("t", "t")], path).collect()] == [(1, 2, 1.0)]
    got = sorted(map(tuple, entities.cached_similarities(two, df, df, "id", "id", [("t", "t")], path).collect()))
    assert [g[:2] for g in got] == [(1, 2), (1, 3)] and abs(got[1][2] - 1 / 3) < 1e-9 and spark.read.parquet(path).count() == 2


def test_streams_keep_bounded_state(spark, tmp_path):
    from millwright.streaming import events as S

    df = spark.range(0, 300).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("t").alias("event_type"), F.col("id").cast("double").alias("value"))
    df.repartition(1).write.parquet(f"{tmp_path}/e")
    stream = lambda: S.read(spark, f"{tmp_path}/e", df.schema)
    assert S.replay(S.first_seen(stream(), "user_id", horizon="10 days"), "h").count() == 5
    assert sorted(map(tuple, S.replay(S.sessions(stream(), "20 minutes"), "s", "complete").collect())) == sorted(map(tuple, S.sessions(df, "20 minutes").collect()))
    late = S.replay(S.tumbling(stream(), "1 hour", "10 minutes"), "l").collect()  # append: only windows that the watermark has passed
    whole = sorted(map(tuple, S.tumbling(df).collect()))
    assert set(map(tuple, late)) <= set(whole)
    empty = S.read(spark, f"{tmp_path}/e", df.schema).where("event_id < 0")
    assert S.replay(S.first_seen(empty, "user_id"), "n").count() == 0


def test_pairs_and_weights_meet_between_classes_of_equal_blocks(spark):
    rng = np.random.default_rng(3)
    kinds = [sorted({f"t{k}" for k in rng.integers(0, 7, 3)}) for _ in range(6)]
    blocks = {i: kinds[rng.integers(0, 6)] for i in range(90)}
    members = spark.createDataFrame([(i, t) for i, b in blocks.items() for t in b], "rid long, token string")
    found = entities.edges(members)
    assert found.classes.count() <= 21  # pairs of 6 kinds, not of 90 records
    common = {(i, j): len({*blocks[i]} & {*blocks[j]}) for i, j in itertools.combinations(blocks, 2)}
    common = {p: n for p, n in common.items() if n}
    assert {(r[0], r[1]): r[2] for r in found.expand().collect()} == common and found.expand().count() == len(common)
    size = {t: sum(t in b for b in blocks.values()) for t in {t for b in kinds for t in b}}
    held = len({t for b in blocks.values() for t in b})
    want = {
        "cbs": lambda i, j: common[i, j],
        "arcs": lambda i, j: sum(1 / size[t] ** 2 for t in {*blocks[i]} & {*blocks[j]}),
        "js": lambda i, j: common[i, j] / len({*blocks[i]} | {*blocks[j]}),
        "ecbs": lambda i, j: common[i, j] * math.log2(held / len(blocks[i])) * math.log2(held / len(blocks[j])),
    }
    for scheme, f in want.items():
        got = {(r[0], r[1]): r[2] for r in entities.weights(members, scheme).collect()}
        assert got.keys() == common.keys() and all(abs(got[p] - f(*p)) < 1e-9 for p in got)
    even, odd = members.where("rid % 2 = 0"), members.where("rid % 2 = 1")
    got = {(r[0], r[1]): r[2] for r in entities.pairs(even, odd).collect()}
    assert got == {(i, j): len({*blocks[i]} & {*blocks[j]}) for i in blocks for j in blocks if i % 2 == 0 and j % 2 == 1 and {*blocks[i]} & {*blocks[j]}}


def test_edges_are_pruned_before_pairs_are_listed(spark):
    members = spark.createDataFrame([(i, t) for i in range(60) for t in (f"a{i % 3}", f"b{i % 4}")], "rid long, token string")
    weight = {(i, j): (i % 3 == j % 3) + (i % 4 == j % 4) for i, j in itertools.combinations(range(60), 2)}
    weight = {p: w for p, w in weight.items() if w}
    mean = round(sum(weight.values()) / len(weight), 5)
    pruned = entities.prune(entities.edges(members, scheme="cbs"))
    assert pruned.classes.count() == 12
    assert {(r[0], r[1]) for r in pruned.expand().collect()} == {p for p, w in weight.items() if w >= mean}


@pytest.mark.parametrize("part", [7, 4096])
def test_matrices_of_blocks_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(tiles, "PART", part)
    rng = np.random.default_rng(part)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 9, rng.integers(0, 5))), f"b{rng.integers(0, 3)}" if i % 11 else None, "" if i % 7 == 0 else f"x, y{i % 4}") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, t string, b string, s string")
    words = lambda v: {w for w in (v or "").replace(",", "").split()}
    ratio = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    sims = {}
    for x, y in itertools.combinations(rows, 2):
        if words(x[1]) & words(y[1]):
            sims[x[0], y[0]] = (ratio(words(x[1]), words(y[1])) + (ratio(words(x[2]), words(y[2])) + 0) + ratio(words(x[3]), words(y[3]))) / 3
    members = entities.blocks(df, "id", "t")
    plain = df.fillna({"b": ""})
    got = [tuple(r) for r in tiles.matches(members, plain, "id", ["t", "b", "s"], 0.5).collect()]
    assert len(got) == len({p[:2] for p in got}) and {(a, b): round(s, 12) for a, b, s in got} == {p: round(s, 12) for p, s in sims.items() if s >= 0.5}
    truth = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[2] is not None and x[2] == y[2]}
    for r in tiles.confusion(members, df.withColumn("c", F.coalesce("b", F.lit(""))), "id", ["t", "c", "s"], ["b"], [0.3, 0.6]).collect():
        hits = {p for p, s in sims.items() if s >= r["theta"]}
        assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (len(hits & truth), len(hits - truth), len({*sims} - hits - truth), len(truth - hits))
    assert {tuple(r) for r in tiles.true_candidates(members, df, "id", ["b"]).collect()} == {*sims} & truth


@pytest.mark.parametrize("kind", ["lm", "dl", "jw"])
def test_numbered_names_need_their_nearest_spellings_only(spark, monkeypatch, kind):
    def never(*_):
        raise AssertionError("values were looked up")

    monkeypatch.setattr(duplicates, "_edit_candidates", never)
    rows = [(i, f"Name#{i:09d}") for i in range(0, 230, 3)] + [(900, "Name#000000000"), (901, "Nome#00000000"), (5000, "Name#000005000"), (70000, "Name#000070000")]

    def plain(a, b):
        now = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, now = now, [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        return now[-1]

    measure = {"lm": plain, "dl": duplicates.damerau, "jw": lambda a, b: 1 - duplicates.jaro_winkler(a, b)}[kind]
    threshold = 0.0015 if kind == "jw" else 0.05
    got = {r["id"] for r in duplicates.edit_duplicates(spark.createDataFrame(rows, "id long, s string"), "id", "s", threshold, kind).collect()}
    assert got == {j for (i, a), (j, b) in itertools.combinations(rows, 2) if measure(a, b) < (len(a) + len(b) / 2) * threshold}


@pytest.mark.parametrize("kind", ["lm", "dl"])
def test_values_without_a_near_spelling_are_looked_up(spark, monkeypatch, kind):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc"), rng.integers(8, 25))) for _ in range(40)]
    for w in list(words):
        at = int(rng.integers(len(w) - 3))
        words += [w[:at] + w[at + 2 :], w[:at] + "b" + w[at : at + 3][::-1] + w[at + 3 :]]
    rows = list(enumerate(words))
    df = spark.createDataFrame(rows, "id long, s string")
    direct = {r["id"] for r in duplicates.edit_duplicates(df, "id", "s", 0.2, kind).collect()}
    monkeypatch.setattr(duplicates, "DIRECT", 0)
    monkeypatch.setattr(duplicates, "SHARE", 1e9)
    assert {r["id"] for r in duplicates.edit_duplicates(df, "id", "s", 0.2, kind).collect()} == direct and direct


def test_deep_rankings_are_cut_before_the_shuffle_and_shared_by_plans(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 5} gamma{i % 7}") for i in range(30)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "alpha beta1"), (2, "gamma3 alpha")], "qid long, query string")
    ranked = R.retrieve(queries, docs, "bm25", k=2000)
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") >= 1
    assert ranked.count() == 60
    corpus = answering.Corpus(docs)
    truth = spark.createDataFrame([(1, 1), (2, 3)], "qid long, doc_id long")
    found = {}
    for r in ("bm25@10", "dense@10", "hybrid_rrf@10"):
        plan = answering.Answering({"retriever": r})
        found[r] = sorted(map(tuple, answering.found(plan, answering.asked(plan, queries), corpus).collect()))
        answering.utility(plan, queries, corpus, truth)
    assert len(corpus.rankings) == 2
    assert found["bm25@10"] == sorted(map(tuple, R.retrieve(queries, docs, "bm25", k=10).collect()))
    assert found["hybrid_rrf@10"] == sorted(map(tuple, R.fuse(ranked, R.retrieve(queries, docs, "dense", k=2000), 10).collect()))


@pytest.mark.parametrize("two", [False, True])
def test_scores_of_kinds_are_those_of_listed_pairs(spark, two):
    rng = np.random.default_rng(3)
    text = lambda n: None if rng.random() < 0.1 else " ".join(rng.choice(["red", "blue,", "blue", "ring", "rod"], rng.integers(1, n + 1)))
    df = spark.createDataFrame([(i, text(3), text(2), text(2), int(i % 7)) for i in range(60)], "id long, title string, brand string, kind string, same int")
    sides = [df.where("id % 2 = 0"), df.where("id % 2 = 1")] if two else [df]
    twin = sides[-1].select(F.col("id").alias("id2"), "same")
    truth = sides[0].select(F.col("id").alias("id1"), "same").join(twin, "same").where("true" if two else "id1 < id2")
    columns, thetas = ["title", "brand", "kind"], [0.0, 0.25, 1 / 3, 0.5, 1.0]
    right = lambda frames: frames[1] if two else None
    known = [x.fillna("") for x in sides]  # a missing text has no words
    want = entities.confusion(matching.Matcher(known[0], truth, "id", columns, right=right(known)).scored(False, 0.5, "js"), truth, thetas).collect()
    got = matching.Matcher(sides[0], truth if two else ["same"], "id", columns, right=right(sides))
    assert got.confusion(False, 0.5, "js", thetas).collect() == want


def test_a_plan_is_judged_by_one_pass_over_its_rows(spark):
    rows = [(float(i % 9), float(i * i % 5), int(i * i % 9 + i % 4 > 6), int(i % 3 == 0)) for i in range(400)]
    read = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, "a double, b double, y int, s int").repartition(2)
    seen = df.withColumn("a", F.udf(lambda x: (read.add(1), x)[1], "double").asNondeterministic()("a"))
    roles = Roles(target="y", sensitive="s")
    models.evaluate(seen, roles, "lr")
    assert read.value == len(rows)
    predicted = models.predict(df, roles, "lr").cache()
    for name in ("accuracy_score", "sp", "f-1", "mae", "rmse", "equalized_odds"):
        assert models.evaluate(df, roles, "lr", name) == pytest.approx(utility(predicted, name, "y", "prediction", "s"), abs=1e-12)
