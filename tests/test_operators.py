"""Operators on hand-made frames: fixtures, algebraic properties, plan edits and searches."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millwright.data import Roles, numeric_columns, without_nan
from millwright.functions import profile as P
from millwright.functions.quantiles import midpoint, nth_values, quantiles
from millwright.operators import duplicates, entities, noise
from millwright.operators.base import fit
from millwright.operators.branch import align, branch
from millwright.plans import causes, search
from millwright.plans.plan import Plan, canonical, delete, from_vector, insert, swap, valid

ID = Roles(row_id="id")


def test_scalers_on_the_four_row_fixture(spark):
    df = spark.createDataFrame([(i, 100.0 * i, 2.0 * i) for i in range(1, 5)], "id long, a double, b double")
    out = fit("normalization", "ss", df, ID)(df).agg(F.avg("a"), F.stddev_pop("a"), F.avg("b"), F.stddev_pop("b")).first()
    assert np.allclose(out, [0, 1, 0, 1])
    low = fit("normalization", "mm", df, ID)(df).agg(F.min("a"), F.max("b")).first()
    assert tuple(low) == (0.0, 1.0)
    same = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, a double")
    assert {r["a"] for r in fit("normalization", "ss", same, ID)(same).collect()} == {0.0}


def test_fit_on_train_applies_to_test(spark):
    train, test = spark.createDataFrame([(1, 1.0), (2, 3.0)], "id long, a double"), spark.createDataFrame([(9, 5.0), (8, None)], "id long, a double")
    assert sorted((r["a"] for r in fit("missing_value", "mean", train, ID)(test).collect())) == [2.0, 5.0]


def test_invalid_tokens_and_numbers(spark):
    tokens = ["", " ", "NA", "n/a", "None", "null", "NaN", "Unknown", "missing", "?", "ok"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "id long, t string")
    assert [r["t"] for r in fit("invalid_value", "regex", df, ID)(df).orderBy("id").collect()] == [None] * 10 + ["ok"]
    nums = spark.createDataFrame([(i, float(v)) for i, v in enumerate([-999, -9999, 999, 9999, 99999, 5])], "id long, v double")
    assert [r["v"] for r in fit("invalid_value", "both", nums, ID)(nums).orderBy("id").collect()] == [None] * 5 + [5.0]


def test_iqr_removes_the_outlier_and_keeps_constants(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 100.0])], "id long, v double")
    assert fit("outlier", "iqr", df, ID)(df).count() == 4
    same = spark.createDataFrame([(i, 7.0) for i in range(5)], "id long, v double")
    assert fit("outlier", "iqr", same, ID)(same).count() == 5


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0)], "id long, v double")
    assert [r["v"] for r in without_nan(df).orderBy("id").collect()] == [None, None, 1.0]
    assert numeric_columns(df, ID) == ["v"]


def test_quantiles_in_one_pass_and_by_ranges(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 1009).cast("double").alias("v"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    assert np.allclose(quantiles(df, ["v"], probs)["v"], quantiles(df, ["v"], probs, one_pass=10)["v"])
    every = sorted(r["v"] for r in df.collect())
    assert nth_values(df, "v", [0, 1234, 4999], few=20) == [every[0], every[1234], every[4999]]
    assert midpoint(df, "v", [0.5]) == [(every[2499] + every[2500]) / 2]
    assert quantiles(df.limit(0), ["v"], [0.5]) == {"v": [None]}


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id long, t string")
    one = fit("deduplication", "dd", df, ID)(df)
    assert sorted(r["id"] for r in one.collect()) == [1, 4] == sorted(r["id"] for r in fit("deduplication", "dd", one, ID)(one).collect())


@settings(max_examples=40, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_edit_distances(a, b):
    d = duplicates.damerau(a, b)
    assert d == duplicates.damerau(b, a) and (d == 0) == (a == b) and abs(len(a) - len(b)) <= d <= max(len(a), len(b))
    assert 0 <= duplicates.jaro_winkler(a, b) <= 1 and duplicates.jaro_winkler(a, a) == 1


def test_known_edit_values():
    assert duplicates.damerau("ab", "ba") == 1 and duplicates.damerau("kitten", "sitting") == 3
    assert abs(duplicates.jaro_winkler("martha", "marhta") - 0.9611) < 1e-4


def test_blocks_and_jaccard(spark):
    df = spark.createDataFrame([(1, "AAAA hdjsk fhdsjk hello"), (2, "hello hi")], "id long, t string")
    shared = entities.blocks(df, "id", "t").groupBy("token").count().where("count > 1").collect()
    assert [r["token"] for r in shared] == ["hello"]
    got = spark.createDataFrame([("a, b c", "b c d")], "x string, y string").select(entities.jaccard(entities.word_set("x"), entities.word_set("y")).alias("j")).first()
    assert got["j"] == 0.5


def test_punctuation_keeps_letters(spark):
    df = spark.createDataFrame([(1, "café!  a-b")], "id long, t string")
    assert fit("punctuation", "apply", df, ID)(df).first()["t"] == "café  ab"


def test_noise_is_undone_by_its_cleaner(spark):
    df = spark.range(1, 101).select(F.col("id"), (F.col("id") * 1.5).alias("v"), F.lit("x").alias("t"))
    hit = {r["id"] for r in noise.chosen(df, "id", 0.1, 42).collect()}
    hurt = noise.invalid(df, ID, 0.1)
    clean = fit("invalid_value", "both", hurt, ID)(hurt)
    assert {r["id"] for r in clean.where("v is null").collect()} == hit and len(hit) == 10
    assert noise.duplicate_rows(df, ID, 0.05).count() == 105


def test_branch_and_align(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "id long, v double")
    out = branch(df, "v > 3", lambda d: d.withColumn("v", F.col("v") * 10)).orderBy("id").collect()
    assert [r["v"] for r in out] == [2.0, None, 40.0]
    assert align(df, ["w", "id"]).columns == ["w", "id"]


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, t string")
    assert all(r["ok"] for r in P.check(df, P.discover(df, ["id", "t"])).collect())
    bad = P.check(df, [P.Constraint("t", max_nulls=0), P.Constraint("id", sign="negative")]).collect()
    assert not any(r["ok"] for r in bad)
    assert abs(P.f_tail(4.0, 2, 10) - 0.0527) < 0.001


def test_shuffle_partitions_do_not_matter(spark):
    df = spark.range(0, 500).select(F.col("id"), (F.col("id") % 37).cast("double").alias("v"))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, fit("sampling", "random", df, ID, fraction=0.1)(df).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == 50


PLAN = Plan((("invalid_value", "both"), ("missing_value", "mean"), ("normalization", "ss"), ("outlier", "iqr"), ("model", "lr")))


def test_plan_edits():
    assert swap(swap(PLAN, 2), 2) == PLAN and swap(PLAN, 0) is None and swap(PLAN, 3) is None
    assert delete(insert(PLAN, 2, "floating_point", "both"), 2) == PLAN and delete(PLAN, 0) is None
    assert canonical(Plan((("model", "lr"), ("outlier", "iqr"), ("missing_value", "mean"), ("outlier", "none")))).names() == ["missing_value", "outlier", "model"]
    assert not valid(PLAN, (("outlier", "normalization"),)) and from_vector(PLAN.names(), PLAN.vector()) == PLAN


def test_searches_reach_the_goal():
    utility = lambda v: sum((x - t) ** 2 for x, t in zip(v, (2, 3, 1), strict=True)) / 10
    sizes = [3, 4, 2]
    for got in (search.opaque((1, 1, 1), sizes, [0.1, -0.5, 0.2], utility, 0.0), search.search(search.grid(sizes), utility, 0.0), search.search(search.staged((1, 1, 1), sizes), utility, 0.0), search.search(search.random_order(search.grid(sizes)), utility, 0.0)):
        assert got.met and got.best == (2, 3, 1)
    assert search.two_phase(sizes, utility, 0.0).met
    near = lambda v: [(*v[:i], x, *v[i + 1 :]) for i in range(3) for x in (v[i] - 1, v[i] + 1) if 1 <= x <= sizes[i]]
    assert search.multi_start([(1, 1, 1), (3, 4, 2)], near, utility, 0.0).met
    start = Plan((("missing_value", "mean"), ("normalization", "none"), ("model", "lr")))
    good = lambda p: 0.1 if ("normalization", "mm") in p.steps else 0.9
    acts = search.ranked(search.interventions(start, ["outlier"]), lambda a: float(a.step == "normalization"), lambda a: 0.0)
    assert search.glass_box(start, acts, good, 0.2).met
    arm, _ = search.thompson(3, lambda a: [0.1, 0.9, 0.4][a], 200)
    walk, _ = search.q_learning([["a", "b"], ["c", "d"]], lambda p: float(p == ("b", "c")))
    assert arm == 1 and walk == ("b", "c")


SPACE = {"p0": list("abcdef"), "p1": [0, 1, 2], "p2": list("abcdef")}


def test_causes_name_the_guilty_parameter():
    ok = lambda c: c["p1"] != 1
    known = [({"p0": a, "p1": b, "p2": "a"}, b != 1) for a, b in itertools.product("abc", (0, 1, 2))]
    runs = causes.Runs(SPACE, ok, known)
    assert causes.shortcut(runs, {"p0": "a", "p1": 0, "p2": "b"}, {"p0": "f", "p1": 1, "p2": "c"}) == {"p1": 1}
    assert causes.stacked_shortcut(runs, [{"p0": "a", "p1": 0, "p2": "b"}, {"p0": "b", "p1": 2, "p2": "d"}], {"p0": "f", "p1": 1, "p2": "c"}) == {"p1": 1}
    assert all(any(c.parameter == "p1" for c in p) for p in causes.debugging_trees(runs)) and causes.debugging_trees(runs)
    assert causes.minimal_pairs(causes.Runs(SPACE, ok, known)) == [{"p1": 1}]
    assert causes.group_testing(list(range(9)), lambda g: 4 in g or 7 in g) == [4, 7]
    bad = [dict(zip(SPACE, v, strict=True)) for v in itertools.product(*SPACE.values()) if v[1] == 1]
    assert causes.minimal_causes(bad, SPACE) == [{"p1": {1}}]


def test_covering_design_and_minimisation():
    design = causes.covering_design({"a": [0, 1], "b": [0, 1, 2], "c": ["x", "y"]})
    for p, q in itertools.combinations("abc", 2):
        assert {(c[p], c[q]) for c in design} == set(itertools.product({"a": [0, 1], "b": [0, 1, 2], "c": ["x", "y"]}[p], {"a": [0, 1], "b": [0, 1, 2], "c": ["x", "y"]}[q]))
    for terms in ([0, 1, 2, 5, 6, 7], [4, 8, 10, 11, 12, 15]):
        got = causes.minimise(terms, 4)
        assert {m for m in range(16) if any(all(a in ("-", b) for a, b in zip(p, f"{m:04b}", strict=True)) for p in got)} == set(terms)


def test_readers(spark, tmp_path):
    from millwright.sources import readers

    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    readers.csv_to_parquet(spark, f"{tmp_path}/a.csv", f"{tmp_path}/p.parquet")
    assert sorted(map(tuple, readers.read_any(spark, f"{tmp_path}/p.parquet").collect())) == [(1, "a"), (2, "b")]
    runs = spark.createDataFrame([("v1", 2, "False"), ("v2", 2, "True")], "p1 string, p2 int, result string")
    readers.write_runs(runs, f"{tmp_path}/runs.json")
    got = {(r["param"], r["value"]): (r["good"], r["bad"]) for r in readers.good_bad_counts(readers.read_runs(spark, f"{tmp_path}/runs.json"), ["p1", "p2"]).collect()}
    assert got == {("p1", "v1"): (0, 1), ("p1", "v2"): (1, 0), ("p2", "2"): (1, 1)}
    assert readers.task(runs, "result") == "classification"
    with pytest.raises(ValueError):
        readers.read_any(spark, "a.xyz")


def test_streams_equal_their_batches(spark, tmp_path):
    from millwright.streaming import events as S

    df = spark.range(0, 200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("t").alias("event_type"), F.col("id").cast("double").alias("value"))
    df.repartition(3).write.parquet(f"{tmp_path}/e")
    stream = lambda: S.read(spark, f"{tmp_path}/e", df.schema)
    assert sorted(map(tuple, S.replay(S.tumbling(stream()), "t1", "complete").collect())) == sorted(map(tuple, S.tumbling(df).collect()))
    seen = S.replay(S.first_seen(stream(), "user_id"), "t2").collect()
    assert len(seen) == 5 == S.first_seen(df, "user_id").count()


def test_history_similarity_takes_every_row(spark, tmp_path):
    import __spark_entry__ as entry

    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(2)), rng.standard_normal(2).tolist()) for i in range(1200)] + [(1200, 0, [0.0, 0.0]), (1211, 1, [0.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["k"], r["label"]): r["similarity"] for r in entry.queries()["history_similarity_whole"](spark, str(tmp_path)).collect()}
    cosines = {}
    for i, a, x in rows:
        for j, b, y in rows:
            if i % 10 == j % 10 and a == b and i // 10 % 2 == 0 and j // 10 % 2 == 1 and any(x) and any(y):
                cosines.setdefault((i % 10, a), []).append(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    assert got.keys() == cosines.keys() and all(abs(got[k] - np.mean(v)) < 2e-6 for k, v in cosines.items())


def test_profile_similarity_makes_no_pairs(spark):
    from millwright.plans import history

    runs = spark.range(200000).select(F.lit(1).alias("k"), F.lit(3.0).alias("p"), (F.col("id") % 2 * 8 - 4.0).alias("q"))
    assert [tuple(r) for r in history.profile_similarity(runs, runs.where("q > 0"), ["k"], ["p", "q"]).collect()] == [(1, round((1 + (9 - 16) / 25) / 2, 6))]


def test_every_query_vector_has_its_neighbours(spark, tmp_path):
    import __spark_entry__ as entry

    rng = np.random.default_rng(6)
    rows = {i: rng.standard_normal(6) for i in range(1, 640)} | {700: np.zeros(6), 701: rng.standard_normal(6)}
    rows[300] = rows[200]
    spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()], "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["s"]) for r in entry.queries()["cosine_topk_each"](spark, str(tmp_path)).collect())
    want = []
    for q in range(100, 700, 100):
        s = sorted((-round(float(rows[q] @ v / np.linalg.norm(rows[q]) / np.linalg.norm(v)), 6), i) for i, v in rows.items() if i != q and v.any())
        want += [(q, n + 1, i, -c) for n, (c, i) in enumerate(s[:10])]
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=1.1e-6)


def test_kernel_axes_with_a_hot_row_come_from_all_rows(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([np.tile([[0.5, -0.2]], (1500, 1)), rng.standard_normal((100, 2))])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double").repartition(5)
    rows = fit("poly_pca", "kernelpca", df, ID, k=3)(df).orderBy("id").collect()
    got = np.array([[r["pc0"], r["pc1"], r["pc2"]] for r in rows])
    t = np.column_stack([x[:, 0], x[:, 1], x[:, 0] ** 2, x[:, 0] * x[:, 1], x[:, 1] ** 2])
    t = (t - t.mean(0)) / t.std(0)
    gram = np.exp(-((t[:, None, :] - t[None, :, :]) ** 2).sum(2) / 5)
    gram = gram - gram.mean(0)[None, :] - gram.mean(1)[:, None] + gram.mean()  # centred about the mean of all rows
    value, vector = np.linalg.eigh(gram)
    want = gram @ vector[:, ::-1][:, :3] / np.sqrt(value[::-1][:3])
    assert np.allclose(np.abs(got), np.abs(want), rtol=0.01, atol=0.01)


def test_recall_wants_documents_that_quote_the_whole_item(spark, tmp_path):
    import __spark_entry__ as entry

    item = " ".join(f"word{i}" for i in range(30))
    texts = [f"before {item} after", item[:70] + " and then something else", f"late {item}"] + [f"other text {i}" for i in range(9)] + ["plain " * 40 + item]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, item[:80] + " " + "unquoted " * 5)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [tuple(r) for r in entry.queries()["rag_recall"](spark, str(tmp_path)).collect()] == [(1, 1.0)]
