import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from featurelake.operators import evaluate as ev
from featurelake.operators import explain, score, split, train
from featurelake.sources.serving import ServingStore

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(400):
        a, b, c = rng.random(), rng.random(), rng.random()
        data.append((f"r{i}", a, b, c, float(a + b * c + rng.gauss(0, 0.1) > 0.9)))
    df = spark.createDataFrame(data, "id string, a double, b double, c double, label double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).cache()


@pytest.fixture(scope="module")
def forest(rows):
    return train.train(rows, "random_forest", numTrees=5, maxDepth=4)


# -- split and weights -------------------------------------------------------------------------------


def test_split_is_exact_per_class(rows):
    sizes = {(r.label, r["split"]): r["count"] for r in split.stratified_split(rows, "label", "id").groupBy(
        "label", "split").count().collect()}
    for label in (0.0, 1.0):
        n = sizes[label, "test"] + sizes[label, "train"]
        assert sizes[label, "test"] == round(n * 0.2)


def test_folds_differ_by_at_most_one(rows):
    folds = split.stratified_folds(rows, "label", "id")
    assert folds.count() == 400
    for label in (0.0, 1.0):
        sizes = [r["count"] for r in folds.where(F.col("label") == label).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_balanced_weights_sum_to_the_rows(rows):
    assert split.with_class_weight(rows, "label").agg(F.sum("weight")).first()[0] == pytest.approx(400)
    with pytest.raises(ValueError):
        split.with_class_weight(rows.withColumn("label", F.monotonically_increasing_id() % 3), "label")


# -- metrics -----------------------------------------------------------------------------------------


def test_metrics_of_a_known_table(spark):
    cells = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4
    df = spark.createDataFrame(cells, "label int, prediction int")
    row = ev.binary_metrics(df).first()
    assert (row.accuracy, row.precision, row.recall, row.f1_score) == (0.7, 0.6, 0.75, 0.6667)
    report = {r["class"]: r for r in ev.classification_report(df).collect()}
    assert report["0"].support == 6 and report["weighted avg"].recall == 0.7 and report["accuracy"].f1_score == 0.7


def test_zero_division_gives_zero_and_empty_cells_exist(spark):
    df = spark.createDataFrame([(0, 0)], "label int, prediction int")
    row = ev.binary_metrics(df).first()
    assert (row.precision, row.recall, row.f1_score, row.accuracy) == (0.0, 0.0, 0.0, 1.0)
    assert ev.confusion_matrix(df).count() == 4


@pytest.mark.parametrize("digits", [1, 12])
def test_auc_equals_pair_counting(spark, digits):
    rng = random.Random(5)
    data = [(rng.randrange(2), round(rng.random(), digits)) for _ in range(120)]
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(data, "label int, score double")
    assert ev.roc_auc(df).first().roc_auc == round(want, 4)
    both = df.withColumn("g", F.lit(0)).unionByName(df.withColumns({"g": F.lit(1), "score": -F.col("score")}))
    out = {r.g: r.roc_auc for r in ev.roc_auc(both, keys=["g"]).collect()}
    assert out[0] == round(want, 4) and out[1] == pytest.approx(1 - want, abs=1e-4)


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_auc_of_few_buckets_hot_scores_and_odd_values(spark, buckets):
    rng = random.Random(8)
    inf, nan = float("inf"), float("nan")
    make = [lambda: 0.5, lambda: 0.5, lambda: round(rng.random(), 1), lambda: rng.random(), lambda: rng.choice([-inf, inf, 0.0, -0.0, nan, None])]
    data = [(rng.choice("xyz"), rng.choice([0, 1, 1]), rng.choice(make)()) for _ in range(900)] + [("one", 1, 0.3), ("one", 1, nan)]
    place = lambda s: (0, 0) if s is None else (2, 0) if s != s else (1, s)
    want = {}
    for g in "xyz":
        pos, neg = [place(s) for k, y, s in data if k == g and y], [place(s) for k, y, s in data if k == g and not y]
        want[g] = round(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)), 4)
    df = spark.createDataFrame(data, "g string, label int, score double")
    assert {r.g: r.roc_auc for r in ev.roc_auc(df, keys=["g"], buckets=buckets).collect()} == {**want, "one": None}
    assert ev.roc_auc(df.where("false"), buckets=buckets).first().roc_auc is None


def test_auc_moves_rows_once(spark, rows, forest):
    text = ev.roc_auc(train.predict_rows(forest, rows))._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY") == 1 and "_SUCCESS" not in text
    # What else is exchanged are counts of places: partial sums stand below each of those exchanges.
    assert text.count("Exchange hashpartitioning(__place") == 2


def test_no_task_of_the_ranks_grows_with_the_rows(spark, monkeypatch):
    rng = random.Random(9)
    data = [(rng.randrange(2), rng.random() if i % 3 else 0.5) for i in range(3000)]
    df = spark.createDataFrame(data, "label int, score double")
    want = ev.roc_auc(df).first().roc_auc
    assert len(ev.score_cuts(df, "score", 8, 100)) >= 20
    monkeypatch.setattr(ev, "ROWS_A_BUCKET", 100)
    many = ev.roc_auc(df)
    assert many.first().roc_auc == want
    text = many._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in text and "REPARTITION_BY_COL" not in text


def test_auc_equals_the_library(rows, forest):
    scored = train.predict_rows(forest, rows)
    want = BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(scored)
    assert train.evaluate(scored).first().roc_auc == pytest.approx(want, abs=2e-3)


def test_auc_of_one_class_is_null(spark):
    assert ev.roc_auc(spark.createDataFrame([(1, 0.5)], "label int, score double")).first().roc_auc is None


# -- models ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind,settings", [("random_forest", {"numTrees": 5, "maxDepth": 4}),
                                           ("gradient_boosting", {"maxIter": 5, "maxDepth": 3}), ("logistic_regression", {})])
def test_each_model_type_learns(rows, kind, settings):
    scored = train.predict_rows(train.train(rows, kind, **settings), rows)
    assert train.evaluate(scored).first().accuracy > 0.8


def test_trees_of_many_rows_train_on_all_cores(spark, rows, monkeypatch):
    """One row group is one task; dealt out, no task has more rows than its share, whatever the size."""
    one = rows.coalesce(1).withColumn("weight", F.lit(1.0))
    for limit, tasks in [(10_000, 8), (30, 16)]:
        monkeypatch.setattr(train, "ROWS_A_TASK", limit)
        ready = train.dealt(one, 400)
        sizes = [n for n in ready.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
        assert len(sizes) == tasks and max(sizes) <= 400 / tasks + 2
        assert ready.exceptAll(one.select("label", "weight", "features")).count() == 0
        ready.unpersist()
    used = []
    monkeypatch.setattr(train, "DEALT_FROM", 1)
    monkeypatch.setattr(train, "dealt", lambda df, n, real=train.dealt: used.append(n) or real(df, n))
    for kind, settings in [("random_forest", {"numTrees": 5, "maxDepth": 4}), ("gradient_boosting", {"maxIter": 3, "maxDepth": 3})]:
        assert train.evaluate(train.predict_rows(train.train(rows.drop("features"), kind, stages=[
            VectorAssembler(inputCols=NAMES, outputCol="features")], **settings), rows.drop("features"))).first().accuracy > 0.8
    assert used == [400, 400]


def test_batches_are_scored_by_all_cores(rows, forest):
    assert score.score_batch(forest, rows.coalesce(1), "v1", key="id").rdd.getNumPartitions() == 8


def test_unknown_model_type(rows):
    with pytest.raises(ValueError):
        train.train(rows, "nearest_neighbour")


def test_importances_are_ordered(forest):
    got = train.feature_importance(forest, NAMES).collect()
    assert sorted(r.feature for r in got) == NAMES
    assert [r.importance for r in got] == sorted((r.importance for r in got), reverse=True)


def test_cross_validation(rows):
    out = {r.metric: r for r in train.cross_validate(rows, "logistic_regression", "id", folds=3).collect()}
    assert set(out) == set(train.METRICS)
    assert all(0 <= r["mean"] <= 1 and r["std"] >= 0 for r in out.values())


def test_scores_are_consistent_and_survive_saving(rows, forest, base):
    loaded = train.load_model(train.save_model(forest, base, "v1"))
    one = score.score_batch(forest, rows, "v1", key="id").orderBy("prediction_id").collect()
    two = score.score_batch(loaded, rows, "v1", key="id").orderBy("prediction_id").collect()
    assert one == two and len(one) == 400
    assert all(abs(r.probability_no_turning_point + r.probability_turning_point - 1) < 2e-4 for r in one)
    assert all(r.confidence == max(r.probability_no_turning_point, r.probability_turning_point) for r in one)
    assert {r.label for r in one if r.prediction == 1} == {"Ponto de Virada Provável"}


def test_score_by_ids(spark, rows, forest, base):
    store = ServingStore(spark, base)
    store.materialize(rows.drop("label"), "t", "id")
    ids = spark.createDataFrame([("r1",), ("r2",), ("absent",)], "id string")
    out = score.score_by_ids(forest, store, "t", ids, "v1").collect()
    assert sorted(r.prediction_id for r in out) == ["r1", "r2"] and out[0].loaded_from == "serving"
    none = score.score_by_ids(forest, store, "t", ids.where("id = 'absent'"), "v1")
    assert none.count() == 0


def test_random_ids_without_a_key(rows, forest):
    assert score.score_batch(forest, rows, "v1").select("prediction_id").distinct().count() == 400


# -- explanations ------------------------------------------------------------------------------------


def expectation(tree, x, known, node=0):
    """Path-dependent expectation when only the known features are fixed."""
    if tree.left[node] < 0:
        return tree.value[node]
    children, f = (tree.left[node], tree.right[node]), tree.feature[node]
    if f in known:
        return expectation(tree, x, known, children[0 if x[f] <= tree.limit[node] else 1])
    return sum(tree.share[c] * expectation(tree, x, known, c) for c in children)


def shapley(trees, x, n):
    phi = [0.0] * n
    for f in range(n):
        others = [g for g in range(n) if g != f]
        for size in range(n):
            for subset in itertools.combinations(others, size):
                w = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                phi[f] += w * sum(expectation(t, x, {*subset, f}) - expectation(t, x, set(subset)) for t in trees)
    return phi


def grown(rng, depth, features):
    """A random tree as node arrays; features repeat along its paths."""
    tree = explain.Tree([], [], [], [], [], [])

    def add(level, share):
        i = len(tree.feature)
        for values, v in ((tree.feature, -1), (tree.limit, 0.0), (tree.left, -1), (tree.right, -1), (tree.share, share), (tree.value, rng.gauss(0, 1))):
            values.append(v)
        if level and rng.random() < 0.9:
            part = rng.uniform(0.05, 0.95)
            tree.feature[i], tree.limit[i] = rng.randrange(features), rng.random()
            tree.left[i] = add(level - 1, part)
            tree.right[i] = add(level - 1, 1 - part)
        return i

    add(depth, 1.0)
    return tree


@pytest.mark.parametrize("features,depth", [(1, 3), (2, 6), (4, 7), (6, 8)])
def test_tree_walk_equals_all_subsets(features, depth):
    rng = random.Random(features)
    trees = [grown(rng, depth, features) for _ in range(3)] + [grown(rng, 0, features)]
    x = np.array([[rng.random() for _ in range(5)] for _ in range(features)])
    phi = np.zeros_like(x)
    for tree in trees:
        explain.tree_values(tree, x, phi)
    for r in range(5):
        assert list(phi[:, r]) == pytest.approx(shapley(trees, x[:, r], features), abs=1e-12)


def test_paths_of_more_than_twelve_features_add_up():
    rng = random.Random(4)
    tree = grown(rng, 15, 40)
    x = np.array([[rng.random() for _ in range(50)] for _ in range(40)])
    phi = np.zeros_like(x)
    explain.tree_values(tree, x, phi)
    assert explain.most_features(tree) > 12
    known = set(range(40))
    assert list(phi.sum(axis=0) + explain.expected_value(tree)) == pytest.approx([expectation(tree, x[:, r], known) for r in range(50)], abs=1e-11)


def test_tree_contributions_equal_brute_force_and_add_up(spark, rows, forest, base):
    trees = explain.tree_nodes(spark, train.stage_path(train.save_model(forest, base, "v1"), forest))
    some = rows.where("a < 0.1")
    got = {r.id: r for r in explain.tree_contributions(some, trees, NAMES, "id").collect()}
    scored = {r.id: r for r in train.predict_rows(forest, some).collect()}
    assert len(got) == len(scored) > 10
    for key, row in got.items():
        assert [c.feature for c in row.contributions] == NAMES
        values = [c.contribution for c in row.contributions]
        assert values == pytest.approx(shapley(trees, list(scored[key].features), 3), abs=1e-9)
        assert row.base_value + sum(values) == pytest.approx(scored[key].score, abs=1e-9)
    assert explain.tree_contributions(rows.where("false"), trees, NAMES, "id").count() == 0


def test_rows_of_one_cell_are_explained_once(spark, rows, forest, base, monkeypatch):
    """Repeated and null keys keep their rows; the work is that of distinct cells, in all tasks together."""
    trees = explain.tree_nodes(spark, train.stage_path(train.save_model(forest, base, "v1"), forest))
    some = rows.where("a < 0.3")
    want = {tuple(r.contributions) for r in explain.tree_contributions(some, trees, NAMES, "id").collect()}
    many = some.crossJoin(spark.range(20).toDF("copy")).withColumn("id", F.when(F.col("id") != "r1", F.lit("same")))
    explained = spark.sparkContext.accumulator(0)
    real = explain.tree_values

    def counted(tree, x, phi):
        explained.add(x.shape[1])
        real(tree, x, phi)

    parts = explain.tree_contributions(some, trees, NAMES, "id")
    assert "Exchange RoundRobinPartitioning(8)" in parts._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(explain, "tree_values", counted)
    got = explain.tree_contributions(many.select("id", "features"), trees, NAMES, "id").collect()
    assert len(got) == 20 * some.count() and {tuple(r.contributions) for r in got} == want
    assert 0 < explained.value <= len(trees) * some.count()


def test_boosted_contributions_add_up_to_the_margin(spark, rows, base):
    model = train.train(rows, "gradient_boosting", maxIter=4, maxDepth=3)
    trees = explain.tree_nodes(spark, train.stage_path(train.save_model(model, base, "v1"), model), boosted=True)
    got = {r.id: r.base_value + sum(c.contribution for c in r.contributions)
           for r in explain.tree_contributions(rows, trees, NAMES, "id").collect()}
    for r in train.predict_rows(model, rows).select("id", "score").collect():
        assert 1 / (1 + math.exp(-2 * got[r.id])) == pytest.approx(r.score, abs=1e-9)


def test_top_contributions_sort_by_magnitude(spark):
    df = spark.createDataFrame([([("x", 0.1), ("y", -0.9), ("z", 0.5), ("w", 0.5)],)],
                               "c array<struct<feature: string, contribution: double>>")
    assert [p.feature for p in df.select(explain.top_contributions(F.col("c"), 3).alias("t")).first().t] == ["y", "w", "z"]
    assert len(df.select(explain.top_contributions(F.col("c"), None).alias("t")).first().t) == 4


def test_linear_contributions_add_up(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None)], "x double, y double")
    coef = {"x": 0.5, "y": -1.0}
    means = explain.feature_means(df, ["x", "y"])
    assert means == {"x": 2.0, "y": 1.0}
    out = df.select(explain.linear_contributions(df, coef, means).alias("c"), score.linear_score(df, coef, 0.2).alias("p"))
    base = 0.2 + sum(w * means[c] for c, w in coef.items())
    for r in out.collect():
        z = base + sum(c.contribution for c in r.c)
        assert 1 / (1 + math.exp(-z)) == pytest.approx(r.p)
