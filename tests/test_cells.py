"""Trees on cells: what a cell holds, and that models are those of the rows."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from featurelake.operators import cells, explain, train

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def coarse(spark):
    """4,000 rows of 6 * 5 * 7 different inputs; some come once."""
    rng = random.Random(4)
    data = []
    for i in range(4000):
        a, b, c = float(rng.choice([-3, 0, 1, 2, 7, 100])), min(4, int(rng.expovariate(1))) / 2, float(rng.randrange(7) ** 3)
        data.append((f"r{i}", a, b, c, float(a + 3 * b + c / 100 + rng.gauss(0, 1) > 3)))
    df = spark.createDataFrame(data, "id string, a double, b double, c double, label double").withColumn("weight", 1 + F.col("label"))
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).cache()


def scores(model, rows):
    return {r["id"]: r["score"] for r in train.predict_rows(model, rows).select("id", "score").collect()}


def test_values_are_all_there_are_or_quantiles():
    assert cells.values_of([(3.0, 1.0), (1.0, 5.0), (3.0, 2.0)], 3) == [1.0, 3.0]
    assert cells.values_of([(float(i), 1.0) for i in range(100)], 4) == [12.0, 37.0, 62.0, 87.0]
    assert cells.values_of([(0.0, 900.0)] + [(float(i), 1.0) for i in range(1, 101)], 10) == [0.0, 50.0]
    assert cells.values_of([(1.0, 1.0), (1.0 + 2**-52, 1.0)], 4) == [1.0]


def test_a_row_lies_in_the_cell_between_its_candidates(spark):
    rng = random.Random(5)
    rows = [(float(i % 2), 1.0, rng.choice([rng.uniform(-5, 5), 0.5, 1.5, -2.0, 1e300, -1e300]), 7.0) for i in range(500)]
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.createDataFrame(rows, "label double, weight double, x double, y double"))
    values = [[-2.0, 0.0, 1.0, 2.0, 4.0], [7.0]]
    limits = [(p + q) / 2 for p, q in zip(values[0], values[0][1:])]
    expected = {}
    for label, _, x, _ in rows:
        key = (label, values[0][sum(x > t for t in limits)])
        expected[key] = expected.get(key, 0) + 1
    assert {(r["label"], r["x0"]): r["rows"] for r in cells.counted(df, values).collect()} == expected


def test_boosting_on_cells_is_boosting_on_rows(coarse):
    one = coarse.withColumn("weight", F.lit(1.0))
    found = cells.cells_of(one, 4000, 32)
    assert found.count() < 450 and found.agg(F.sum("rows")).first()[0] == 4000
    kind = GBTClassifier(maxIter=5, maxDepth=3, seed=1)
    own, rows = scores(cells.boosted(found, kind), coarse), scores(kind.fit(coarse), coarse)
    assert max(abs(own[i] - rows[i]) for i in rows) < 1e-9


@pytest.mark.parametrize("least", [1, 2, 5])
def test_a_tree_on_cells_is_a_tree_on_rows(coarse, least):
    """Without chance in rows and features a tree is fixed, limits on its nodes' rows included."""
    kind = RandomForestClassifier(weightCol="weight", numTrees=2, bootstrap=False, featureSubsetStrategy="all", maxDepth=8,
                                  minInstancesPerNode=least, seed=1)
    own, rows = scores(cells.forest(cells.cells_of(coarse, 4000, 32), kind), coarse), scores(kind.fit(coarse), coarse)
    assert max(abs(own[i] - rows[i]) for i in rows) < 1e-9


def test_each_tree_draws_its_own_bootstrap(spark):
    sizes = spark.range(3000).select(F.col("id").alias("cell"), (F.col("id") % 50 + 1).alias("rows"))
    total = sizes.agg(F.sum("rows")).first()[0]
    takes = lambda parts: sizes.repartition(parts).select("cell", "rows", cells.drawn(1.0, 6, True, 42)("cell", "rows").alias("t"))
    once, again = takes(2), takes(7)
    assert once.exceptAll(again).count() == 0
    drawn = once.select("rows", F.posexplode("t").alias("tree", "n"))
    per_tree = [r["n"] for r in drawn.groupBy("tree").agg(F.sum("n").alias("n")).collect()]
    assert len(set(per_tree)) == 6 and all(abs(n - total) < 5 * total ** 0.5 for n in per_tree)
    spread = drawn.agg(F.avg((F.col("n") - F.col("rows")) ** 2 / F.col("rows"))).first()[0]
    assert 0.93 < spread < 1.07  # a Poisson number's variance is its mean


def test_many_rows_train_on_their_cells(spark, coarse, base, monkeypatch):
    """The trees' passes see cells, so their work does not grow with the rows; the model is saved, loaded and explained like any other."""
    monkeypatch.setattr(train, "DEALT_FROM", 1)
    monkeypatch.setattr(train, "CELLS_FROM", 1)
    monkeypatch.setattr(train, "dealt", lambda df, n: pytest.fail("trees were trained on rows"))
    for kind, settings in [("gradient_boosting", {"maxIter": 3, "maxDepth": 3}), ("random_forest", {"numTrees": 5, "maxDepth": 4})]:
        model = train.train(coarse.drop("weight", "features"), kind, stages=[VectorAssembler(inputCols=NAMES, outputCol="features")], **settings)
        assert train.evaluate(train.predict_rows(model, coarse.drop("features"))).first().accuracy > 0.8
    assert model.stages[-1].getNumTrees == 5 and {t.depth for t in model.stages[-1].trees} == {4}
    again = train.train(coarse.drop("weight"), "random_forest", numTrees=5, maxDepth=4)
    path = train.save_model(model, base, "v1")
    loaded, ids = train.load_model(path), coarse.drop("features", "weight")
    own = scores(model, ids)
    assert scores(loaded, ids) == own
    same = scores(again, coarse)
    assert max(abs(own[i] - same[i]) for i in own) < 1e-9
    parts = explain.tree_contributions(coarse, explain.tree_nodes(spark, train.stage_path(path, model)), NAMES, "id").collect()
    assert all(abs(p["base_value"] + sum(c["contribution"] for c in p["contributions"]) - own[p["id"]]) < 1e-9 for p in parts)


def test_what_cells_cannot_serve_trains_on_rows(spark, coarse):
    assert cells.cells_of(coarse, 400, 32) is None  # too few rows a cell
    assert cells.cells_of(coarse.withColumn("label", F.col("label") + 1), 4000, 32) is None
    codes = VectorAssembler(inputCols=["k"], outputCol="features").transform(
        coarse.select("label", "weight", F.col("b").cast("int").cast("double").alias("k", metadata={"ml_attr": {"type": "nominal", "vals": ["x", "y", "z"]}})))
    assert cells.cells_of(codes, 4000, 32) is None


def test_one_row_stands_for_a_cell_where_weights_tell_the_rows(coarse, monkeypatch):
    """Two rows a node by the nodes' weights: trees see each cell once and are those of the rows."""
    assert cells.least_weight(1.0, 1.4, 2) == pytest.approx(1.7) and cells.least_weight(1.0, 1.2, 5) == pytest.approx(4.9)
    assert cells.least_weight(1.0, 2.0, 2) is None and cells.least_weight(1.0, 1.4, 5) is None and cells.least_weight(1.0, 1.0, 1) is None
    asked, weighted = [], cells.weighted
    monkeypatch.setattr(cells, "weighted", lambda *a: asked.append(weighted(*a)) or asked[-1])
    rows = coarse.withColumn("weight", F.when(F.col("label") == 1, 1.4).otherwise(1.0))
    kind = RandomForestClassifier(weightCol="weight", numTrees=2, bootstrap=False, featureSubsetStrategy="all", maxDepth=10,
                                  minInstancesPerNode=2, seed=1)
    found = cells.cells_of(rows, 4000, 32)
    own, expected = scores(cells.forest(found, kind), rows), scores(kind.fit(rows), rows)
    assert max(abs(own[i] - expected[i]) for i in expected) < 1e-9
    assert [sample.count() for sample in asked] == [found.count()] * 2


def test_a_value_of_one_row_is_a_cell_of_its_own(spark):
    """A feature of few values keeps them all; quantiles would pass over the one row between two values of thousands."""
    rows = spark.range(20_001).select((F.col("id") % 2).cast("double").alias("label"), F.lit(1.0).alias("weight"),
                                      F.when(F.col("id") == 20_000, 2.5).otherwise((F.col("id") % 5).cast("double")).alias("a"),
                                      F.xxhash64("id").cast("double").alias("b"))
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    few, many = cells.feature_values(ready, 2, 32)
    assert few == [0.0, 1.0, 2.0, 2.5, 3.0, 4.0] and len(many) == 32


def test_as_many_examples_are_asked_as_the_rarest_value_needs(spark):
    even = spark.range(10_000).select((F.col("id") % 4).cast("double").alias("x0"), F.lit(0.0).alias("x1"))
    assert cells.share_to_ask(even, 1.0) == pytest.approx(40 / (2500 * 0.632), rel=0.01)
    rare = spark.createDataFrame([(9.0, 0.0)], "x0 double, x1 double")
    assert cells.share_to_ask(even.unionByName(rare), 1.0) == 1.0
