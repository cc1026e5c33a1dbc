import random
import statistics

import pytest
from pyspark.sql import functions as F

from featurelake.functions import ordering


def test_global_index_equals_sorted_position(spark):
    rows = [(random.Random(i).randrange(5), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = {(r.a, r.b): r.idx for r in ordering.global_index(df, [F.col("a"), F.col("b")], partitions=5).collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows))}


def test_global_index_spreads_a_hot_value(spark):
    df = spark.range(4000).select(F.lit(1).alias("a"), "id")
    stamped = ordering._stamped(df, [F.col("a"), F.col("id")], 8)
    sizes = [r["count"] for r in stamped.groupBy(ordering._part_of()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1200


def test_running_total(spark):
    rows = [(i, (i * 7) % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(4)
    got = {r.k: r.s for r in ordering.running_total(df, [F.col("k")], {"s": "v"}, partitions=6).collect()}
    total, want = 0, {}
    for k, v in rows:
        total += v
        want[k] = total
    assert got == want


def test_overlap_buckets_hold_the_look_back(spark):
    placed = ordering.overlap_buckets(spark.range(100), F.col("id"), 10, 3).collect()
    assert sum(not r.is_copy for r in placed) == 100
    assert sorted(r.id for r in placed if r.bucket == 2) == list(range(17, 30))


def test_overlap_rejects_a_look_back_wider_than_a_bucket(spark):
    with pytest.raises(ValueError):
        ordering.overlap_buckets(spark.range(3), F.col("id"), 2, 3)


@pytest.mark.parametrize("shape", ["uniform", "hot", "two", "gaps"])
def test_exact_quantiles_by_brackets_equal_the_builtin(spark, shape):
    rng = random.Random(3)
    make = {
        "uniform": lambda: rng.random() * 1000,
        "hot": lambda: 5.0 if rng.random() < 0.6 else rng.random() * 10,
        "two": lambda: float(rng.random() < 0.5),
        "gaps": lambda: rng.choice([None, 1.0, 2.0, rng.gauss(0, 1)]),
    }[shape]
    df = spark.createDataFrame([(make(), float(i)) for i in range(5000)], "x double, y double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.99, 1.0]
    want = ordering.exact_quantiles(df, ["x", "y"], probs)
    got = ordering.exact_quantiles(df, ["x", "y"], probs, exact_limit=20, accuracy=50)
    for c in ("x", "y"):
        assert got[c] == pytest.approx(want[c])


def test_quantiles_of_a_column_without_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert ordering.exact_quantiles(df, ["x", "y"], [0.5], exact_limit=0)["x"] == [None]


def test_hash_parts_are_exact_and_repeatable(spark):
    import hashlib

    rows = [(i, "a" if i % 3 else "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, label string")
    cut = F.round(F.col("n") * 0.2).cast("bigint")
    got = {r.id: r.part for r in ordering.hash_parts(df, "label", "id", [cut], prefix=1).collect()}
    want = {}
    for label in "ab":
        ranked = sorted((hashlib.md5(f"{i}-42".encode()).hexdigest(), i) for i, x in rows if x == label)
        for rank, (_, i) in enumerate(ranked):
            want[i] = int(rank >= round(len(ranked) * 0.2))
    assert got == want
    again = ordering.hash_parts(df.repartition(5), "label", "id", [cut], prefix=3).collect()
    assert {r.id: r.part for r in again} == want


def test_tail_rows_cross_day_borders(spark):
    df = spark.range(100).select("id", F.timestamp_seconds(F.col("id") * 7200).alias("ts"))
    assert sorted(r.id for r in ordering.tail_rows(df, 30, "ts", "id").collect()) == list(range(70, 100))
    assert ordering.tail_rows(df, 500, "ts", "id").count() == 100
    assert ordering.tail_rows(df.where("false"), 5, "ts", "id").count() == 0


def test_median_matches_statistics(spark):
    values = [3.0, 1.0, 4.0, 1.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert ordering.exact_quantiles(df, ["x"], [0.5])["x"] == [statistics.median(values)]


@pytest.mark.parametrize("limit,accuracy", [(10_000, 10_000), (3, 40)])
def test_each_rank_is_a_value_of_the_column(spark, limit, accuracy):
    """One column for each size, every rank asked, one huge value at the low end: no neighbour may leak into a rank."""
    sizes = [2, 3, 7, 49, 50, 99, 128, 199, 200]
    rows = [tuple((-1e18 if i == 0 else float(i)) if i < n else None for n in sizes) for i in range(200)]
    df = spark.createDataFrame(rows, ", ".join(f"c{n} double" for n in sizes))
    found = ordering.values_at_ranks(df, {f"c{n}": set(range(n)) for n in sizes}, {f"c{n}": n for n in sizes}, limit, accuracy)
    for n in sizes:
        assert [found[f"c{n}", r] for r in range(n)] == [-1e18, *map(float, range(1, n))]


def test_quantiles_beside_a_huge_value_and_infinities(spark):
    inf = float("inf")
    rows = [(-1e18 if i == 0 else float(i), -inf if i == 0 else float(i), inf if i > 47 else float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "x double, low double, high double")
    for limit in (10_000, 4):
        got = ordering.exact_quantiles(df, ["x", "low", "high"], [0.0, 1.5 / 49, 47.5 / 49, 1.0], limit, 30)
        assert got["x"] == pytest.approx([-1e18, 1.5, 47.5, 49.0], rel=1e-12)
        assert got["low"] == [-inf, 1.5, 47.5, 49.0] and got["high"] == [0.0, 1.5, inf, inf]
