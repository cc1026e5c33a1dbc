import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from featurelake.operators import rollups
from featurelake.operators.profile import reference_stats
from featurelake.operators.validate import consistency_full, differing_rows

START = dt.date(2024, 1, 1)


def numbers(spark, low, high, seed=1):
    rng = random.Random(seed)
    rows = [(START + dt.timedelta(days=d), rng.choice([None, float("nan"), rng.gauss(0, 1), 5.0, float(d)]), rng.random() * 1e6 + 1e9)
            for d in range(low, high) for _ in range(150)]
    return spark.createDataFrame(rows, "day date, x double, y double")


def stats(df):
    return {r.feature: tuple(r)[1:] for r in df.select("feature", "mean", "std", "min", "max", "q25", "median", "q75").collect()}


@pytest.mark.parametrize("limit", [10_000, 5])
def test_rolled_up_statistics_equal_those_of_all_rows(spark, base, limit):
    old, new = numbers(spark, 0, 30), numbers(spark, 30, 40, seed=2)
    state = rollups.statistics_state(spark, base)
    assert len(state.replace(rollups.day_statistics(old))) == 30
    assert len(state.replace(rollups.day_statistics(new))) == 10
    rows = old.unionByName(new)
    got, want = stats(rollups.rolled_up_stats(state.read(), rows.drop("day"), limit)), stats(reference_stats(rows.drop("day")))
    for c in ("x", "y"):
        assert got[c] == pytest.approx(want[c], rel=1e-9)
    part = state.read(START + dt.timedelta(days=25), START + dt.timedelta(days=34))
    days = rows.where((F.col("day") >= "2024-01-26") & (F.col("day") <= "2024-02-04"))
    assert stats(rollups.rolled_up_stats(part, days.drop("day")))["x"] == pytest.approx(stats(reference_stats(days.drop("day")))["x"], rel=1e-9)


def test_a_day_written_again_replaces_itself(spark, base):
    state = rollups.statistics_state(spark, base)
    state.replace(rollups.day_statistics(numbers(spark, 0, 3)))
    state.replace(rollups.day_statistics(numbers(spark, 1, 2, seed=9)))
    rows = numbers(spark, 0, 3).where("day <> '2024-01-02'").unionByName(numbers(spark, 1, 2, seed=9))
    got, want = stats(rollups.rolled_up_stats(state.read(), rows.drop("day"))), stats(reference_stats(rows.drop("day")))
    assert all(got[c] == pytest.approx(want[c], rel=1e-9) for c in ("x", "y"))
    assert state.clean_up() == 0
    state.replace(rollups.day_statistics(numbers(spark, 0, 3, seed=4)))
    assert state.clean_up() == 2 and state.read().count() == 6


def test_a_write_that_was_not_committed_does_not_count(spark, base):
    state = rollups.statistics_state(spark, base)
    state.replace(rollups.day_statistics(numbers(spark, 0, 2)))

    def lost(*args):
        raise OSError("driver lost")

    commit, state.commits.commit = state.commits.commit, lost
    with pytest.raises(OSError):
        state.replace(rollups.day_statistics(numbers(spark, 2, 3)))
    state.commits.commit = commit
    assert state.read().select("day").distinct().count() == 2
    assert rollups.statistics_state(spark, f"{base}/none").read().count() == 0


def test_distinct_entities_of_any_days(spark, base):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([rng.randrange(-50, 50), rng.randrange(10**6)]), dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 40)))
            for _ in range(3000)] + [("a", None, dt.datetime(2024, 1, 1)), ("a", 1, None)]
    log = spark.createDataFrame(rows, "table_name string, entity_number long, accessed_at timestamp_ntz")
    state = rollups.access_state(spark, base)
    state.replace(rollups.day_accesses(log.where("accessed_at < '2024-01-20'")))
    state.replace(rollups.day_accesses(log.where("accessed_at >= '2024-01-20'")))
    last = dt.date(2024, 2, 9)
    for days in (1, 7, 30, 100):
        seen = [r for r in rows if r[1] is not None and r[2] is not None and 0 <= (last - r[2].date()).days < days]
        want = {t: (sum(r[0] == t for r in seen), len({r[1] for r in seen if r[0] == t})) for t in "ab" if any(r[0] == t for r in seen)}
        got = {r.table_name: (r.access_count, r.unique_entities) for r in rollups.access_rollup(state, last, days).collect()}
        assert got == want


def sides(spark, n, changes):
    left = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 3 % 17).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("b"))
    right = left.where(~F.col("k").isin(changes["gone"])).withColumns({
        "a": F.when(F.col("k").isin(changes["a"]), -1).otherwise(F.col("a")), "b": F.when(~F.col("k").isin(changes["b"]), F.col("b"))})
    fresh = spark.createDataFrame([(i, 1, "x") for i in changes["new"]], "k long, a long, b string")
    return left, right.unionByName(fresh)


CHANGES = {"gone": [17, 4000], "a": [5, 123], "b": [123, 777], "new": [90001]}


def test_every_planted_difference_is_found_and_few_rows_move(spark):
    left, right = sides(spark, 20_000, CHANGES)
    for leaf, bits in ((64, 10), (4, 3), (1, 20)):
        got = {r.k: (r.status, tuple(r.columns)) for r in consistency_full(left, right, "k", leaf_rows=leaf, level_bits=bits).collect()}
        assert got == {17: ("offline_only", ()), 4000: ("offline_only", ()), 5: ("different", ("a",)), 123: ("different", ("a", "b")),
                       777: ("different", ("b",)), 90001: ("serving_only", ())}
    moved = [side.count() for side in differing_rows(left, right, "k", ["a", "b"])]
    assert max(moved) <= 6 * 64
    assert consistency_full(left, left, "k").count() == 0


def test_null_values_null_keys_and_repeated_rows(spark):
    schema = "k long, a double, m map<string,int>"
    left = spark.createDataFrame([(1, None, {"x": 1}), (None, 2.0, None), (3, 1.0, None), (3, 1.0, None), (4, 1.0, None)], schema)
    right = spark.createDataFrame([(1, None, {"x": 2}), (None, 2.0, None), (3, 1.0, None), (4, 1.0, None), (4, 2.0, None)], schema)
    got = {r.k: (r.status, tuple(r.columns)) for r in consistency_full(left, right, "k").collect()}
    assert got == {1: ("different", ("m",)), 3: ("repeated", ()), 4: ("repeated", ())}
    with pytest.raises(ValueError):
        consistency_full(left, right.select("k"), "k")
