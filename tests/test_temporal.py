"""Joins in time against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import temporal


@pytest.mark.parametrize("cell", [1, 7, 1000])
def test_overlaps_are_those_of_all_pairs(spark, cell):
    rng = random.Random(cell)

    def spans(n, first):
        out = []
        for i in range(n):
            s = rng.randrange(-300, 300)
            out.append((rng.choice(["hot", "hot", "u", "v", None]), first + i, s, s + rng.choice([0, 1, 2, 5, 30, 400, -3])))
        return [*out, ("hot", first + n, None, 5), ("hot", first + n + 1, 5, None), *out[:3]]

    a, b = spans(120, 0), spans(90, 1000)
    left, right = spark.createDataFrame(a, "k string, i int, s long, e long"), spark.createDataFrame(b, "k string, j int, s2 long, e2 long")
    got = temporal.overlap_join(left, right, ["k"], (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2")), cell).select("i", "j").collect()
    fine = lambda r: None not in r and r[2] < r[3]
    want = [(x[1], y[1]) for x in filter(fine, a) for y in filter(fine, b) if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100


def test_a_hot_key_is_spread_and_no_loop_is_nested(spark):
    a = spark.range(20_000).selectExpr("'hot' AS k", "id AS i", "id * 10 AS s", "id * 10 + 16 AS e")
    b = spark.range(20_000).selectExpr("'hot' AS k", "id AS j", "id * 10 + 5 AS s2", "id * 10 + 6 AS e2")
    got = temporal.overlap_join(a, b, ["k"], (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2")), 100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == 39_999
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        by_task = [r["count"] for r in temporal.overlap_join(a.hint("merge"), b, ["k"], (F.col("s"), F.col("e")), (F.col("s2"), F.col("e2")), 100).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(by_task) >= 4 and max(by_task) < 39_999 * 0.6


@pytest.mark.parametrize("cell", [1, 10, 10_000])
def test_the_latest_row_is_that_of_all_pairs(spark, cell):
    rng = random.Random(cell)
    left = [(rng.choice(["hot", "hot", "u", None]), i, rng.choice([None, *range(-60, 60)])) for i in range(150)]
    right = [(rng.choice(["hot", "u", "w", None]), j, rng.choice([None, *range(-50, 50)])) for j in range(60)]
    l, r = spark.createDataFrame(left + left[:4], "k string, i int, t long"), spark.createDataFrame(right, "k string, j int, u long")  # noqa: E741
    got = temporal.asof_join(l, r, ["k"], F.col("t"), F.col("u"), cell, ["j"]).collect()
    want = []
    for k, i, t in left + left[:4]:
        before = [(u, j) for k2, j, u in right if k is not None and k2 == k and None not in (t, u) and u <= t]
        u, j = max(before) if before else (None, None)
        want.append((k, i, t, j, u))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(w[3] is not None for w in want) > 40


def test_names_of_both_tables(spark):
    df = spark.createDataFrame([("a", 1, 2)], "k string, s long, e long")
    ends = (F.col("s"), F.col("e"))
    with pytest.raises(ValueError, match=r"\['e', 's'\]"):
        temporal.overlap_join(df, df, ["k"], ends, ends, 10)
    with pytest.raises(ValueError, match="both tables"):
        temporal.asof_join(df, df, ["k"], F.col("s"), F.col("s"), 10)
    none = df.filter("false").toDF("k", "s2", "e2")
    assert temporal.overlap_join(df, none, ["k"], ends, (F.col("s2"), F.col("e2")), 10).count() == 0
    assert temporal.asof_join(df, none, ["k"], F.col("s"), F.col("s2"), 10).first().s2 is None
