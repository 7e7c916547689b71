"""Merged partial roll-ups against those of all rows, and what a run reads."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import rollups

SPEC = rollups.RollUp(
    ("k",), counts={"n_pass": "v > 50"}, sums={"total": "v"}, means={"avg_w": "w"}, extremes={"v": "v"}, distinct={"n_users": "user"}, digits=3
)


def rows_of(seed, n=400):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), rng.choice([None, *range(100)]), rng.choice([None, rng.random()]), rng.randrange(300)) for _ in range(n)]


def put(spark, path, rows):
    spark.createDataFrame(rows, "k string, v int, w double, user int").coalesce(1).write.mode("overwrite").parquet(path)


def whole(spark, rows):
    df = spark.createDataFrame(rows, "k string, v int, w double, user int")
    return df.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("v") > 50).alias("n_pass"), F.sum("v").alias("total"), F.round(F.avg("w"), 3).alias("avg_w"), F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.countDistinct("user").alias("n_users"))


def test_a_new_shard_costs_only_itself(spark, tmp_path):
    data, store, read_now = str(tmp_path / "my data"), str(tmp_path / "store"), []

    def read(files):
        read_now.append(files)
        return spark.read.schema("k string, v int, w double, user int").parquet(*files)

    def check(shards):
        got = {r.k: r for r in rollups.rolled(spark, data, store, SPEC).collect()}
        want = {r.k: r for r in whole(spark, [r for s in shards for r in rows_of(s)]).collect()}
        assert set(got) == set(want)
        for k, w in want.items():
            g = got[k]
            assert (g.n, g.n_pass, g.total, g.min_v, g.max_v) == (w.n, w.n_pass, w.total, w.min_v, w.max_v) and g.avg_w == pytest.approx(w.avg_w, abs=1.1e-3)
            assert abs(g.n_users - w.n_users) <= max(1, rollups.DISTINCT_ERROR * w.n_users)

    for shard in (1, 2, 3):
        put(spark, f"{data}/s{shard}", rows_of(shard))
    assert len(rollups.refresh(spark, data, store, SPEC, read)) == 3 and len(read_now[-1]) == 3
    check([1, 2, 3])
    assert rollups.refresh(spark, data, store, SPEC, read) == [] and len(read_now) == 1
    put(spark, f"{data}/s4", rows_of(4))
    new = rollups.refresh(spark, data, store, SPEC, read)
    assert len(new) == 1 and "/s4/" in new[0] and read_now[-1] == new
    check([1, 2, 3, 4])
    put(spark, f"{data}/s2", rows_of(20))  # written anew
    assert len(rollups.refresh(spark, data, store, SPEC, read)) == 1
    check([1, 20, 3, 4])
    shutil.rmtree(f"{data}/s1")
    check([20, 3, 4])


def test_a_version_takes_the_place_of_another(spark, tmp_path):
    data, store = tmp_path / "data", str(tmp_path / "store")
    read = lambda files: spark.read.schema("k string, v int, w double, user int").parquet(*files)
    put(spark, str(tmp_path / "one"), rows_of(1))
    put(spark, str(tmp_path / "two"), rows_of(2, 30))
    one, two = (next((tmp_path / x).glob("*.parquet")) for x in ("one", "two"))
    data.mkdir()
    for source, stamp in ((one, 1_700_000_000), (two, 1_700_000_100)):
        (data / "shard.parquet").write_bytes(source.read_bytes())
        os.utime(data / "shard.parquet", (stamp, stamp))
        assert len(rollups.refresh(spark, str(data), store, SPEC, read)) == 1
    assert rollups.rolled(spark, str(data), store, SPEC).agg(F.sum("n")).first()[0] == 30


def test_sketches_merge_within_their_error(spark):
    spec = rollups.RollUp(("k",), distinct={"u": "u"})
    rows = spark.range(400_000).selectExpr("1 AS k", "id % 150000 AS u", "id % 40 AS shard")
    got = spec.merged(spec.partial(rows, "shard")).first()
    assert got.n == 400_000 and abs(got.u - 150_000) <= rollups.DISTINCT_ERROR * 150_000
    none = spec.merged(spec.partial(rows.selectExpr("k", "int(NULL) AS u", "shard"), "shard")).first()
    assert none.u == 0
