"""Matches, patches and drifting shards against slow versions."""

import random
import re
from functools import reduce

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.operators import matching, patches
from tracequarry.sources import drift, views

SHA, COMPUTED = r"[\"'`](sha256:[0-9a-f]{4,8})[\"'`]", r"Sum256|EncodeToString"


def random_source(rng):
    parts = ['"sha256:abcd"', "'sha256:0123abcd'", "Sum256", "EncodeToString(", "\n", "\n\n", "x = 1 ", "é😀 ", "sha256:ffff", '"sha256:zz"', " " * rng.randrange(60)]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(60)))


def test_every_match_with_what_is_near(spark):
    rng = random.Random(4)
    texts = [random_source(rng) for _ in range(60)] + [None, "", '"sha256:abcd"', "Sum256" + " " * 40 + '"sha256:abcd"' + " " * 27 + "Sum256"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])] * 2  # keys need not be unique
    df = spark.createDataFrame(rows, "k int, t string").repartition(5)
    got = sorted((r.k, r["at"], r.n, r.match, r.line, r.near) for r in matching.matches_near(df, ["k"], "t", SHA, COMPUTED, 40).collect())
    want = []
    for k, t in rows:
        for m in re.finditer(SHA, t or ""):
            window = t[max(0, m.start() - 40) : m.start() + 40]
            want.append((k, m.start() + 1, len(m.group(0)), m.group(0), t[: m.start()].count("\n") + 1, bool(re.search(COMPUTED, window))))
    assert got == sorted(want) and {True, False} == {w[5] for w in want}
    assert sorted((r.k, r["at"], r.n, r.match, r.line) for r in matching.match_positions(df, ["k"], "t", SHA).collect()) == sorted(w[:5] for w in want)


def test_lines_and_units(spark):
    t = "first\n  a X b \nX" + " " * 50 + "near\nX"
    df = spark.createDataFrame([("u-L1", t), ("u-L2", "near X"), ("v-L1", "X near")], "name string, t string")
    hits = matching.matches_near(df, ["name"], "t", "X", "near", 10)
    told = matching.with_line_text(hits, df, ["name"], "t", 5).collect()
    assert sorted((r.name, r.line, r.context) for r in told) == [("u-L1", 2, "a X b"), ("u-L1", 3, "X    "), ("u-L1", 4, "X"), ("u-L2", 1, "near "), ("v-L1", 1, "X nea")]
    units = matching.hits_by_unit(hits.withColumn("unit", F.regexp_replace("name", "-L[^-]*$", "")), "unit", ["name", "at"], ["name", "line"], 2)
    assert sorted(map(tuple, units.collect())) == [("u", 4, True, "u-L1:2,u-L1:3"), ("v", 1, False, "v-L1:1")]


def test_matches_of_one_text_take_linear_time(spark):
    df = spark.createDataFrame([(1, "ab X y\n" * 150_000)], "k int, t string")
    rows = matching.matches_near(df, ["k"], "t", "X", "y", 600).agg(F.count("*"), F.max("at"), F.max("line"), F.bool_and("near")).first()
    assert tuple(rows) == (150_000, 7 * 149_999 + 4, 150_000, True)


HEAD = "diff --git a/{0} b/{0}\nindex 1..2 100644\n--- a/{0}\n+++ b/{0}\n"


@pytest.mark.parametrize(
    ("a", "b", "differ"),
    [
        (HEAD.format("x") + "@@ -1 +1 @@\n-old\n+new\n", HEAD.format("x") + "@@ -7,3 +8,3 @@ def f\n context\n-old\n+new\n other\n", False),  # place and context
        (HEAD.format("x") + "@@ -1 +1 @@\n-old\n+new\n@@ -9 +9 @@\n+z\n", HEAD.format("x") + "@@ -9 +9 @@\n+z\n@@ -1 +1 @@\n-old\n+new\n", False),  # order of hunks
        (HEAD.format("x") + "@@ -1 +1 @@\n+a\n" + HEAD.format("y") + "@@ -1 +1 @@\n+b\n", HEAD.format("y") + "@@ -1 +1 @@\n+b\n" + HEAD.format("x") + "@@ -1 +1 @@\n+a\n", False),  # order of files
        (HEAD.format("x") + "@@ -1 +1 @@\n-old  one\n+new\n+\n", HEAD.format("x") + "@@ -1 +1 @@\r\n- old one\r\n+\tnew \r\n", False),  # white space and line ends
        (HEAD.format("x") + "@@ -1 +1 @@\n+a\n", HEAD.format("y") + "@@ -1 +1 @@\n+a\n", True),  # another file
        (HEAD.format("x") + "@@ -1 +1 @@\n-a\n", HEAD.format("x") + "@@ -1 +1 @@\n+a\n", True),  # the other way
        (HEAD.format("x") + "@@ -1 +1 @@\n+a\n+b\n", HEAD.format("x") + "@@ -1 +1 @@\n+b\n+a\n", True),  # order of lines
        (HEAD.format("x") + "@@ -1 +1 @@\n+a\n@@ -5 +5 @@\n+a\n", HEAD.format("x") + "@@ -1 +1 @@\n+a\n", True),  # twice
        (HEAD.format("x") + "@@ -1 +1 @@\n--- sql comment\n", HEAD.format("x") + "@@ -1 +1 @@\n--- other comment\n", True),  # lines like heads
        ("", HEAD.format("x") + "@@ -1 +1 @@\n+ \n", False),  # both change nothing
        (None, "", None),
    ],
)
def test_structural_difference(spark, a, b, differ):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(patches.differs(F.col("a"), F.col("b"))).first()[0] is differ


def shard(spark, i):
    rows = [(i * 10 + j, i + j) for j in range(3)]
    if i % 3 == 0:
        return spark.createDataFrame([(k, float(v), (f"n{k}", [(1, "a")])) for k, v in rows], "k int, v double, m struct<name:string,calls:array<struct<id:int,kind:string>>>")
    if i % 3 == 1:
        return spark.createDataFrame([(k, v, ((k, f"n{k}", [(2,)])), True) for k, v in rows], "K long, v int, m struct<size:long,name:string,calls:array<struct<id:long>>>, extra boolean")
    return spark.createDataFrame([(str(k), v, None) for k, v in rows], "k string, v long, tags map<string,int>")


def test_one_scan_for_each_schema(spark, tmp_path):
    for i in range(3):
        shard(spark, i).coalesce(1).write.parquet(str(tmp_path / "made" / str(i)))
    made = [next((tmp_path / "made" / str(i)).glob("*.parquet")) for i in range(3)]
    frames = []
    for i in range(200):
        folder = tmp_path / "data" / f"h{i % 7}" / f"t {i}"
        folder.mkdir(parents=True)
        (folder / f"{i:03}.parquet").write_bytes(made[i % 3].read_bytes())
        frames.append(spark.read.parquet(str(folder)))
    got = drift.read_drifting(spark, [str(tmp_path / "data")], source_file=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 3 and got.count() == 600
    assert got.schema["k"].dataType == T.StringType() and got.schema["v"].dataType == T.DoubleType()
    assert got.select("_source_file").distinct().count() == 200

    def plain(df):
        k = F.col("k").cast("string").alias("k")
        m = F.struct(F.col("m.name"), F.col("m.calls").cast("array<struct<id:long>>")) if "m" in df.columns and "extra" in df.columns else None
        name = F.col("m.name") if "m" in df.columns else F.lit(None).cast("string")
        size = F.col("m.size") if m is not None else F.lit(None).cast("long")
        ids = F.transform("m.calls", lambda c: c["id"].cast("long")) if "m" in df.columns else F.lit(None).cast("array<bigint>")
        kinds = F.transform("m.calls", lambda c: c["kind"]) if "m" in df.columns and m is None else F.lit(None).cast("array<string>")
        return df.select(k, F.col("v").cast("double").alias("v"), name.alias("name"), size.alias("size"), ids.alias("ids"), kinds.alias("kinds"), (F.col("extra") if "extra" in df.columns else F.lit(None).cast("boolean")).alias("extra"))

    ours = got.select("k", "v", F.col("m.name").alias("name"), F.col("m.size").alias("size"), F.transform("m.calls", lambda c: c["id"]).alias("ids"), F.transform("m.calls", lambda c: c["kind"]).alias("kinds"), "extra")
    slow = reduce(lambda a, b: a.union(b), [plain(f) for f in frames[:30]])
    first = got.filter(F.col("_source_file").rlike("/0[012][0-9]\\.parquet$")).select("k", "v")
    assert sorted(map(tuple, first.collect())) == sorted((r.k, r.v) for r in slow.collect())
    norm = lambda df: sorted(str((r.k, r.v, r.name, r["size"], r.ids, [x for x in r.kinds or [] if x] or None, r.extra)) for r in df.distinct().collect())
    assert norm(ours) == norm(slow)
    pruned = got.select("v")._jdf.queryExecution().executedPlan().toString()
    assert all("v" in s and "name" not in s.split(">")[0] for s in re.findall(r"ReadSchema: (.*)", pruned))


def test_types_that_have_no_common_one(spark):
    s = T.StructType.fromDDL
    assert drift.common_type(s("a int, b date"), s("A decimal(5,2), c string")) == s("a decimal(12,2), b date, c string")
    assert drift.common_type(T.DateType(), T.TimestampType()) == T.TimestampType()
    assert drift.common_type(T.LongType(), T.FloatType()) == T.DoubleType()
    assert drift.common_type(T.BooleanType(), T.StringType()) == T.StringType()
    with pytest.raises(ValueError, match=r"column m.x: array<int> and string"):
        drift.common_type(s("m struct<x:array<int>>"), s("m struct<x:string>"))


def test_no_shards(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no Parquet file"):
        drift.read_drifting(spark, [str(tmp_path / "none")])


def test_files_written_elsewhere(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"k": pa.array([1], pa.int16()), "at": pa.array([0], pa.timestamp("us")), "none": pa.nulls(1)}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"k": pa.array([2], pa.uint32()), "more": pa.array(["x"]).dictionary_encode()}), tmp_path / "b.parquet")
    got = drift.read_drifting(spark, [str(tmp_path)])
    assert sorted(map(tuple, got.select("k", "more").collect())) == [(1, None), (2, "x")] and "none" not in got.columns


def test_a_report_of_drift(spark, tmp_path):
    for i in range(6):
        shard(spark, i).coalesce(1).write.parquet(str(tmp_path / str(i)))
    spark.createDataFrame([(True,)], "tags boolean").coalesce(1).write.parquet(str(tmp_path / "odd"))
    got = {(r.column, r.type): (r.n_files, r.widened) for r in drift.drift_report(spark, [str(tmp_path)]).collect()}
    assert got["k", "int"] == got["k", "bigint"] == got["k", "string"] == (2, "string")
    assert got["v", "double"] == (2, "double") and got["m.size", "bigint"] == (2, "bigint") and got["m.name", "string"] == (4, "string")
    assert got["m.calls[].id", "int"] == got["m.calls[].id", "bigint"] == (2, "bigint") and got["m.calls[].kind", "string"] == (2, "string")
    assert got["tags", "boolean"] == (1, None) and got["tags", "map<string,int>"] == (2, None)
    with pytest.raises(ValueError, match="column tags"):
        drift.read_drifting(spark, [str(tmp_path)])


def test_a_view_of_drifting_shards(spark, tmp_path):
    for i in range(3):
        shard(spark, i).coalesce(1).write.parquet(str(tmp_path / "harness" / f"t{i}"))
    views.register_drifting(spark, [str(tmp_path)], "raw_shards")
    sql = "SELECT regexp_extract(_source_file, '/harness/([^/]+)/', 1) AS teacher, count(*) AS n, count(extra) AS n_extra, count(tags) AS n_tags, min(v) AS least FROM raw_shards GROUP BY 1 ORDER BY 1"
    assert [tuple(r) for r in spark.sql(sql).collect()] == [("t0", 3, 0, 0, 0.0), ("t1", 3, 3, 0, 1.0), ("t2", 3, 0, 0, 2.0)]
    shard(spark, 3).coalesce(1).write.parquet(str(tmp_path / "harness" / "t3"))
    assert views.register_drifting(spark, [str(tmp_path)], "raw_shards").count() == 12
