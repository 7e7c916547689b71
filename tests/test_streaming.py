"""Streams that are stopped, run again and sent the same things twice."""

import pytest

from tracequarry.streaming import ledger, signatures
from pyspark.sql import functions as F

ATTEMPT = "task string, model string, ts timestamp, score double"


def attempts(spark, rows):
    return spark.createDataFrame([(t, m, s, v) for t, m, s, v in rows], "task string, model string, ts string, score double").withColumn("ts", F.col("ts").cast("timestamp"))


def test_attempts_are_recorded_once(spark, tmp_path):
    src, out, led = (str(tmp_path / x) for x in ("src", "out", "ledger"))

    def add(rows):
        attempts(spark, rows).coalesce(1).write.mode("append").parquet(src)

    def run(checkpoint="one"):
        stream = spark.readStream.schema(ATTEMPT).parquet(src)
        ledger.ingest_once(stream, out, led, str(tmp_path / checkpoint), ["task", "model"], ["ts"], run=checkpoint).awaitTermination(120)
        return sorted((r.task, r.model, r.score) for r in spark.read.parquet(out).collect())

    add([("a", "m", "2024-01-01 10:00:00", 1.0), ("a", "m", "2024-01-01 09:00:00", 2.0), ("b", "m", "2024-01-01 10:00:00", 3.0)])
    first = [("a", "m", 2.0), ("b", "m", 3.0)]  # the earliest of a batch
    assert run() == first
    add([("a", "m", "2023-01-01 00:00:00", 9.0), ("c", "m", "2024-06-01 00:00:00", 4.0)])  # long after any watermark
    second = [*first, ("c", "m", 4.0)]
    assert run() == second
    assert run() == second  # nothing new
    assert run("two") == second  # a new checkpoint reads everything again, from batch 0
    add([("b", "other", "2024-01-01 10:00:00", 5.0)])
    assert run("two") == [("a", "m", 2.0), ("b", "m", 3.0), ("b", "other", 5.0), ("c", "m", 4.0)]
    assert spark.read.parquet(led).count() == 4


@pytest.mark.parametrize("lost", ["nothing", "keys", "half"])
def test_a_batch_that_is_run_again(spark, tmp_path, lost):
    import shutil

    out, led = str(tmp_path / "out"), str(tmp_path / "ledger")
    rows = attempts(spark, [(f"t{i % 5}", "m", f"2024-01-01 10:00:{i:02}", float(i)) for i in range(20)])
    record = lambda df, n: ledger.record(df, "r", n, out, led, ["task", "model"], ["ts"])
    record(rows.filter("task = 't0'"), 0)
    record(rows, 1)
    if lost != "nothing":  # the try ended before its keys were written, or while its data were
        shutil.rmtree(tmp_path / "ledger" / "ingest_run=r" / "ingest_batch=1")
    if lost == "half":
        next((tmp_path / "out" / "ingest_run=r" / "ingest_batch=1").glob("part-*")).unlink()
    record(rows, 1)
    assert sorted((r.task, r.score) for r in spark.read.parquet(out).collect()) == [(f"t{i}", float(i)) for i in range(5)]
    assert spark.read.parquet(led).count() == 5


def test_messages_of_one_kind_have_one_signature(spark):
    messages = ['File "/a/b.py", line 7: KeyError \'x\'', 'File "/c.py", line 912:  KeyError "yy"', "at 0xdeadBEEF in 3.5 s", "at 0x1f in  12 s", "id 123e4567-e89b-12d3-a456-426614174000 lost", "id 00000000-0000-0000-0000-000000000000 lost", "cannot open /etc/x.conf", "cannot open /var/log/y"]
    got = [r[0] for r in spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "i int, m string").orderBy("i").select(signatures.signature(F.col("m"))).collect()]
    assert got[::2] == got[1::2] == ["File <text>, line <n>: KeyError <text>", "at <hex> in <n> s", "id <id> lost", "cannot open <path>"]


def test_signatures_are_told_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", signatures.PROVIDER)
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    known = spark.createDataFrame([("old <n>",)], "signature string")

    def step(messages):
        rows = [(m, f"2024-01-01 00:00:{i:02}") for i, m in enumerate(messages)]
        spark.createDataFrame(rows, "message string, at string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
        run()

    def run():
        stream = spark.readStream.schema("message string, at timestamp").parquet(src).withColumn("signature", signatures.signature(F.col("message")))
        signatures.told_once(stream, known).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination(180)

    step(["lost 1", "lost 2", "old 3", "slow 4 s", None])
    told = lambda: sorted((r.signature, r.n_sampled, r.first_at.second) for r in spark.read.parquet(out).collect())
    assert told() == [("lost <n>", 2, 0), ("slow <n> s", 1, 3)]
    run()  # a restart without anything new
    step(["lost 9", "new", "new", "slow 1 s"])
    assert told() == [("lost <n>", 2, 0), ("new", 2, 1), ("slow <n> s", 1, 3)]
