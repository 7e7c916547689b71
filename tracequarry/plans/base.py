"""The registry's decorator and the reference's entities on the driver's tables.

A trial is a document with its label (quality as resolved, -1 without one), its source
as harness and its language; a message is a row of conversations; a turn counter is an event; a task is a part and its
trajectories are that part's line items (flag R resolved, A failed, N unlabeled).
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators.order import checkpoints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all of the cluster shares, for files that a query derives from its tables."""
    checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def trials(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("harness"), F.col("lang").alias("language"), "n_chars", "text", F.coalesce("quality", F.lit(-1)).alias("resolved"), "toxic"
    )


TRIALS = "(SELECT doc_id, source AS harness, lang AS language, n_chars, text, coalesce(quality, -1) AS resolved, toxic FROM documents LEFT JOIN labels USING (doc_id)) trials"


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """Trajectories: task, combo, resolved in {1, 0, -1}."""
    line = table(spark, d, "lineitem")
    resolved = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).otherwise(-1)
    return line.select(F.col("l_partkey").alias("task"), F.concat("l_linestatus", F.lit("/"), (F.col("l_linenumber") % 3).cast("string")).alias("combo"), resolved.alias("resolved"), "l_quantity", "l_orderkey", "l_linenumber")


ROLLOUTS = "(SELECT l_partkey AS task, l_linestatus || '/' || (l_linenumber % 3)::VARCHAR AS combo, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS resolved, l_quantity, l_orderkey, l_linenumber FROM lineitem) rollouts"


def conversations(spark: SparkSession, d: str) -> DataFrame:
    """Trials with nested messages, in the order of their turns. Of a text its length is nested only, so what a conversation brings together is a few bytes a message."""
    m = F.sort_array(F.collect_list(F.struct("turn", "role", F.length("text").alias("content_len"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("messages"))
