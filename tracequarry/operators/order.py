"""Places and running sums over a whole table's order, without a task that sorts it whole."""

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Sees to it that there is a checkpoint folder: the one of spark.checkpoint.dir; a temporary one only on a local master without any."""
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all of the cluster shares")
        found = tempfile.mkdtemp(prefix="tracequarry-")
    spark.sparkContext.setCheckpointDir(found)


def sums_before(df: DataFrame, order: list[Column], weight: Column, name: str, total: str | None = None) -> DataFrame:
    """df with the sum of a weight over all rows before each one in a total order, and, under `total`, over all rows.

    Rows are dealt out by ranges of the order and fixed there; each range starts where those before it end, and only
    a range is sorted by a task. There are as many ranges as shuffle partitions.
    """
    checkpoints(df.sparkSession)
    # Finding the ranges and dealing the rows out are two passes over what df is worked out to once.
    held = df.withColumn("_weight", weight).persist()
    dealt = held.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    held.unpersist()
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy("_range").agg(F.sum("_weight").alias("_sum"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_sum").over(Window.partitionBy()).alias("_whole"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(ranges), "_range").withColumn(name, F.col("_ahead") + F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
    if total:
        placed = placed.withColumn(total, F.col("_whole"))
    return placed.drop("_weight", "_range", "_ahead", "_whole")
