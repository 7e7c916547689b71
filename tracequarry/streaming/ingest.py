"""Streams over a growing corpus: new shards, idempotent trials, rolling health."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def new_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of rows of Parquet files that come to lie under path; the schema is declared, never inferred."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def ingest(stream: DataFrame, out: str, checkpoint: str, keys: list[str], change: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends what is new, partitioned by keys, and stops; files already seen are in the checkpoint."""
    return (
        change(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .partitionBy(*keys).trigger(availableNow=True).start()
    )


def first_attempts(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Each attempt once, however often it is sent within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def not_recorded(batch: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's attempts that the ledger does not have."""
    return batch.dropDuplicates(keys).join(ledger.select(*keys).distinct(), keys, "left_anti")


def rolling_health(trials: DataFrame, ts: str, over_cap: str, window: str = "6 hours", slide: str = "1 hour", late: str | None = None) -> DataFrame:
    """Trials and the share over their cap in sliding windows; with a watermark for streams."""
    rows = trials.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if late else rows
    n, over = F.count("*"), F.count_if(F.col(over_cap))
    out = rows.groupBy(F.window(ts, window, slide).alias("w")).agg(n.alias("n"), over.alias("n_over"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "n_over")


def new_signatures(errors: DataFrame, known: DataFrame, key: str = "signature") -> DataFrame:
    """Error signatures not seen before, with their counts."""
    return errors.groupBy(key).agg(F.count("*").alias("n")).join(known.select(key).distinct(), key, "left_anti")
