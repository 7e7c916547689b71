"""Ingest that records every attempt once, however often it is sent and whenever a batch is run again."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Where a batch's files lie, under the table's folder.
RUN, BATCH = "ingest_run", "ingest_batch"


def recorded(spark: SparkSession, ledger: str, keys: list[str]) -> DataFrame | None:
    """The ledger's keys with the run and the batch that wrote them; None before the first batch."""
    try:
        return spark.read.parquet(ledger).select(*keys, RUN, BATCH)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def first_of_each(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in order, then by its other columns, so that a batch that is run again keeps the same."""
    rest = [c for c in batch.columns if c not in keys and c not in order]
    picked = batch.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in batch.columns])


def record(batch: DataFrame, run: str, number: int, out: str, ledger: str, keys: list[str], order: list[str]) -> None:
    """Writes the batch's attempts that are in no other batch's part of the ledger, then their keys.

    Both go to a folder of this run and batch and take the place of what an earlier try of it left there. Data come before keys: a try that ends between the two
    leaves data without keys, and the next one finds them unrecorded and writes the same again.
    """
    spark = batch.sparkSession
    new = first_of_each(batch, keys, order)
    known = recorded(spark, ledger, keys)
    if known is not None:
        others = known.filter((F.col(RUN) != run) | (F.col(BATCH).cast("long") != number))
        # The ledger is cut down to this batch's keys before it is shuffled or sent, so its size costs a scan of key columns only.
        new = new.join(others.join(batch.select(*keys).distinct(), keys, "left_semi").select(*keys), keys, "left_anti")
    place = f"{RUN}={run}/{BATCH}={number}"
    new.write.mode("overwrite").parquet(f"{out}/{place}")
    spark.read.schema(batch.schema).parquet(f"{out}/{place}").select(*keys).write.mode("overwrite").parquet(f"{ledger}/{place}")


def ingest_once(stream: DataFrame, out: str, ledger: str, checkpoint: str, keys: list[str], order: list[str], run: str) -> StreamingQuery:
    """Adds what the stream has and the ledger has not, and stops.

    run names the checkpoint, so that a new one, which counts its batches from 0 again, never writes over the batches of another. Keys must not be null: a null is equal
    to nothing, so such rows are recorded each time.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, number: record(batch, run, number, out, ledger, keys, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
