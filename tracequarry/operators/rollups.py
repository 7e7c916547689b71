"""Roll-ups that follow a growing corpus: each shard is summed up once, and sums and sketches are merged."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequarry.functions.compat import ratio, ref_round

#: A sketch has 2^SKETCH_BITS counters; a merged count is within DISTINCT_ERROR of the exact one in all but a few of a thousand cases.
SKETCH_BITS = 14
DISTINCT_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


@dataclass(frozen=True)
class RollUp:
    """What is summed up by keys: counts of rows for which a condition holds, sums, means, extremes and numbers of distinct values, by name, each an SQL expression."""

    keys: tuple[str, ...]
    counts: dict[str, str] = field(default_factory=dict)
    sums: dict[str, str] = field(default_factory=dict)
    means: dict[str, str] = field(default_factory=dict)
    extremes: dict[str, str] = field(default_factory=dict)
    distinct: dict[str, str] = field(default_factory=dict)
    #: Decimals of means; None leaves them as they are.
    digits: int | None = None

    def partial(self, rows: DataFrame, *more: str) -> DataFrame:
        """One row for each key of rows: numbers that can be merged."""
        parts = [F.count("*").alias("n")]
        parts += [F.count_if(F.expr(c)).alias(f"count__{n}") for n, c in self.counts.items()]
        parts += [F.sum(F.expr(c)).alias(f"sum__{n}") for n, c in self.sums.items()]
        for n, c in self.means.items():
            parts += [F.sum(F.expr(c).cast("double")).alias(f"total__{n}"), F.count(F.expr(c)).alias(f"known__{n}")]
        for n, c in self.extremes.items():
            parts += [F.min(F.expr(c)).alias(f"min__{n}"), F.max(F.expr(c)).alias(f"max__{n}")]
        parts += [F.hll_sketch_agg(F.expr(c), SKETCH_BITS).alias(f"sketch__{n}") for n, c in self.distinct.items()]
        return rows.groupBy(*more, *self.keys).agg(*parts)

    def merged(self, partials: DataFrame) -> DataFrame:
        """The roll-up of all rows behind some partial ones."""
        out = [F.sum("n").alias("n")]
        out += [F.sum(f"count__{n}").alias(n) for n in self.counts]
        out += [F.sum(f"sum__{n}").alias(n) for n in self.sums]
        for n in self.means:
            mean = ratio(F.sum(f"total__{n}"), F.sum(f"known__{n}"))
            out.append((mean if self.digits is None else ref_round(mean, self.digits)).alias(n))
        for n in self.extremes:
            out += [F.min(f"min__{n}").alias(f"min_{n}"), F.max(f"max__{n}").alias(f"max_{n}")]
        out += [F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"sketch__{n}")), F.lit(0)).alias(n) for n in self.distinct]
        return partials.groupBy(*self.keys).agg(*out)


def shard_versions(spark: SparkSession, path: str) -> DataFrame:
    """shard and version (when it was last written) of every Parquet file under path, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("shard"), F.col("modificationTime").alias("version"))


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def refresh(spark: SparkSession, path: str, store: str, spec: RollUp, read: Callable[[list[str]], DataFrame]) -> list[str]:
    """Adds the partial rows of shards that the store does not have, or has in another version, and gives their names; no other shard is read.

    read: the rows of some shards, with `_metadata`, as a scan gives them. Shards are summed up whole, so a run that fails adds none of them. A shard without any row is stored as
    nothing, and is looked at again.
    """
    listed, stored = shard_versions(spark, path), _stored(spark, store)
    todo = listed if stored is None else listed.join(stored.select("shard", "version").distinct(), ["shard", "version"], "left_anti")
    names = {r.shard: r.version for r in todo.collect()}
    if names:
        # Names as a scan gives them are escaped, so they are matched by what they are without that.
        rows = read(sorted(names)).withColumn("shard", F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:/*", "file:/"))
        rows = rows.withColumn("version", F.col("_metadata.file_modification_time"))
        spec.partial(rows, "shard", "version").write.mode("append").parquet(store)
    return sorted(names)


def rolled(spark: SparkSession, path: str, store: str, spec: RollUp) -> DataFrame:
    """The roll-up of the shards that are there now, each in its last version; it reads the store and the listing only."""
    newest = Window.partitionBy("shard")
    stored = spark.read.parquet(store).join(shard_versions(spark, path).select("shard"), "shard", "left_semi")
    latest = stored.withColumn("_newest", F.max("version").over(newest)).filter("version = _newest")
    return spec.merged(latest)
