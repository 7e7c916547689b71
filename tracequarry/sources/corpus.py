"""Reading and writing the trajectory corpus: drifting Parquet shards, JSON lines, result folders."""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.functions.compat import plain_path

_PATCH = T.StructType([T.StructField(n, T.StringType()) for n in ("patch", "num_modified_files", "num_modified_lines")])
_CALL = T.StructType([T.StructField("function", T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))])
MESSAGE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("role", "content", "reasoning_content", "think")] + [T.StructField("tool_calls", T.ArrayType(_CALL))]
)
TRIAL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("instance_id", "repo", "license", "language", "trajectory_id", "hf_dataset_name")]
    + [
        T.StructField("resolved", T.IntegerType()),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("tools", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.StructType([T.StructField("category", T.StringType()), T.StructField("reference_patch", _PATCH), T.StructField("model_patch", _PATCH)])),
    ]
)
SHARD_DEPTH = r"/([^/]+)/([^/]+)/([^/]+)/([^/]+)\.parquet$"


def read_trials(spark: SparkSession, path: str, schema: T.StructType = TRIAL) -> DataFrame:
    """All shards under path with the declared schema, and `_source_file`."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).select("*", plain_path(F.col("_metadata.file_path")).alias("_source_file"))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of drifting schemas as one: missing columns are null, numbers widen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def shard_columns(file: Column) -> dict[str, Column]:
    """harness, teacher_model, source_dataset from a shard's path `.../harness/teacher/source/file.parquet`."""
    names = ("harness", "teacher_model", "source_dataset")
    return {n: F.regexp_extract(file, SHARD_DEPTH, i + 1) for i, n in enumerate(names)}


def checked_shards(df: DataFrame, root: str, file: str = "_source_file") -> DataFrame:
    """df with its shard's columns; the query fails on a file outside root or at another depth."""
    inside = F.col(file).startswith(root.rstrip("/") + "/")
    rest = F.substring(F.col(file), len(root.rstrip("/")) + 1, 1 << 30)
    fits = inside & rest.rlike("^" + SHARD_DEPTH)
    return df.withColumns(shard_columns(rest)).filter(F.assert_true(fits, F.concat(F.lit("not a shard of the corpus: "), F.col(file))).isNull())


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parts(df: DataFrame, path: str, keys: Sequence[str] = ("harness", "teacher_model", "source_dataset")) -> None:
    """Overwrites only the partitions that df has, so that a resumed job replaces what it redoes."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def not_done(files: DataFrame, done: DataFrame, key: str = "_source_file") -> DataFrame:
    """What a manifest of processed shards does not have yet."""
    return files.join(done.select(key).distinct(), key, "left_anti")


def list_shards(spark: SparkSession, path: str) -> DataFrame:
    """_source_file of every Parquet file under path, and its length, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(plain_path(F.col("path")).alias("_source_file"), "length")


def _written(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select(key)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def run_parts(trials: DataFrame, out: str, change: Callable[[DataFrame], DataFrame], limit: int | None = None, head: int | None = None, key: str = "_source_file", row_key: str = "trajectory_id") -> DataFrame:
    """Adds change(rows) of shards that out does not have yet, and gives the shards that were done.

    limit: as many shards at most, the first by name; head: as many rows of each at most, the first by row_key.
    A run appends all its shards or, if it fails, none, so it can be run again until nothing is left. change() has to keep `key`.
    """
    spark = trials.sparkSession
    todo, done = trials.select(key).distinct(), _written(spark, out, key)
    todo = todo if done is None else not_done(todo, done, key)
    todo = todo if limit is None else todo.orderBy(key).limit(limit)
    todo = spark.createDataFrame(todo.collect(), todo.schema)  # names of files
    rows = trials.join(F.broadcast(todo), key, "left_semi")
    if head is not None:
        rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(row_key))).filter(F.col("_at") <= head).drop("_at")
    change(rows).write.mode("append").parquet(out)
    return todo


def merge_parts(spark: SparkSession, parts: str, out: str, file_bytes: int = 256 << 20) -> None:
    """All parts as one table of files of about so many bytes, so that its writing has as many tasks."""
    size = list_shards(spark, parts).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    spark.read.parquet(parts).coalesce(max(1, -(-size // file_bytes))).write.mode("overwrite").parquet(out)


def build_sample(trials: DataFrame, n: int, seed: int, out: str, key: str = "trajectory_id") -> None:
    """n trials, the first in a seeded order, as JSON lines whose tool-call arguments are objects: what is no JSON object is kept as its `text`, none is empty."""
    order = F.md5(F.concat_ws("-", F.col(key), F.lit(str(seed))).cast("binary"))
    picked = trials.join(trials.select(key).orderBy(order, key).limit(n), key, "left_semi")

    def call(c: Column) -> Column:
        told = F.coalesce(c["function"]["arguments"], F.lit("{}"))
        parsed = F.try_parse_json(told)
        is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
        return c.withField("function", c["function"].withField("arguments", F.when(is_object, parsed).otherwise(F.to_variant_object(F.struct(told.alias("text"))))))

    messages = F.transform("messages", lambda m: m.withField("tool_calls", F.transform(m["tool_calls"], call)))
    picked.withColumn("messages", messages).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(out)


RESULT = "verifier_result struct<rewards:struct<reward:double>>, started_at timestamp, finished_at timestamp"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """job, trial, reward, started_at, finished_at of every `<job>/<trial>/result.json`; the whole file is one record, and one that cannot be read has nulls."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="result.json", recursiveFileLookup=True)
    parsed = raw.select(F.from_json("value", RESULT).alias("r"), plain_path(F.col("_metadata.file_path")).alias("file"))
    place = [F.regexp_extract("file", "([^/]+)/([^/]+)/result\\.json$", i + 1).alias(n) for i, n in enumerate(("job", "trial"))]
    return parsed.select(*place, F.col("r.verifier_result.rewards.reward").alias("reward"), "r.started_at", "r.finished_at")
