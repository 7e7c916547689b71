"""Folders of trials: `<job>/<trial>/agent/*` beside `<job>/<trial>/result.json`."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.compat import plain_path, ref_round
from tracequarry.operators.tasks import verdict
from tracequarry.sources.corpus import read_results

#: Kinds of calls that reach the web.
WEB = ("webFetch", "webSearch")
_AGENT = "([^/]+)/([^/]+)/agent[^/]*/([^/]+)$"


def placed(df: DataFrame) -> DataFrame:
    """df with job, trial and file in the place of `path`; rows of files that are no agent logs go."""
    path = plain_path(F.col("path"))
    rows = df.withColumn("path", path).filter(F.col("path").rlike(_AGENT))
    return rows.select(*[F.regexp_extract("path", _AGENT, i + 1).alias(n) for i, n in enumerate(("job", "trial", "file"))], *[c for c in df.columns if c != "path"])


def log_files(spark: SparkSession, root: str) -> DataFrame:
    """job, trial, file of every agent log under root. The names come from the listing that the driver makes of them anyway, as scans pass over empty files."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).inputFiles()
    return placed(spark.createDataFrame([(n,) for n in names], "path string"))


def log_lines(spark: SparkSession, root: str) -> DataFrame:
    """path, line, is_json of the lines of all files under root; large files are read in splits. Blank lines go; others that are no JSON object, or go on after one, are marked, not lost.

    A path is the same on all lines of a file, so it is taken apart by placed() after lines are counted or picked.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line")).filter(F.trim("line") != "")
    return lines.withColumn("is_json", F.json_object_keys("line").isNotNull() & F.rtrim("line").endswith("}"))


def call_counts(lines: DataFrame) -> DataFrame:
    """job, trial, kind, n of the calls `<kind>ToolCall` that a trial's logs name, wherever they stand in a line."""
    kinds = F.regexp_extract_all("line", F.lit(r"([A-Za-z]+)ToolCall"), F.lit(1))
    by_file = lines.select("path", F.explode(kinds).alias("kind")).groupBy("path", "kind").agg(F.count("*").alias("n"))
    return placed(by_file).groupBy("job", "trial", "kind").agg(F.sum("n").alias("n"))


def log_summary(lines: DataFrame) -> DataFrame:
    """job, trial, n_lines, n_malformed and the number of each web call; a file's lines combine where they are read."""
    calls = {f"n_{w.removeprefix('web').lower()}": F.sum(F.regexp_count("line", F.lit(f"{w}ToolCall"))) for w in WEB}
    by_file = lines.groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(~F.col("is_json")).alias("n_malformed"), *[c.alias(n) for n, c in calls.items()])
    return placed(by_file).groupBy("job", "trial").agg(*[F.sum(n).alias(n) for n in ("n_lines", "n_malformed", *calls)])


def audited(trials: DataFrame, summary: DataFrame, results: DataFrame) -> DataFrame:
    """job, trial, task, verdict, reward, minutes, n_fetch, n_search, n_lines, n_malformed of each trial that has logs.

    trials: job, trial; results: job, trial, reward, started_at, finished_at. A trial without a readable result is pending, unless it is contaminated.
    """
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_fetch", "n_search", "n_lines", "n_malformed")]
    minutes = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 6e7
    rows = trials.select("job", "trial").distinct().join(summary, ["job", "trial"], "left").join(results, ["job", "trial"], "left")
    rows = rows.select("job", "trial", F.substring_index("trial", "__", 1).alias("task"), "reward", ref_round(minutes, 1).alias("minutes"), *counts)
    return rows.withColumn("verdict", verdict(F.col("n_fetch") + F.col("n_search"), F.col("reward")))


def web_audit(spark: SparkSession, root: str) -> DataFrame:
    """The audit of every trial folder under root."""
    return audited(log_files(spark, root), log_summary(log_lines(spark, root)), read_results(spark, root))
