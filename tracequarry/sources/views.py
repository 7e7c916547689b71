"""Named views over a corpus, and summary tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.compat import plain_path
from tracequarry.operators import rollups, tasks
from tracequarry.operators import trials as t
from tracequarry.operators.rollups import RollUp
from tracequarry.sources.corpus import TRIAL, read_trials, shard_columns
from tracequarry.sources.drift import read_drifting


def register_views(spark: SparkSession, root: str) -> None:
    """traces_raw, traces, trial_summary, trace_turns and the catalog views over all shards under root; nothing is read yet."""
    raw = read_trials(spark, root)
    raw.createOrReplaceTempView("traces_raw")
    traces = t.typed(raw).withColumns(shard_columns(F.col("_source_file")))
    traces.createOrReplaceTempView("traces")
    outcome = t.outcome(F.col("resolved")).alias("outcome_label")
    traces.select("trajectory_id", "instance_id", "repo", "language", "category", "harness", "teacher_model", "resolved", outcome, "n_messages", (F.coalesce(F.length("model_patch"), F.lit(0)) > 0).alias("has_patch")).createOrReplaceTempView("trial_summary")
    turns = t.turns(raw, "trajectory_id", ("role", "content", "tool_calls"))
    turns.select(
        "trajectory_id", "turn_idx", "role", F.length(F.coalesce("content", F.lit(""))).alias("content_len"),
        (F.col("role") == "assistant").alias("has_tool_call"),  # as the reference has it: the field is there, even if null
        (F.coalesce(F.size("tool_calls"), F.lit(0)) > 0).alias("has_tool_call_nonempty"),
    ).createOrReplaceTempView("trace_turns")
    traces.groupBy("harness", "teacher_model").agg(F.count("*").alias("n"), F.countDistinct("instance_id").alias("n_tasks")).createOrReplaceTempView("catalog_by_harness")
    t.resolved_rates(traces, "harness", "teacher_model").createOrReplaceTempView("catalog_resolved_rates")


def register_drifting(spark: SparkSession, paths: Sequence[str], name: str = "traces_raw") -> DataFrame:
    """A view of all shards under paths, whatever their schemas, with `_source_file`; later shards are seen when it is registered again."""
    view = read_drifting(spark, paths, source_file=True)
    view.createOrReplaceTempView(name)
    return view


#: The summary tables, each of which is a roll-up of `traces`.
SUMMARIES = {
    "trace_summary_by_language": RollUp(("language", "resolved"), means={"avg_messages": "n_messages", "avg_model_lines": "model_patch_lines", "avg_gold_lines": "reference_patch_lines"}, digits=1),
    "trace_summary_by_category": RollUp(("category", "resolved"), means={"avg_messages": "n_messages"}, digits=1),
    "trace_empty_patch_rate": RollUp(("harness", "teacher_model"), means={"pct_empty_model_patch": "if(coalesce(model_patch, '') = '', 100.0, 0.0)"}, distinct={"n_tasks": "instance_id"}, digits=2),
}


def refresh_summaries(spark: SparkSession, root: str, store: str, database: str = "default") -> dict[str, list[str]]:
    """Writes the summary tables anew and gives, for each, the shards that were read: those that came or changed since the store last saw them."""

    def traces(files: list[str]) -> DataFrame:
        raw = spark.read.schema(TRIAL).parquet(*files).withColumns({"_source_file": plain_path(F.col("_metadata.file_path")), "_metadata": F.col("_metadata")})
        return t.typed(raw).withColumns(shard_columns(F.col("_source_file")))

    seen = {}
    for name, spec in SUMMARIES.items():
        seen[name] = rollups.refresh(spark, root, f"{store}/{name}", spec, traces)
        rollups.rolled(spark, root, f"{store}/{name}", spec).write.mode("overwrite").saveAsTable(f"{database}.{name}")
    return seen


def build_database(spark: SparkSession, database: str, frames: dict[str, DataFrame], note: str = "") -> list[str]:
    """Writes frames as tables of a database of their own, which is made if it is not there, and gives their full names.

    Tables of other databases stay as they are, and a query may name those of several.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    for name, df in frames.items():
        df.write.mode("overwrite").option("comment", note).saveAsTable(f"`{database}`.`{name}`")
    return [f"{database}.{name}" for name in sorted(frames)]


def analysis_frames(spark: SparkSession) -> dict[str, DataFrame]:
    """What the analysis database is made from, by the views of the first one: a row for each trial, and the difficulty of each task."""
    trials = spark.table("trial_summary")
    return {"trials": trials, "task_difficulty": tasks.difficulty(trials, "instance_id").withColumn("bucket", tasks.difficulty_bucket(F.col("n_labeled"), F.col("solve_rate")))}
