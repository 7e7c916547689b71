"""Queries that leave a record: what was asked, how long it took, what came out, and which invariants did not hold."""

import time
import traceback

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG = "name string, sql string, at timestamp, seconds double, n_rows long, violations map<string,long>, error string"


def run_observed(spark: SparkSession, sql: str, out: str, log: str, name: str = "adhoc", invariants: dict[str, str] | None = None, **tables: DataFrame) -> DataFrame:
    """Writes a query's result to `out`, adds a row to the log, and gives the result as a table.

    invariants: conditions, by name, that hold for every row; a null does not hold. Rows and violations are counted while the result is written, so nothing is read twice.
    tables: frames that the text names in braces. A query that fails is logged with its error, which is raised.
    """
    began, seen, found, error = time.time(), Observation(), {}, None
    rules = invariants or {}
    try:
        counts = [F.count_if(~F.coalesce(F.expr(rule).cast("boolean"), F.lit(False))).alias(f"rule_{i}") for i, rule in enumerate(rules.values())]
        spark.sql(sql, **tables).observe(seen, F.count(F.lit(1)).alias("n_rows"), *counts).write.mode("overwrite").parquet(out)
        found = seen.get
    except Exception as e:
        error = "".join(traceback.format_exception_only(e)).strip()[:2000]
        raise
    finally:
        broken = {rule: found[f"rule_{i}"] for i, rule in enumerate(rules) if found.get(f"rule_{i}")}
        row = [(name, sql, None, round(time.time() - began, 3), found.get("n_rows"), broken, error)]
        spark.createDataFrame(row, LOG).withColumn("at", F.timestamp_seconds(F.lit(began))).coalesce(1).write.mode("append").parquet(log)
    return spark.read.parquet(out)


def latest_runs(spark: SparkSession, log: str) -> DataFrame:
    """The last run of each query, with how its rows changed against the run before."""
    runs = spark.read.parquet(log)
    newest = runs.groupBy("name").agg(F.max_by(F.struct(*runs.columns[1:]), "at").alias("last"), F.slice(F.sort_array(F.collect_list(F.struct("at", "n_rows")), asc=False), 1, 2).alias("two"), F.count("*").alias("n_runs"))
    return newest.select("name", "last.*", "n_runs", (F.get("two", F.lit(0))["n_rows"] - F.get("two", F.lit(1))["n_rows"]).alias("rows_gained"))


#: What holds for every row of the structural features.
FEATURE_RULES = {
    "label is known or -1": "resolved IN (-1, 0, 1)",
    **{f"{c} is counted": f"{c} >= 0" for c in ("n_messages", "n_assistant_turns", "n_tool_calls", "n_edit_calls", "n_test_calls", "assistant_chars", "reasoning_chars", "tool_obs_chars")},
    "edits are calls": "n_edit_calls <= n_tool_calls",
    "a rate is a share": "repeat_call_rate BETWEEN 0 AND 1",
    "runs are calls": "max_consecutive_identical_calls <= n_tool_calls",
}
