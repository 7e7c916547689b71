"""Task-level tables: difficulty, levels, pairs, verdicts, result roll-ups."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.compat import ratio, ref_round
from tracequarry.operators.order import sums_before


def difficulty(trials: DataFrame, task: str, resolved: str = "resolved") -> DataFrame:
    """n_rollouts, n_labeled, n_resolved and solve_rate of each task; unlabeled trials count as rollouts only."""
    r = F.col(resolved)
    return trials.groupBy(task).agg(F.count("*").alias("n_rollouts"), F.count_if(r.isin(0, 1)).alias("n_labeled"), F.count_if(r == 1).alias("n_resolved")).withColumn(
        "solve_rate", ratio(F.col("n_resolved"), F.col("n_labeled"))
    )


def difficulty_bucket(labeled: Column, solve_rate: Column) -> Column:
    return (
        F.when(labeled < 3, "unknown").when(solve_rate.isNull(), "unknown").when(solve_rate == 0, "all_fail").when(solve_rate == 1, "all_pass")
        .when(solve_rate < 0.34, "hard").when(solve_rate <= 0.66, "mid").otherwise("easy")
    )


def size_stratum(lines: Column) -> Column:
    return F.when(lines <= 30, "SMALL").when(lines >= 150, "LARGE").otherwise("MID")


def bins(df: DataFrame, n: int, by: Column, *tie: str) -> DataFrame:
    """df with `bin`, from 1, of n equal parts by rank, the first ones larger by one where n does not divide the rows; ties are broken by key.

    Ranks come from ranges of the order, so no task sorts all rows.
    """
    rows = sums_before(df, [by.asc_nulls_last(), *map(F.col, tie)], F.lit(1), "_before", "_all")
    small, more = F.floor(F.col("_all") / n), F.col("_all") % n
    in_large = F.col("_before") < more * (small + 1)
    place = F.when(in_large, F.floor(F.col("_before") / (small + 1))).otherwise(more + F.floor((F.col("_before") - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return rows.withColumn("bin", (place + 1).cast("int")).drop("_before", "_all")


def leave_one_out(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with the mean of the other rows of its key; null for a row alone."""
    w = Window.partitionBy(key)
    total, n = F.sum(value).over(w), F.count(value).over(w)
    return df.withColumn("loo_rate", (total - F.col(value)).cast("double") / F.nullif(n - 1, F.lit(0)))


def flip_point(levels: DataFrame, *keys: str) -> DataFrame:
    """The lowest level with two thirds of attempts passed, null if none."""
    return levels.groupBy(*keys).agg(F.min(F.when(3 * F.col("passes") >= 2 * F.col("attempts"), F.col("level"))).alias("flip"))


def nearest_half(levels: DataFrame, *keys: str) -> DataFrame:
    """The level whose pass rate is nearest one half; ties go to the lower level."""
    return levels.groupBy(*keys).agg(F.min_by("level", F.struct(F.abs(F.col("rate") - 0.5), F.col("level"))).alias("best_level"))


def pair_groups(trials: DataFrame, task: str, group: list[str]) -> DataFrame:
    """Trials of tasks with 5 labels or more and mixed results, in groups that hold a pass and a failure."""
    labeled = trials.filter(F.col("resolved").isin(0, 1))
    by_task, by_group = Window.partitionBy(task), Window.partitionBy(*group)
    return (
        labeled.withColumn("_n", F.count("*").over(by_task)).withColumn("_k", F.sum("resolved").over(by_task))
        .filter("_n >= 5 and _k > 0 and _k < _n")
        .withColumn("_lo", F.min("resolved").over(by_group)).withColumn("_hi", F.max("resolved").over(by_group))
        .filter("_lo = 0 and _hi = 1").drop("_n", "_k", "_lo", "_hi")
    )


TIERS = ("executed", "static", "documentary")


def top_tier(verdicts: DataFrame, keys: list[str], tier: str, *tie: str) -> DataFrame:
    """Verdicts ranked by tier within their keys: rank 1 holds, the others are secondary."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col(tier))
    return verdicts.withColumn("tier_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(rank > 0, rank).otherwise(9), *tie)))


def verdict(web_calls: Column, reward: Column) -> Column:
    """Contamination dominates; a trial without a reward is pending."""
    return F.when(web_calls > 0, "CONTAMINATED").when(reward == 1, "PASS").when(reward == 0, "FAIL").otherwise("PENDING")


def parse_trial(name: Column) -> dict[str, Column]:
    """unit and level of `<unit>-L<k>__<id>`, or of the older `<unit>-A<k>__<id>`, whose levels are two lower."""
    kind, k = F.regexp_extract(name, r"^(.*)-([LA])(\d+)__", 2), F.regexp_extract(name, r"^(.*)-([LA])(\d+)__", 3).try_cast("int")
    return {"unit": F.regexp_extract(name, r"^(.*)-([LA])(\d+)__", 1), "level": F.when(kind == "A", k + 2).otherwise(k)}


def roll_up(results: DataFrame, *keys: str) -> DataFrame:
    """attempts, passes, pass_rate of each cell."""
    return results.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if("passed").alias("passes")).withColumn("pass_rate", ref_round(ratio(F.col("passes"), F.col("attempts")), 3))


def package_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """The last package-level status of each package of a test run's JSON lines; other lines and bad ones are skipped."""
    e = F.from_json(F.col(line), "Action string, Package string, Test string, Elapsed double")
    events = lines.select("seq", e.alias("e")).filter("e.Package is not null and e.Test is null and e.Action in ('pass', 'fail', 'skip')")
    return events.groupBy(F.col("e.Package").alias("package")).agg(F.max_by("e.Action", "seq").alias("action")).select("package", F.when(F.col("action") == "pass", "ok").otherwise(F.col("action")).alias("status"))
