"""Views over trials and turns: typed columns, outcomes, summaries, cumulative counters."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.compat import percent, ref_round, text_to_int


def typed(trials: DataFrame) -> DataFrame:
    """The corpus's columns with nested patch figures as integers; counts read one field of the message array only."""
    patch = {f"{kind}_patch_{what}": text_to_int(F.col(f"metadata.{kind}_patch.num_modified_{what}")) for kind in ("reference", "model") for what in ("files", "lines")}
    return trials.withColumns(
        {"n_messages": F.array_size("messages.role"), "n_tools": F.array_size("tools"), "category": F.col("metadata.category"), "model_patch": F.col("metadata.model_patch.patch")} | patch
    )


def outcome(resolved: Column) -> Column:
    return F.when(resolved == 1, "success").when(resolved == 0, "failed").otherwise("unknown")


def resolved_split(group: DataFrame | object) -> list[Column]:
    """Aggregates: rows by outcome."""
    return [F.sum(F.when(F.col("resolved") == v, 1).otherwise(0)).alias(n) for v, n in ((1, "n_pass"), (0, "n_fail"), (-1, "n_unknown"))]


def corpus_summary(trials: DataFrame, task: str, repo: str) -> DataFrame:
    return trials.agg(F.count("*").alias("n_rows"), F.countDistinct(task).alias("n_tasks"), F.countDistinct(repo).alias("n_repos"), *resolved_split(trials))


def shares(df: DataFrame, key: str) -> DataFrame:
    """Rows and their percentage of the total for each value of a key; the window is over the aggregate's few rows."""
    total = F.sum("n").over(Window.partitionBy())
    return df.groupBy(key).agg(F.count("*").alias("n")).withColumn("pct", ref_round(100.0 * F.col("n") / total, 2))


def resolved_rates(trials: DataFrame, *keys: str) -> DataFrame:
    rates = [percent(F.col("resolved") == v, 1).alias(n) for v, n in ((1, "pct_pass"), (0, "pct_fail"), (-1, "pct_unknown"))]
    return trials.groupBy(*keys).agg(F.count("*").alias("n"), *rates)


def turns(trials: DataFrame, key: str, fields: tuple[str, ...], messages: str = "messages") -> DataFrame:
    """One row for each message, numbered from 1; rows without messages go. Only the named fields are read."""
    zipped = F.arrays_zip(*[F.col(f"{messages}.{f}").alias(f) for f in fields])
    out = trials.select(key, F.posexplode(zipped).alias("pos", "m"))
    return out.select(key, (F.col("pos") + 1).cast("long").alias("turn_idx"), *[F.col(f"m.{f}").alias(f) for f in fields])


def running(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def cumulative(df: DataFrame, key: str, order: tuple[str, ...], flags: dict[str, Column]) -> DataFrame:
    """Running counts of flags, and turn_idx and pct_through, within each key."""
    w = running(key, *order)
    whole = Window.partitionBy(key)
    counts = {name: F.sum(F.when(flag, 1).otherwise(0)).over(w) for name, flag in flags.items()}
    return df.withColumns(counts | {"turn_idx": F.count("*").over(w), "n_turns": F.count("*").over(whole)}).withColumn("pct_through", F.col("turn_idx").cast("double") / F.col("n_turns"))


def progress_bucket(pct: Column) -> Column:
    return F.when(pct <= 0.25, "0-25").when(pct <= 0.5, "25-50").when(pct <= 0.75, "50-75").otherwise("75-100")


def longest_run(df: DataFrame, key: str, order: tuple[str, ...], value: str) -> DataFrame:
    """The longest run of equal consecutive values of each key, by gaps and islands."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    islands = df.withColumn("_change", change).withColumn("_island", F.sum("_change").over(running(key, *order)))
    return islands.groupBy(key, "_island").agg(F.count("*").alias("n")).groupBy(key).agg(F.max("n").alias("longest_run"))


def positions(df: DataFrame, key: str, flag: Column, turn: str = "turn_idx") -> list[Column]:
    """Aggregates: the first and last turn at which a flag holds."""
    return [F.min(F.when(flag, F.col(turn))).alias("first_turn"), F.max(F.when(flag, F.col(turn))).alias("last_turn")]
