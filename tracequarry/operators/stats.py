"""Statistics: correlations, AUC, splits, samples, budgets, and small fitted models."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.functions.compat import ref_round
from tracequarry.operators.order import sums_before


def pearson(df: DataFrame, target: str, features: list[str], digits: int = 6) -> DataFrame:
    """feature, r: all correlations in one aggregation."""
    row = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), ref_round(F.col(f), digits).alias("r")) for f in features])).alias("x")).select("x.feature", "x.r")


def average_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with value's rank among all rows, ties at their mean.

    Ranks come from the distinct values and their counts, which are summed up by ranges of values, so no task sorts all rows or all values.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    ranks = sums_before(counts, [F.col(value)], F.col("_n"), "_before").select(F.col(value).alias("_value"), (F.col("_before") + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, df[value].eqNullSafe(ranks["_value"])).drop("_value")


def spearman(df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    both = average_rank(average_rank(df.dropna(subset=[a, b]).select(a, b), a, "_ra"), b, "_rb")
    return both.agg(ref_round(F.corr("_ra", "_rb"), digits).alias("rho"))


def auc(df: DataFrame, label: str, score: str, digits: int = 6) -> DataFrame:
    """Area under the ROC curve by rank sums; ties count half."""
    ranked = average_rank(df.select(label, score), score, "_rank")
    pos = F.count_if(F.col(label) == 1).cast("double")
    neg = F.count_if(F.col(label) == 0).cast("double")
    ranks = F.sum(F.when(F.col(label) == 1, F.col("_rank")).otherwise(0.0))
    return ranked.agg(ref_round((ranks - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0.0)), digits).alias("auc"))


def hash_share(key: Column, seed: int = 42) -> Column:
    """A whole number from 0 to 99 that only the key and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long") % 100


def hash_order(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(seed))).cast("binary"))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each stratum, the first in a seeded order."""
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= n).drop("_at")


def budgeted(df: DataFrame, arm: str, size: str, order: list, budget: int) -> DataFrame:
    """The rows of each arm, in order, while their running size stays within the budget.

    Sizes are summed up by ranges of the whole order, so no task sorts an arm.
    """
    rows = sums_before(df, [F.col(arm), *order], F.col(size), "_before")
    starts = rows.groupBy(F.col(arm).alias("_arm")).agg(F.min("_before").alias("_start"))
    running = rows.join(starts, F.col(arm).eqNullSafe(F.col("_arm"))).withColumn("running", F.col("_before") - F.col("_start") + F.col(size))
    return running.filter(F.col("running") <= budget).drop("_before", "_start", "_arm")


def logistic(df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """feature, coef of a logistic regression on standardized features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = df.select(F.col(label).cast("double").alias("label"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    x = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    model = LogisticRegression(maxIter=50, regParam=1e-4).fit(x)
    return df.sparkSession.createDataFrame([(f, float(c)) for f, c in zip(features, model.coefficients, strict=True)], "feature string, coef double")


def strongest(coefficients: DataFrame, n: int = 5) -> DataFrame:
    """The n coefficients of the largest absolute size, with their places; ties go by name."""
    first = coefficients.orderBy(F.desc(F.abs("coef")), "feature").limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("coef")), "feature")))


def weighted_linear(df: DataFrame, target: str, weight: str, features: list[str]) -> DataFrame:
    """feature, coef of a weighted linear regression on standardized features."""
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.select(F.col(target).cast("double").alias("label"), F.col(weight).cast("double").alias("w"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    x = VectorAssembler(inputCols=features, outputCol="raw").transform(rows)
    x = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(x).transform(x)
    model = LinearRegression(weightCol="w", solver="normal").fit(x)
    return df.sparkSession.createDataFrame([(f, float(c)) for f, c in zip(features, model.coefficients, strict=True)], "feature string, coef double")


def counts_of(trials: DataFrame, task: str, combo: str) -> DataFrame:
    """(task, combo, n, k): the sufficient statistics of the response model, one row for each pair of task and combo."""
    return trials.filter(F.col("resolved").isin(0, 1)).groupBy(task, combo).agg(F.count("*").alias("n"), F.sum("resolved").cast("long").alias("k"))


def _solved(n: np.ndarray, k: np.ndarray, theta: np.ndarray, two_parameters: bool, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(difficulty, log discrimination) of each task, given the combos' abilities; n, k: trials and passes of (tasks, combos)."""
    b, log_a = np.zeros(len(n)), np.zeros(len(n))
    for _ in range(steps):
        a, off = np.exp(log_a)[:, None], theta[None, :] - b[:, None]
        p = 1 / (1 + np.exp(-a * off))
        rest, spread = k - n * p, n * p * (1 - p)
        step = np.clip((-(a * rest).sum(axis=1) - b) / ((a * a * spread).sum(axis=1) + 1), -1, 1)
        b, moved = b + step, np.abs(step)
        if two_parameters:
            off = theta[None, :] - b[:, None]
            p = 1 / (1 + np.exp(-a * off))
            slope, bend = ((k - n * p) * a * off).sum(axis=1) - 4 * log_a, (n * p * (1 - p) * (a * off) ** 2).sum(axis=1) + 4
            step = np.clip(slope / bend, -0.5, 0.5)
            log_a, moved = log_a + step, np.maximum(moved, np.abs(step))
        if moved.max(initial=0) < 1e-10:
            break
    return b, log_a


def fit_response(counts: DataFrame, task: str, combo: str, two_parameters: bool = False, rounds: int = 300, tolerance: float = 1e-4, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(b and log_a of each task, theta of each combo) of a one- or two-parameter logistic model with normal priors: theta and b of
    variance 1, log_a of 0.25. Tasks with fewer than `least` trials are left out.

    A task's parameters follow from the abilities, so nothing of it is kept between rounds: each round is one aggregation of what tasks
    say of each combo, until no ability moves by `tolerance`. Combos are few and known to the driver; tasks are never collected.
    """
    combos = sorted(r[0] for r in counts.select(combo).distinct().collect())
    at = [F.sum(F.when(F.col(combo) == c, F.col(x)).otherwise(0)).cast("double") for x in ("n", "k") for c in combos]
    wide = counts.groupBy(task).agg(F.sum("n").alias("_all"), F.array(*at[: len(combos)]).alias("_n"), F.array(*at[len(combos) :]).alias("_k")).filter(F.col("_all") >= least)
    wide = wide.select(task, "_n", "_k").checkpoint()

    def matrices(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array(batch[x].tolist(), float).reshape(len(batch), len(combos)) for x in ("_n", "_k"))

    theta = np.zeros(len(combos))
    for _ in range(rounds if combos else 0):

        def told(batches: Iterator[pd.DataFrame], theta=theta) -> Iterator[pd.DataFrame]:
            for batch in batches:
                n, k = matrices(batch)
                b, log_a = _solved(n, k, theta, two_parameters)
                a = np.exp(log_a)[:, None]
                p = 1 / (1 + np.exp(-a * (theta[None, :] - b[:, None])))
                yield pd.DataFrame({"at": np.arange(len(combos)), "g": (a * (k - n * p)).sum(axis=0), "h": (a * a * n * p * (1 - p)).sum(axis=0)})

        g, h = np.zeros((2, len(combos)))
        for r in wide.select("_n", "_k").mapInPandas(told, "at int, g double, h double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            g[r["at"]], h[r["at"]] = r.g, r.h
        step = (g - theta) / (h + 1)
        theta = theta + step
        if np.abs(step).max() < tolerance:
            break
    else:
        if combos:
            raise ValueError(f"the response model's abilities still move after {rounds} rounds")

    def parameters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            b, log_a = _solved(*matrices(batch), theta, two_parameters)
            yield pd.DataFrame({task: batch[task], "b": b, "log_a": log_a})

    kind = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    tasks = wide.mapInPandas(parameters, f"`{task}` {kind[task]}, b double, log_a double")
    return tasks, counts.sparkSession.createDataFrame([(c, float(t)) for c, t in zip(combos, theta, strict=True)], f"`{combo}` {kind[combo]}, theta double")


def binomial_mixture(histogram: list[tuple[int, int, int]], rounds: int = 20_000, tolerance: float = 1e-14) -> list[tuple[float, float]]:
    """(weight, rate) of two binomial components, by EM over (n, k, tasks) counts, as many rows as there are pairs (n, k), until the likelihood gains less than tolerance, as a share; an error if it does not end."""
    n, k, m = (np.array(x, float) for x in zip(*histogram, strict=True)) if histogram else (np.zeros(0),) * 3
    w, p, before = np.array([0.5, 0.5]), np.array([0.2, 0.8]), -np.inf
    for _ in range(rounds if len(n) else 0):
        log = np.log(w) + k[:, None] * np.log(p) + (n - k)[:, None] * np.log1p(-p)
        top = log.max(axis=1, keepdims=True)
        r = np.exp(log - top)
        likelihood = float((m * (top[:, 0] + np.log(r.sum(axis=1)))).sum())
        if likelihood - before <= tolerance * abs(likelihood):
            break
        before = likelihood
        r = r / r.sum(axis=1, keepdims=True) * m[:, None]
        w = r.sum(axis=0) / m.sum()
        p = np.clip((r * k[:, None]).sum(axis=0) / np.maximum((r * n[:, None]).sum(axis=0), 1e-9), 1e-6, 1 - 1e-6)
    else:
        if len(n):
            raise ValueError("the mixture's fit does not end")
    return [(float(a), float(b)) for a, b in zip(w, p, strict=True)]


def mixture_of(tasks: DataFrame, n: str = "n_labeled", k: str = "n_resolved") -> DataFrame:
    """component, weight, rate of the two-component mixture behind tasks' solve rates."""
    counts = tasks.filter(F.col(n) > 0).groupBy(n, k).agg(F.count("*").alias("m")).collect()
    found = binomial_mixture([(r[0], r[1], r[2]) for r in counts])
    return tasks.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(found)], "component int, weight double, rate double")


def quantile_matched(df: DataFrame, order: list, shares: list[tuple[str, int]], name: str = "bucket") -> DataFrame:
    """df with a bucket for each row: in the given total order, buckets take their shares (name, count) of all rows.

    Places come from ranges of the order, so no task sorts all rows.
    """
    total, passed, out = sum(n for _, n in shares), 0, F.lit(None).cast("string")
    bounds = []
    for bucket, n in shares:
        passed += n
        bounds.append((bucket, passed))
    for bucket, passed in reversed(bounds):
        out = F.when((F.col("_before") + 1) * total <= F.col("_all") * passed, bucket).otherwise(out)
    return sums_before(df, order, F.lit(1), "_before", "_all").withColumn(name, out).drop("_before", "_all")


def described(df: DataFrame) -> DataFrame:
    """column_name, data_type of df, as rows."""
    schema = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("data_type", T.StringType())])
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], schema)
