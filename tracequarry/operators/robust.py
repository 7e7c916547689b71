"""Models and tests of pass rates whose trials come in clusters: robust errors, a geometric law, dispersion within units."""

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.order import checkpoints


def _vector(x: list[Column], weight: Column, names: str) -> list[Column]:
    return [F.sum(weight * c).alias(f"{names}{i}") for i, c in enumerate(x)]


def cluster_logistic(df: DataFrame, label: str, features: list[str], cluster: str, rounds: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """feature, coef, se, z, p_value, n, n_clusters of a logistic regression whose errors allow for trials that go together in clusters.

    Each round of weighted least squares is one aggregation of slopes and bends. Errors are a sandwich: scores are summed up by cluster, and
    those sums' products are the middle, scaled by G / (G - 1) * (n - 1) / (n - k). Features are centred and scaled for the fit, and
    coefficients and errors turned back. Rows with a null are left out. Labels of one kind, labels that the features tell apart, which have no finite coefficients, and
    features that follow from one another are errors.
    """
    checkpoints(df.sparkSession)
    rows = df.select(F.col(label).cast("double").alias("y"), F.col(cluster).alias("g"), *[F.col(f).cast("double").alias(f"x{i + 1}") for i, f in enumerate(features)]).dropna().checkpoint()
    k = len(features) + 1
    told = rows.agg(*[f(F.col(f"x{i}")).alias(f"{name}{i}") for i in range(1, k) for name, f in (("m", F.avg), ("s", F.stddev_pop))], F.count("*").alias("n")).first()
    mean, size = (np.array([told[f"{name}{i}"] or 0.0 for i in range(1, k)]) for name in ("m", "s"))
    if (size == 0).any():
        raise ValueError("a feature has one value only")
    x = [F.lit(1.0), *[(F.col(f"x{i}") - float(mean[i - 1])) / float(size[i - 1]) for i in range(1, k)]]

    def chance(beta: np.ndarray) -> Column:
        return 1 / (1 + F.exp(-sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0))))

    def evaluated(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int, int]:
        p = chance(beta)
        near = F.greatest(p, F.lit(1e-300)), F.greatest(1 - p, F.lit(1e-300))
        fit = F.sum(F.when(F.col("y") == 1, F.log(near[0])).otherwise(F.log(near[1])))
        bends = [F.sum(p * (1 - p) * x[a] * x[b]).alias(f"h{a}_{b}") for a in range(k) for b in range(a, k)]
        r = rows.agg(fit.alias("fit"), *_vector(x, F.col("y") - p, "g"), *bends, F.count("*").alias("n"), F.sum("y").alias("k")).first()
        h = np.array([[r[f"h{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(k)] for a in range(k)])
        return r["fit"] or 0.0, np.array([r[f"g{i}"] or 0.0 for i in range(k)]), h, r["n"], int(r["k"] or 0)

    beta, now = np.zeros(k), evaluated(np.zeros(k))
    if not 0 < now[4] < now[3]:
        raise ValueError("a logistic regression needs labels of both kinds")
    for _ in range(rounds):
        step = np.linalg.lstsq(now[2], now[1], rcond=None)[0]
        after = evaluated(beta + step)
        while after[0] < now[0] - 1e-9 * abs(now[0]):
            step = step / 2
            after = evaluated(beta + step)
        beta, now = beta + step, after
        if np.abs(step).max() <= tolerance * max(1.0, np.abs(beta).max()):
            break
    diagonal = np.sqrt(np.maximum(np.diag(now[2]), 1e-300))
    if now[0] > -1e-6 * now[3] or np.linalg.eigvalsh(now[2] / np.outer(diagonal, diagonal))[0] < 1e-8:
        raise ValueError("the fit has no end: features follow from one another, or tell the labels apart")
    by_cluster = rows.groupBy("g").agg(*_vector(x, F.col("y") - chance(beta), "s"))
    r = by_cluster.agg(*[F.sum(F.col(f"s{a}") * F.col(f"s{b}")).alias(f"m{a}_{b}") for a in range(k) for b in range(a, k)], F.count("*").alias("clusters")).first()
    middle = np.array([[r[f"m{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])
    bread, clusters, n = np.linalg.pinv(now[2]), r["clusters"], now[3]
    scale = clusters / max(clusters - 1, 1) * (n - 1) / max(n - k, 1)
    back = np.diag(np.append(1.0, 1 / size))
    back[0, 1:] = -mean / size
    beta, cover = back @ beta, back @ (bread @ middle @ bread * scale) @ back.T
    se = np.sqrt(np.maximum(np.diag(cover), 0))
    out = [(f, float(b), float(s), float(b / s) if s else None, math.erfc(abs(b / s) / math.sqrt(2)) if s else None, n, clusters) for f, b, s in zip(["(intercept)", *features], beta, se, strict=True)]
    return df.sparkSession.createDataFrame(out, "feature string, coef double, se double, z double, p_value double, n long, n_clusters long")


def _geometric(d: Column, n: Column, k: Column) -> tuple[Column, Column]:
    """Summands of the weighted fit of log rate = d log p: (weight * d * log rate, weight * d^2). Rates are kept off 0 and 1."""
    q = (k + 0.5) / (n + 1.0)
    weight = n * q / (1 - q)
    return weight * d * F.log(q), weight * d * d


def _distance(d: Column, n: Column, k: Column, log_p: Column) -> Column:
    """What a cell adds to the statistic."""
    p = F.exp(log_p * d)
    return (k - n * p) * (k - n * p) / (n * p * (1 - p))


def chance_score(statistic: Column, degrees: Column) -> Column:
    """A chi-square statistic as a normal score, by its cube root."""
    spread = 2.0 / (9.0 * F.nullif(degrees, F.lit(0)))
    return (F.pow(statistic / F.nullif(degrees, F.lit(0)), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)


def geometric_test(cells: DataFrame, detail: str, n: str, k: str) -> DataFrame:
    """p, statistic, degrees, z: whether pass rates fall as p^d with the number d > 0 of details; one row, from the counts of each d."""
    counts = cells.groupBy(F.col(detail).cast("double").alias("d")).agg(F.sum(n).cast("double").alias("n"), F.sum(k).cast("double").alias("k"))
    top, below = _geometric(F.col("d"), F.col("n"), F.col("k"))
    fitted = counts.agg((F.sum(top) / F.sum(below)).alias("log_p"))
    told = counts.crossJoin(F.broadcast(fitted)).agg(F.max("log_p").alias("log_p"), F.sum(_distance(F.col("d"), F.col("n"), F.col("k"), F.col("log_p"))).alias("statistic"), (F.count("*") - 1).alias("degrees"))
    return told.select(F.exp("log_p").alias("p"), "statistic", "degrees", chance_score(F.col("statistic"), F.col("degrees")).alias("z"))


def unit_dispersion(cells: DataFrame, unit: str, detail: str, n: str, k: str) -> DataFrame:
    """n_units, statistic, degrees, ratio, z: how far cells of a unit are from the unit's own geometric law; a ratio over 1 is more spread than chance gives."""
    counts = cells.groupBy(unit, F.col(detail).cast("double").alias("d")).agg(F.sum(n).cast("double").alias("n"), F.sum(k).cast("double").alias("k"))
    top, below = _geometric(F.col("d"), F.col("n"), F.col("k"))
    fitted = counts.groupBy(unit).agg((F.sum(top) / F.sum(below)).alias("log_p"), F.count("*").alias("n_cells")).filter("n_cells > 1")
    told = counts.join(fitted, unit).agg(F.countDistinct(unit).alias("n_units"), F.sum(_distance(F.col("d"), F.col("n"), F.col("k"), F.col("log_p"))).alias("statistic"), (F.count("*") - F.countDistinct(unit)).alias("degrees"))
    return told.select("n_units", "statistic", "degrees", (F.col("statistic") / F.nullif("degrees", F.lit(0))).alias("ratio"), chance_score(F.col("statistic"), F.col("degrees")).alias("z"))
