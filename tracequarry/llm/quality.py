"""A quality classifier: a generalised additive model with pairwise interactions, boosted in cycles.

A text is told by plain counts (FEATURES), worked out by Spark's own functions in one pass over whole texts. The model is a sum of
lookup tables, one for each feature and one for each of a few pairs of features. Tables start at zero; in turn, each feature gets a
shallow tree over its bins, fitted to what all tables so far leave of the labels, and a share of it is added to the feature's table;
then the pairs whose quadrants explain most of the rest are taken, and their tables are boosted in the same way. Scoring is a search for
the bin of each feature and a sum of table entries, a column at a time.

The model is fitted in one task on SAMPLE labelled training rows at most, evenly drawn by a hash of their ids; the result does not depend on the order
of rows. Ids, languages, sources and labels are no features.

Defined results: null and empty texts, and texts of white space, have counts of zero and are scored like any other; texts are read
whole, however long; held out are ids whose checksum says so, never a null id; a label other than 0 and 1 or of a null id teaches
nothing, nor does an id that has both; rows that repeat an id each get a row, and each is one of the sample; without a label, all scores are one half, and
with labels of one kind only nearly 0 or 1; an empty table gives no row; other columns are ignored, whatever their names.
"""

import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, staged

#: The bound on the labelled rows that the model is fitted on.
SAMPLE = 12_000
FOLDS, HELD_OUT = 5, 0
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 150, 50, 8, 0.1
#: Splits of a tree, the least weight of a leaf, and the pull of leaves towards zero.
SPLITS, LEAST, PULL = 2, 2.0, 1.0
THRESHOLD = 0.3

FEATURES = ("chars", "words", "word_length", "letters", "capitals", "digits", "white", "marks", "symbols", "loud", "distinct", "repeats", "bare", "shouted", "tails", "lines", "line_length", "distinct_lines", "ended")

_MARK = r""".,;:!?'"()…«»\-"""


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each text. Every pattern is read from left to right once, so a text of any shape takes time in proportion."""
    told = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    t = F.col("t")
    white = F.length(t) - F.length(F.regexp_replace(t, r"\s", ""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.split(t, "\n")
    told = told.select(
        "doc_id", F.length(t).cast("double").alias("n"), white.cast("double").alias("n_white"), F.size(words).cast("double").alias("n_words"), F.size(F.array_distinct(words)).cast("double").alias("n_distinct"),
        F.size(lines).cast("double").alias("n_lines"), F.size(F.array_distinct(lines)).cast("double").alias("n_distinct_lines"),
        _count(t, r"\p{L}").alias("n_letters"), _count(t, r"\p{Lu}").alias("n_capitals"), _count(t, "[0-9]").alias("n_digits"), _count(t, f"[{_MARK}]").alias("n_marks"),
        _count(t, "[!?]{2,}+").alias("n_loud"), _count(t, r"(?<!\S)(\S++)(?=\s++\1(?!\S))").alias("n_repeats"), _count(t, r"(?<!\S)[^\p{L}\s]++(?!\S)").alias("n_bare"),
        _count(t, r"(?<!\S)[^\p{L}\s]*+\p{Lu}{2}").alias("n_shouted"), _count(t, rf"[^\p{{L}}\p{{N}}\s{_MARK}](?!\S)").alias("n_tails"), _count(t, r'[.!?…"»](?=\n|\z)').alias("n_ended"),
    )
    n, n_words, n_lines, n_letters = (F.greatest(F.col(c), F.lit(1.0)) for c in ("n", "n_words", "n_lines", "n_letters"))
    values = {
        "chars": F.log1p("n"), "words": F.log1p("n_words"), "word_length": (F.col("n") - F.col("n_white")) / n_words, "letters": F.col("n_letters") / n, "capitals": F.col("n_capitals") / n_letters,
        "digits": F.col("n_digits") / n, "white": F.col("n_white") / n, "marks": F.col("n_marks") / n_words, "symbols": (F.col("n") - F.col("n_white") - F.col("n_letters") - F.col("n_digits") - F.col("n_marks")) / n,
        "loud": F.col("n_loud") / n_words, "distinct": F.col("n_distinct") / n_words, "repeats": F.col("n_repeats") / n_words, "bare": F.col("n_bare") / n_words, "shouted": F.col("n_shouted") / n_words,
        "tails": F.col("n_tails") / n_words, "lines": F.log1p("n_lines"), "line_length": F.col("n") / n_lines, "distinct_lines": F.col("n_distinct_lines") / n_lines, "ended": F.col("n_ended") / n_lines,
    }
    return told.select("doc_id", *[values[f].alias(f) for f in FEATURES])


def held_out() -> Column:
    return F.coalesce(crc_of_id() % FOLDS == HELD_OUT, F.lit(False))


# --- the model -----------------------------------------------------------------------------------


def edges_of(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts at the quantiles of a feature; a value on a cut is above it."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, side="right")


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PULL)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """What the best cut of a row of bins gains, and where it is; 0 gain without one."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
    gain = np.where((left_h >= LEAST) & (all_h - left_h >= LEAST), gain, 0.0)
    if not len(gain) or gain.max() <= 1e-12:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, splits: int = SPLITS) -> np.ndarray:
    """What a tree of a few splits adds to each bin; g, h: slopes and bends of the loss by bin."""
    leaves = [(0, len(g))]
    for _ in range(splits):
        cuts = [(*best_cut(g[a:b], h[a:b]), a, b) for a, b in leaves]
        gain, at, a, b = max(cuts, key=lambda c: c[0])
        if gain <= 0:
            break
        leaves.remove((a, b))
        leaves += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in leaves:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + PULL)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Of a grid of bins: a cut of one side and then one of the other in each half, whichever side first gains more; its gain and what it adds to each cell."""
    found = []
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        best, where = best_cut(a.sum(axis=1), b.sum(axis=1))
        if best <= 0:  # no first cut gains by itself: half and half
            where = len(a) // 2
        out, gain = np.zeros(a.shape), best
        for part in (slice(0, where), slice(where, len(a))):
            if part.start == part.stop:
                continue
            more, _ = best_cut(a[part].sum(axis=0), b[part].sum(axis=0))
            gain += more
            out[part] = shallow_tree(a[part].sum(axis=0), b[part].sum(axis=0), 1)[None, :]
        found.append((gain, out.T if turned else out))
    return max(found, key=lambda f: f[0])


def _slopes(y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-score))
    return p - y, np.maximum(p * (1 - p), 1e-9)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """The tables of a model of rows x with labels y."""
    n, d = x.shape
    start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    edges, coarse = ([edges_of(x[:, f], b) for f in range(d)] for b in (BINS, PAIR_BINS))
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = {"start": start, "edges": edges, "tables": tables, "coarse": coarse, "pairs": [], "grids": []}
    if n == 0 or y.min() == y.max():
        return model
    at = [binned(x[:, f], edges[f]) for f in range(d)]
    score = np.full(n, start)
    for _ in range(ROUNDS):
        for f in range(d):
            g, h = (np.bincount(at[f], v, len(tables[f])) for v in _slopes(y, score))
            step = RATE * shallow_tree(g, h)
            tables[f] += step
            score += step[at[f]]
    rough, sizes = [binned(x[:, f], coarse[f]) for f in range(d)], [len(c) + 1 for c in coarse]

    def grid(a: int, b: int) -> tuple[float, np.ndarray]:
        return pair_tree(*(np.bincount(rough[a] * sizes[b] + rough[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b]) for v in _slopes(y, score)))

    gains = sorted(((-grid(a, b)[0], a, b) for a, b in combinations(range(d), 2)))
    model["pairs"] = [(a, b) for gain, a, b in gains[:PAIRS] if gain < 0]
    model["grids"] = [np.zeros((sizes[a], sizes[b])) for a, b in model["pairs"]]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model["pairs"], model["grids"], strict=True):
            step = RATE * grid(a, b)[1]
            table += step
            score += step[rough[a], rough[b]]
    return model


def scores(model: dict, columns: list[np.ndarray]) -> np.ndarray:
    """The chance of label 1, by sums of table entries."""
    total = np.full(len(columns[0]), model["start"])
    for x, edges, table in zip(columns, model["edges"], model["tables"], strict=True):
        total += table[binned(x, edges)]
    for (a, b), grid in zip(model["pairs"], model["grids"], strict=True):
        total += grid[binned(columns[a], model["coarse"][a]), binned(columns[b], model["coarse"][b])]
    return 1 / (1 + np.exp(-total))


# --- on tables -----------------------------------------------------------------------------------


def labelled(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with `label` of the training rows that have one."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("top")).filter("label = top").drop("top")
    return features.filter(~held_out()).join(known, "doc_id")


def train(features: DataFrame, labels: DataFrame) -> dict:
    """The model of some labelled rows: all, or about SAMPLE of them."""
    rows = staged(labelled(features, labels), "quality-labelled")
    n, grain = rows.count(), 1 << 30
    share = min(grain, SAMPLE * grain // max(n, 1))
    # The hash takes all of a row, so that rows that repeat an id are drawn one by one if they differ.
    drawn = rows.filter(F.pmod(F.xxhash64("doc_id", *FEATURES), F.lit(grain)) < share)

    def fitted(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", *FEATURES])
        return pd.DataFrame({"model": [pickle.dumps(fit(part[list(FEATURES)].to_numpy(float), part["label"].to_numpy(float)))]})

    told = drawn.groupBy(F.lit(0).alias("all")).applyInPandas(fitted, "model binary").collect()
    if not told:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return pickle.loads(told[0][0])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    features = staged(measured(docs), "quality-features")
    model = train(features, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(model, [batch.column(f).to_numpy() for f in FEATURES]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])

    out = features.withColumns({"doc_id": F.col("doc_id").cast("long"), "held_out": held_out()}).mapInArrow(score, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
