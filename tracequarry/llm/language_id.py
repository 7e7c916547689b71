"""Language identification by nearest centroid.

A text is a unit vector of TF-IDF weights over hashed letter n-grams (one to
three letters, word ends counted as a letter). Each language has several
centroids, found by spherical k-means over a bounded sample of its labelled
documents; the document frequencies behind the weights are counted over every
labelled training document. A text takes the language of the centroid nearest
by cosine. One that is farther from its language's centroids than nearly all
of that language's training sample is flagged as rejected.

Texts are read whole, in slices of at most SLICE characters that hand on their last letters, so memory does not
grow with a text and n-grams across slices count as any other.

Defined results: a null text, or one without a letter, is `und`, rejected, with
score 0; rows that repeat each get a row and are one row of the sample; a null id is in training; ties go to the language first in
order; without any labelled document every text is `und`; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, give_back, staged, text_slices

#: Hashed n-grams.
DIMS = 1 << 12
SLICE = 1 << 20
#: The bound on the labelled documents of each language that centroids are fitted on. All languages are learned; a column with more values than a model of
#: bounded size can have, which is no column of languages, is an error.
SAMPLE, MOST_LANGUAGES = 400, 2048
CENTROIDS = 3
#: A text is rejected if its cosine is below this share of its language's lowest sample cosine.
REJECT_SHARE = 0.4
FOLDS, HELD_OUT = 4, 2


def _letter_table() -> np.ndarray:
    """For each code point of the basic plane: its own number if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(1 << 16)], np.uint32)


def _letters(text: str, letters: np.ndarray) -> np.ndarray:
    """The code points of a slice in lower case, 0 for what is no letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = letters[np.minimum(points, (1 << 16) - 1)]
    if points.max(initial=0) >= 1 << 16:
        high = points >= 1 << 16
        known[high] = [int(p) if chr(int(p)).isalpha() else 0 for p in points[high]]
    return known


def _grams(before: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that end in `known`; before: the two letters or word ends in front of it, fewer at a text's start."""
    pairs, triples = np.concatenate([before[-1:], known]), np.concatenate([before, known])
    one = known * np.uint32(0x9E3779B1)
    pairs, pairs_after = pairs[:-1] * np.uint32(0x9E3779B1), pairs[1:]
    two = (pairs ^ (pairs >> np.uint32(15))) * np.uint32(0x85EBCA77) + pairs_after
    first = triples[:-2] * np.uint32(0x9E3779B1)
    both = (first ^ (first >> np.uint32(15))) * np.uint32(0x85EBCA77) + triples[1:-1]
    three = (both ^ (both >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + triples[2:]
    out = np.concatenate([one[known > 0], two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
    return (out ^ (out >> np.uint32(16))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - 12)


def _counts(text: str | None, letters: np.ndarray) -> np.ndarray | None:
    """N-gram counts of a whole text, None without a letter."""
    if not text:
        return None
    low, total, before, any_letter = text.lower(), np.zeros(DIMS, np.int64), np.zeros(1, np.uint32), False
    for at in range(0, len(low), SLICE):
        known = _letters(low[at : at + SLICE], letters)
        if at + SLICE >= len(low):
            known = np.append(known, np.uint32(0))  # the text's end is a word end
        any_letter |= bool(known.any())
        known = known[(known > 0) | (np.concatenate([before[-1:], known[:-1]]) > 0)]  # runs of other characters are one word end
        total += np.bincount(_grams(before, known), minlength=DIMS)
        before = np.concatenate([before, known])[-2:]
    return total if any_letter else None


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = np.log1p(counts).astype(np.float32) * idf
    return weights / (np.sqrt((weights * weights).sum(axis=-1, keepdims=True)) + 1e-12)


def _k_means(vectors: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; centroids start at points far from those already chosen."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(vectors)))]
    while len(chosen) < min(k, len(vectors)):
        nearest = (vectors @ vectors[chosen].T).max(axis=1)
        chosen.append(int(nearest.argmin()))
    centres = vectors[chosen]
    for _ in range(rounds):
        of = (vectors @ centres.T).argmax(axis=1)
        centres = np.stack([vectors[of == i].sum(axis=0) if (of == i).any() else centres[i] for i in range(len(centres))])
        centres /= np.linalg.norm(centres, axis=1, keepdims=True) + 1e-12
    return centres.astype(np.float32)


def _document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each n-gram occurs, over all of them: DIMS sums from each task, added up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, df, n = _letter_table(), np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for _, texts in text_slices(batch):
                for text in texts:
                    found = _counts(text, letters)
                    if found is not None:
                        df += found > 0
                        n += 1
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS), pa.int32()), pa.array(np.concatenate([[n], df]), pa.int64())], names=["dim", "n"])

    out, n = np.zeros(DIMS, np.int64), 0
    for r in docs.select("text").mapInArrow(count, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        if r.dim < 0:
            n = r.n
        else:
            out[r.dim] = r.n
    return out, n


def train(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, seed: int = 7) -> dict:
    """The model from (doc_id, text, lang): idf, centroids, their languages and rejection distances.

    docs: labelled training documents only. The centroids of a language are fitted in one task, on `sample` documents of it at most;
    the driver sees centroids only.
    """
    docs = docs.filter("lang is not null").select("doc_id", "text", "lang")
    df, n = _document_frequency(docs)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
    # A language's rows with the least hashes: a top-k by partial aggregation, in one job for all. Rows that repeat have one hash.
    hashed = docs.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    cells = hashed.groupBy("lang", F.pmod("h", F.lit(1 << 16)).alias("cell")).agg(F.min("h").alias("h"))
    few = cells.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list("h")), 1, sample).alias("some"))
    chosen = staged(few.select("lang", F.explode("some").alias("h")), "language-samples")
    n_langs = chosen.select("lang").distinct().count()
    if n_langs > MOST_LANGUAGES:
        raise ValueError(f"{n_langs} values of lang are more than the {MOST_LANGUAGES} languages that a model can have")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = _letter_table()
        for batch in batches:
            found = [_counts(t, letters) for t in batch["text"]]
            have = [i for i, c in enumerate(found) if c is not None]
            at = [np.flatnonzero(found[i]) for i in have]
            yield pd.DataFrame({"lang": batch["lang"].iloc[have].tolist(), "h": batch["h"].iloc[have].tolist(), "dims": [a.tolist() for a in at], "counts": [found[i][a].tolist() for i, a in zip(have, at, strict=True)]})

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        counts = np.zeros((len(rows), DIMS), np.float32)
        for i, (dims, found) in enumerate(zip(rows["dims"], rows["counts"], strict=True)):
            counts[i, dims] = found
        unit = _unit(counts, idf)
        centres = _k_means(unit, centroids, seed)
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "centres": [centres.astype(np.float32).tobytes()], "least": [float(np.quantile((unit @ centres.T).max(axis=1), 0.01))]})

    # The sample is read from files, so Spark sends it to the texts if it is small and deals both out by hash if not.
    texts = hashed.select("lang", "h", "text").join(chosen, ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    counted = texts.mapInPandas(vectors, "lang string, h long, dims array<int>, counts array<int>")
    found = sorted(counted.groupBy("lang").applyInPandas(fitted, "lang string, centres binary, least double").collect(), key=lambda r: r.lang)
    parts = [np.frombuffer(r.centres, np.float32).reshape(-1, DIMS) for r in found]
    return {
        "idf": idf, "langs": [r.lang for r in found], "owner": np.repeat(np.arange(len(parts)), [len(p) for p in parts]).astype(np.int64),
        "centres": np.concatenate([*parts, np.empty((0, DIMS), np.float32)]), "least": np.array([r.least for r in found]),
    }


def _predicted(text: str | None, model: dict, letters: np.ndarray) -> tuple[str, float, bool]:
    """(language, score, rejected) of a whole text."""
    counts = _counts(text, letters) if model["langs"] else None
    if counts is None:
        return "und", 0.0, True
    near = model["centres"] @ _unit(counts, model["idf"])
    best = int(near.argmax())
    lang = model["owner"][best]
    return model["langs"][lang], float(min(1.0, max(0.0, near[best]))), bool(near[best] < REJECT_SHARE * model["least"][lang])


def classify(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, lang_pred, score and rejected for every row.

    The model goes to executors with the function: (1 + centroids * languages) * DIMS floats.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in (docs.schema[c] for c in keep))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letter_table()
        for batch in batches:
            for part, texts in text_slices(batch, "_text"):
                found = [_predicted(text, model, letters) for text in texts]
                columns = [part.column(c) for c in keep] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score", "rejected"])
        give_back()

    narrow = docs.select(*keep, F.col("text").alias("_text"))
    return narrow.mapInArrow(predict, f"{schema}, lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs whose text is not rejected, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letter_table()
        for batch in batches:
            for part, texts in text_slices(batch):
                yield part.filter(pa.array([not _predicted(t, model, letters)[2] for t in texts], pa.bool_()))
        give_back()

    return docs.mapInArrow(keep, docs.schema)


def in_training() -> F.col:
    """The fold rule of the query: what may be learned from. A null id is."""
    return F.coalesce(F.pmod(crc_of_id(), F.lit(FOLDS)) != HELD_OUT, F.lit(True))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document."""
    model = train(docs.filter(in_training()))
    return classify(docs.withColumn("held_out", ~in_training()), model, ("doc_id", "held_out"))
