"""The additive model against a slow one, and the counts of texts against plain Python."""

import math
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD, documents

from tracequarry.llm import quality as q


def gain(g, h):
    return g * g / (h + q.PULL)


def slow_cut(g, h):
    """(gain, place) of the best cut of some bins, each tried in turn."""
    best = (0.0, 0)
    for at in range(1, len(g)):
        a, b, c, d = sum(g[:at]), sum(h[:at]), sum(g[at:]), sum(h[at:])
        if b >= q.LEAST and d >= q.LEAST and (now := gain(a, b) + gain(c, d) - gain(a + c, b + d)) > best[0] + 1e-12:
            best = (now, at)
    return best


def slow_tree(g, h, splits):
    leaves = [list(range(len(g)))]
    for _ in range(splits):
        tried = [(*slow_cut([g[i] for i in leaf], [h[i] for i in leaf]), leaf) for leaf in leaves]
        best = max(tried, key=lambda t: t[0])
        if best[0] <= 0:
            break
        leaves.remove(best[2])
        leaves += [best[2][: best[1]], best[2][best[1] :]]
    return {i: -sum(g[j] for j in leaf) / (sum(h[j] for j in leaf) + q.PULL) for leaf in leaves for i in leaf}


def slow_fit(x, y):
    """Tables as dictionaries by bin, row by row."""
    n, d = len(x), len(x[0])
    cuts = [[sorted({float(np.quantile([r[f] for r in x], i / b)) for i in range(1, b)}) for f in range(d)] for b in (q.BINS, q.PAIR_BINS)]
    at, rough = ([[sum(v >= c for c in cs[f]) for f, v in enumerate(r)] for r in x] for cs in cuts)
    score = [math.log((sum(y) + 0.5) / (n - sum(y) + 0.5))] * n
    tables = [[0.0] * (len(c) + 1) for c in cuts[0]]

    def slopes():
        p = [1 / (1 + math.exp(-s)) for s in score]
        return [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]

    for _ in range(q.ROUNDS):
        for f in range(d):
            g, h = slopes()
            by = [[sum(v[i] for i in range(n) if at[i][f] == b) for b in range(len(tables[f]))] for v in (g, h)]
            for b, v in slow_tree(*by, q.SPLITS).items():
                tables[f][b] += q.RATE * v
                for i in range(n):
                    if at[i][f] == b:
                        score[i] += q.RATE * v

    def grid(a, b):
        g, h = slopes()
        best = None
        for one, two in ((a, b), (b, a)):
            na, nb = len(cuts[1][one]) + 1, len(cuts[1][two]) + 1
            cell = [[[sum(v[i] for i in range(n) if rough[i][one] == r and rough[i][two] == c) for c in range(nb)] for r in range(na)] for v in (g, h)]
            total, where = slow_cut([sum(r) for r in cell[0]], [sum(r) for r in cell[1]])
            where, out = where if total > 0 else na // 2, {}
            for part in (range(where), range(where, na)):
                if len(part):
                    sums = [[sum(v[r][c] for r in part) for c in range(nb)] for v in cell]
                    total += slow_cut(*sums)[0]
                    out |= {((r, c) if one == a else (c, r)): v for c, v in slow_tree(*sums, 1).items() for r in part}
            if best is None or total > best[0] + 1e-12:
                best = (total, out)
        return best

    pairs = [p for _, *p in sorted((-grid(a, b)[0], a, b) for a, b in combinations(range(d), 2))[: q.PAIRS]]
    for _ in range(q.PAIR_ROUNDS):
        for a, b in pairs:
            step = grid(a, b)[1]
            for i in range(n):
                score[i] += q.RATE * step[rough[i][a], rough[i][b]]
    return [1 / (1 + math.exp(-s)) for s in score]


def test_fit_is_the_slow_one(monkeypatch):
    for name, value in (("BINS", 6), ("PAIR_BINS", 4), ("ROUNDS", 4), ("PAIR_ROUNDS", 3), ("PAIRS", 2)):
        monkeypatch.setattr(q, name, value)
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=60), rng.integers(0, 4, 60), rng.random(60), np.ones(60)])
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 1)).astype(float)
    y[:5] = 1 - y[:5]
    got = q.scores(q.fit(x, y), list(x.T))
    assert np.abs(got - slow_fit(x.tolist(), y.tolist())).max() < 1e-9


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = q.fit(x, y)
    assert model["pairs"][0] == (0, 2)
    assert np.mean((q.scores(model, list(x.T)) > 0.5) == y) > 0.9
    single = q.scores(model | {"pairs": [], "grids": []}, list(x.T))
    assert np.mean((single > 0.5) == y) < 0.75


@pytest.mark.parametrize(("y", "low", "high"), [([], 0.5, 0.5), ([1.0] * 50, 0.98, 1.0), ([0.0] * 50, 0.0, 0.02)])
def test_labels_of_one_kind(y, low, high):
    x = np.random.default_rng(3).random((len(y), 2))
    got = q.scores(q.fit(x, np.array(y)), [np.array([0.1, 5.0]), np.array([-1.0, 0.2])])
    assert ((low <= got) & (got <= high)).all()


def counts(text):
    """The features of a text whose letters are plain."""
    t = text or ""
    words, lines = t.split(), t.split("\n")
    n, nw, nl, letters = len(t), len(words), len(lines), sum(c.isalpha() for c in t)
    white, digits, marks = sum(c.isspace() for c in t), sum(c in "0123456789" for c in t), sum(c in ".,;:!?'\"()…«»-" for c in t)
    by_word, by_char = max(nw, 1), max(n, 1)
    return {
        "chars": math.log1p(n), "words": math.log1p(nw), "word_length": (n - white) / by_word, "letters": letters / by_char, "capitals": sum(c.isupper() for c in t) / max(letters, 1), "digits": digits / by_char,
        "white": white / by_char, "marks": marks / by_word, "symbols": (n - white - letters - digits - marks) / by_char, "loud": len(re.findall("[!?]{2,}", t)) / by_word, "distinct": len(set(words)) / by_word,
        "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / by_word, "bare": sum(not any(c.isalpha() for c in w) for w in words) / by_word,
        "shouted": sum(bool(re.match(r"[^a-zA-Zé]*[A-Z]{2}", w)) for w in words) / by_word, "tails": sum(not w[-1].isalnum() and w[-1] not in ".,;:!?'\"()…«»-" for w in words) / by_word,
        "lines": math.log1p(nl), "line_length": n / nl, "distinct_lines": len(set(lines)) / nl, "ended": sum(x[-1:] in tuple(".!?…\"»") and x != "" for x in lines) / nl,
    }


TEXTS = ["", None, " \t\n ", "One two two two. THREE!! 4 5 $$$ a### | x\n\nOne | é? ¡no\nOne | é? ¡no", "A", "THE THE THE", "a\nb\na.", "x" * 5000, "-- -- 12 aB ABc 9AB"]


def test_counts_of_texts(spark):
    got = q.measured(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = counts(TEXTS[r.doc_id])
        assert {f: round(r[f], 9) for f in q.FEATURES} == {f: round(v, 9) for f, v in want.items()}, TEXTS[r.doc_id]


@pytest.mark.parametrize("unit", ["X", "XY ", "aX", " ", "!", "the the ", "\n", "$", "1"])
def test_counting_takes_linear_time(spark, unit):
    df = spark.createDataFrame([(1, unit * (1_000_000 // len(unit)) + "x")], "doc_id long, text string")
    began = time.time()
    q.measured(df).collect()
    assert time.time() - began < 20


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_awkward_rows(spark):
    docs = documents(spark, AWKWARD).withColumns({c: F.lit("clash") for c in ("label", "score", "held_out", "n", "chars", "quality")})
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0), (4, 1, 0), (4, 0, 0), (5, 7, 0), (9, 1, 1)])
    for known in (labels, labels_of(spark, [])):
        got = q.scored(docs, known).collect()
        assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, *_ in AWKWARD)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {r.score for r in got} == {0.5}
    assert q.scored(documents(spark, []), labels).collect() == []
    learnt = q.labelled(q.measured(docs), labels).select("doc_id", "label").collect()
    assert {r.doc_id for r in learnt} == {i for i in range(12) if i not in (4, 5) and zlib.crc32(str(i).encode()) % 5} | ({5} if zlib.crc32(b"5") % 5 else set())


def test_the_sample_is_bounded_and_order_is_of_no_account(spark, small, monkeypatch):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    want = {r.doc_id: r.score for r in q.scored(docs, labels).collect()}
    again = {r.doc_id: r.score for r in q.scored(docs.orderBy(F.desc("text")).repartition(5), labels.repartition(3)).collect()}
    assert want == again
    monkeypatch.setattr(q, "SAMPLE", 20)
    assert all(0 <= r.score <= 1 for r in q.scored(docs, labels).collect())


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = q.scored(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
