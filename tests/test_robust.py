"""Clustered models against slow numpy versions, and trial folders."""

import json
import math

import numpy as np
import pytest

from tracequarry.operators import robust
from tracequarry.sources import trial_logs


def slow_robust(x, y, g):
    """Newton steps and the sandwich, row by row."""
    z, k = np.column_stack([np.ones(len(x)), x]), x.shape[1] + 1
    b = np.zeros(k)
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z.T * (p * (1 - p))) @ z, z.T @ (y - p))
    p = 1 / (1 + np.exp(-z @ b))
    middle = np.zeros((k, k))
    for c in set(g):
        s = sum((z[i] * (y[i] - p[i]) for i in range(len(y)) if g[i] == c), np.zeros(k))
        middle += np.outer(s, s)
    bread, clusters = np.linalg.inv((z.T * (p * (1 - p))) @ z), len(set(g))
    return b, np.sqrt(np.diag(bread @ middle @ bread) * clusters / (clusters - 1) * (len(y) - 1) / (len(y) - k))


def test_cluster_logistic_is_the_slow_one(spark):
    rng = np.random.default_rng(1)
    g = rng.integers(0, 25, 600)
    x = np.column_stack([rng.normal(size=600) * 3 + 100, rng.integers(1, 6, 600)])
    y = (rng.random(600) < 1 / (1 + np.exp(-(0.3 * (x[:, 0] - 100) - 0.4 * x[:, 1] + rng.normal(size=25)[g])))).astype(float)
    rows = [(int(a), float(b), int(c), f"u{u}") for a, (b, c), u in zip(y, x, g, strict=True)] + [(None, 1.0, 1, "u1"), (1, None, 1, "u1"), (0, 1.0, 2, None)]
    got = {r.feature: r for r in robust.cluster_logistic(spark.createDataFrame(rows, "y int, a double, b int, unit string"), "y", ["a", "b"], "unit").collect()}
    coef, se = slow_robust(x, y, g)
    for i, f in enumerate(("(intercept)", "a", "b")):
        assert got[f].coef == pytest.approx(coef[i], rel=1e-7) and got[f].se == pytest.approx(se[i], rel=1e-6)
        assert got[f].z == pytest.approx(coef[i] / se[i], rel=1e-6) and got[f].p_value == pytest.approx(math.erfc(abs(coef[i] / se[i]) / math.sqrt(2)), rel=1e-5)
    assert {(r.n, r.n_clusters) for r in got.values()} == {(600, 25)}


def test_fits_that_have_no_end(spark):
    apart = spark.createDataFrame([(int(i > 9), float(i), i % 4) for i in range(20)], "y int, x double, g int")
    with pytest.raises(ValueError, match="no end"):
        robust.cluster_logistic(apart, "y", ["x"], "g")
    with pytest.raises(ValueError, match="no end"):
        robust.cluster_logistic(apart.selectExpr("int(x % 3 = 0) AS y", "x", "2 * x + 1 AS z", "g"), "y", ["x", "z"], "g")
    with pytest.raises(ValueError, match="one value"):
        robust.cluster_logistic(apart.selectExpr("y", "5 AS x", "g"), "y", ["x"], "g")
    with pytest.raises(ValueError, match="both kinds"):
        robust.cluster_logistic(apart.filter("y = 1"), "y", ["x"], "g")


def cells(rng, p, n, units, spread=0.0):
    for u in range(units):
        mine = min(0.99, p * math.exp(spread * rng.normal())) if spread else p
        for d in range(1, 7):
            yield u, d, n, int(rng.binomial(n, mine**d))


def test_the_geometric_law(spark):
    rng = np.random.default_rng(2)
    frame = lambda rows: spark.createDataFrame(list(rows), "u int, d int, n int, k int")
    law = robust.geometric_test(frame(cells(rng, 0.8, 400, 30)), "d", "n", "k").first()
    assert abs(law.p - 0.8) < 0.01 and law.degrees == 5 and law.z < 2.5
    other = robust.geometric_test(frame((0, d, 5000, int(5000 * (0.9 - 0.1 * d))) for d in range(1, 7)), "d", "n", "k").first()
    assert other.z > 5
    even, uneven = (robust.unit_dispersion(frame(cells(rng, 0.8, 200, 30, s)), "u", "d", "n", "k").first() for s in (0.0, 0.3))
    assert (even.n_units, even.degrees) == (30, 150) and even.ratio < 1.4 and even.z < 3
    assert abs(uneven.ratio - 1) < 1  # each unit follows its own law, which a spread between units does not break
    within = robust.unit_dispersion(frame((u, d, 200, int(rng.binomial(200, min(0.99, 0.8**d * math.exp(0.5 * rng.normal()))))) for u in range(30) for d in range(1, 7)), "u", "d", "n", "k").first()
    assert within.ratio > 3 and within.z > 5
    nothing = robust.unit_dispersion(frame([(1, 1, 10, 5)]), "u", "d", "n", "k").first()
    assert (nothing.n_units, nothing.degrees, nothing.z) == (0, 0, None)


def trial_folder(root, name, logs, result=None):
    (root / name / "agent").mkdir(parents=True)
    for file, text in logs.items():
        (root / name / "agent" / file).write_text(text)
    if result is not None:
        (root / name / "result.json").write_text(result if isinstance(result, str) else json.dumps(result))


def test_trials_are_judged_by_their_logs(spark, tmp_path):
    done = {"verifier_result": {"rewards": {"reward": 1.0}}, "started_at": "2024-01-01T00:00:00Z", "finished_at": "2024-01-01T00:02:20Z"}
    job = tmp_path / "jobs" / "job a"
    calls = [json.dumps({"type": "tool_call", "tool_call": {"webFetchToolCall": {"url": "x"}}}), '{"webSearchToolCall": 1} trailing', "", "[1, 2]", json.dumps({"type": "shellToolCall"})]
    trial_folder(job, "unit-L1__a", {"log.jsonl": "\n".join(calls), "more.txt": json.dumps({"webFetchToolCall": "webFetchToolCall", "x": "prewebFetchToolCall"})}, done)
    trial_folder(job, "unit-L2__b", {"log.jsonl": json.dumps({"type": "shellToolCall"}) + "\n", "empty.log": ""}, done)
    trial_folder(job, "unit-L3__c", {"log.jsonl": "not json at all"})
    trial_folder(job, "unit-L4__d", {"empty.log": ""}, '{"verifier_result": {"rew')
    trial_folder(job, "unit-L5__e", {"log.jsonl": "{}"}, done | {"verifier_result": {"rewards": {"reward": 0.0}}, "finished_at": None})
    (job / "unit-L6__f").mkdir()
    (job / "unit-L6__f" / "result.json").write_text(json.dumps(done))  # no logs: not audited
    root = str(tmp_path / "jobs")
    got = {r.trial: (r.job, r.task, r.verdict, r.reward, r.minutes, r.n_fetch, r.n_search, r.n_lines, r.n_malformed) for r in trial_logs.web_audit(spark, root).collect()}
    assert got == {
        "unit-L1__a": ("job a", "unit-L1", "CONTAMINATED", 1.0, 2.3, 4, 1, 5, 2), "unit-L2__b": ("job a", "unit-L2", "PASS", 1.0, 2.3, 0, 0, 1, 0), "unit-L3__c": ("job a", "unit-L3", "PENDING", None, None, 0, 0, 1, 1),
        "unit-L4__d": ("job a", "unit-L4", "PENDING", None, None, 0, 0, 0, 0), "unit-L5__e": ("job a", "unit-L5", "FAIL", 0.0, None, 0, 0, 1, 0),
    }
    lines = trial_logs.log_lines(spark, root)
    assert sorted(r.line for r in trial_logs.placed(lines.filter("not is_json")).collect()) == ["[1, 2]", "not json at all", '{"webSearchToolCall": 1} trailing']
    assert {(r.trial, r.kind, r.n) for r in trial_logs.call_counts(lines).collect()} == {
        ("unit-L1__a", "webFetch", 3), ("unit-L1__a", "prewebFetch", 1), ("unit-L1__a", "webSearch", 1), ("unit-L1__a", "shell", 1), ("unit-L2__b", "shell", 1),
    }
