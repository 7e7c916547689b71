import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracequarry.functions import compat
from tracequarry.operators import features, order, stats, tasks
from tracequarry.operators import trials as t
from tracequarry.plans.base import rollouts
from tracequarry.plans.registry import QUERIES
from tracequarry.sources import corpus, drift, views
from tracequarry.streaming import ingest


def column(spark, values, kind):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_round_and_casts(spark):
    assert [r[0] for r in column(spark, [1.005, 2.675, -0.5], "double").select(compat.ref_round(F.col("x"), 2)).collect()] == [1.0, 2.68, -0.5]
    assert [r[0] for r in column(spark, ["2.5", "-2.5", "3.7", "1e2", "x", None], "string").select(compat.text_to_int(F.col("x"))).collect()] == [3, -3, 4, 100, None, None]
    assert [r[0] for r in column(spark, [2.5, 3.5], "double").select(compat.number_to_int(F.col("x"))).collect()] == [2, 4]
    assert column(spark, [0], "int").select(compat.ratio(F.lit(1), F.col("x"))).first()[0] is None


CALL = [({"name": "bash", "arguments": a},) for a in ("sed -i s/a/b/", "pytest -q", "pytest -q")]
TRIAL = [
    ("i1", "r", "mit", "go", "t1", "hf", 1, [("user", "fix it", None, None, None), ("assistant", "I am done", "hmm", None, CALL)], ["tool"],
     ("bug", ("diff --git a/x b/x\n+++ b/x\n+a", "1", "2.5"), ("diff --git a/x b/x\ndiff --git a/y b/y", "x", "1e2"))),
    ("i1", "r", None, None, "t2", None, -1, None, None, None),
    ("i2", "r", None, "py", "t3", None, 0, [], [], ("c", (None, None, None), ("", None, None))),
]


@pytest.fixture()
def corpus_dir(spark, tmp_path):
    df = spark.createDataFrame(TRIAL, corpus.TRIAL)
    df.coalesce(1).write.parquet(str(tmp_path / "data" / "my harness" / "teacher" / "src"))
    return tmp_path / "data"


def test_scan_shards(spark, corpus_dir):
    df = corpus.read_trials(spark, str(corpus_dir))
    rows = corpus.checked_shards(df, str(corpus_dir)).select("harness", "teacher_model", "source_dataset").distinct().collect()
    assert [tuple(r) for r in rows] == [("my harness", "teacher", "src")]
    with pytest.raises(Exception, match="not a shard"):
        corpus.checked_shards(df, str(corpus_dir / "my harness")).collect()
    typed = {r.trajectory_id: r for r in t.typed(df).collect()}
    assert typed["t1"].reference_patch_lines == 3 and typed["t1"].model_patch_files is None and typed["t1"].model_patch_lines == 100
    assert typed["t2"].n_messages is None and typed["t3"].n_messages == 0


def test_scan_reads_named_fields_only(spark, corpus_dir):
    plan = t.turns(corpus.read_trials(spark, str(corpus_dir)), "trajectory_id", ("role",))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "role" in schema and "content" not in schema
    assert t.turns(corpus.read_trials(spark, str(corpus_dir)), "trajectory_id", ("role", "content")).count() == 2


def test_proxy_features(spark, corpus_dir):
    rows = {r.trajectory_id: r for r in features.proxy_features(corpus.read_trials(spark, str(corpus_dir))).collect()}
    a = rows["t1"]
    assert (a.n_messages, a.n_assistant_turns, a.n_tool_calls, a.n_distinct_tool_commands) == (2, 1, 3, 2)
    assert a.max_consecutive_identical_calls == 2 and a.n_edit_calls == 1 and a.n_test_calls == 2 and a.ends_with_submit
    assert a.patch_file_jaccard == 0.5 and a.assistant_chars == 9 and a.reasoning_chars == 3
    for r in rows.values():
        assert r.n_edit_calls <= r.n_tool_calls and 0 <= r.repeat_call_rate <= 1 and r.resolved in (-1, 0, 1)
        assert all(r[c] is not None and r[c] >= 0 for c in ("n_messages", "n_tool_calls", "assistant_chars", "n_test_calls"))


def test_features_know_their_shard(spark, corpus_dir):
    rows = features.proxy_features(corpus.read_trials(spark, str(corpus_dir))).collect()
    counts = ["n_messages", "n_assistant_turns", "n_tool_calls", "n_distinct_tool_commands", "max_consecutive_identical_calls", "n_edit_calls", "n_test_calls"]
    assert {(r.harness, r.teacher, r.source) for r in rows} == {("my harness", "teacher", "src")} and {r.category for r in rows} == {"bug", "c", None}
    assert all(r[c] is not None and r[c] >= 0 for r in rows for c in counts) and {r.resolved for r in rows} <= {-1, 0, 1}


def test_turn_sample(spark, corpus_dir):
    trials = corpus.read_trials(spark, str(corpus_dir))
    rows = features.turn_sample(trials.drop("resolved").withColumn("resolved", F.lit(0)), 10).orderBy("trajectory_id", "turn_idx").collect()
    assert [(r.trajectory_id, r.turn_idx, r.role, r.content_len, r.has_tool_call, r.is_edit_command, r.is_test_command, r.pct_through, r.cum_edits, r.cum_tests, r.cum_tool_calls, r.outcome_label) for r in rows] == [
        ("t1", 1, "user", 6, False, False, False, 0.5, 0, 0, 0, "failed"), ("t1", 2, "assistant", 9, True, True, True, 1.0, 1, 1, 3, "failed"),
    ]
    assert features.turn_sample(trials, 0).count() == 0


def test_tool_errors_add_up(spark):
    said = [("user", "error: not a tool"), ("tool", "x\nTraceback (most recent call last):\n"), ("tool", "all fine, no errors"), ("tool", "bash: foo: command not found"), ("tool", None), ("assistant", "Error: mine"), ("tool", "ValueError: x"), ("tool", "exited with code 0"), ("tool", "exit status 2")]
    row = ("i", "r", "mit", "go", "t", "hf", 1, [(role, text, None, None, None) for role, text in said], [], None)
    rows = features.turn_sample(spark.createDataFrame([row], corpus.TRIAL), 1).orderBy("turn_idx").collect()
    assert [r.cum_tool_errors for r in rows] == [0, 1, 1, 2, 2, 2, 2, 2, 3] and {r.outcome_label for r in rows} == {"success"}


def test_training_sample(spark, tmp_path):
    calls = [("bash", '{"cmd": "ls", "n": [1, {"a": null}]}'), ("bash", "not json"), ("bash", None), ("bash", "[1]")]
    row = ("i", "r", "mit", "go", "t{}", "hf", 1, [("user", "fix", None, None, None), ("assistant", "ok", None, None, [({"name": n, "arguments": a},) for n, a in calls])], ["tool"], None)
    trials = spark.createDataFrame([tuple(x.format(i) if x == "t{}" else x for x in row) for i in range(20)], corpus.TRIAL)
    corpus.build_sample(trials, 5, 0, str(tmp_path / "sample"))
    rows = [json.loads(line) for f in (tmp_path / "sample").glob("part-*") for line in f.read_text().splitlines()]
    assert len({r["trajectory_id"] for r in rows}) == len(rows) == 5
    told = [c["function"].get("arguments") for r in rows for m in r["messages"] for c in m.get("tool_calls", [])]
    assert told == [{"cmd": "ls", "n": [1, {"a": None}]}, {"text": "not json"}, {}, {"text": "[1]"}] * 5
    corpus.build_sample(trials, 5, 0, str(tmp_path / "again"))
    assert {r.trajectory_id for r in spark.read.json(str(tmp_path / "again")).collect()} == {r["trajectory_id"] for r in rows}


def test_parts_resume_and_merge(spark, tmp_path):
    rows = [(f"s{s}", f"t{i}", i) for s in range(4) for i in range(5)]
    trials, out = spark.createDataFrame(rows, "_source_file string, trajectory_id string, v int"), str(tmp_path / "parts")
    change = lambda df: df.withColumn("v", F.col("v") * 10)
    assert [r[0] for r in corpus.run_parts(trials, out, change, limit=1, head=2).collect()] == ["s0"]
    assert spark.read.parquet(out).count() == 2
    with pytest.raises(Exception, match="lost"):  # a run that fails leaves nothing
        corpus.run_parts(trials, out, lambda df: df.filter(F.raise_error(F.lit("lost")).isNull()))
    assert sorted(r[0] for r in corpus.run_parts(trials, out, change).collect()) == ["s1", "s2", "s3"]
    assert corpus.run_parts(trials, out, change).count() == 0
    assert spark.read.parquet(out).count() == 17
    corpus.merge_parts(spark, out, str(tmp_path / "more"), file_bytes=600)
    assert 1 < len(list((tmp_path / "more").glob("part-*"))) and spark.read.parquet(str(tmp_path / "more")).count() == 17
    corpus.merge_parts(spark, out, str(tmp_path / "merged"))
    assert spark.read.parquet(str(tmp_path / "merged")).count() == 17 and len(list((tmp_path / "merged").glob("part-*"))) == 1


def test_listing_and_drift(spark, corpus_dir, tmp_path):
    listed = corpus.list_shards(spark, str(corpus_dir)).collect()
    assert len(listed) == 1 and listed[0]["length"] > 0 and "/my harness/teacher/src/part-" in listed[0]._source_file
    spark.createDataFrame([(1, "a")], "k int, old string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2**40, 1.5)], "k long, new double").write.parquet(str(tmp_path / "b"))
    drifting = drift.read_drifting(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert sorted(map(tuple, drifting.select("k", "old", "new").collect())) == [(1, "a", None), (2**40, None, 1.5)]


def test_union_widens(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, a string"), spark.createDataFrame([(1 << 40,)], "n bigint")
    out = corpus.union_by_name([a, b])
    assert dict(out.dtypes)["n"] == "bigint" and out.count() == 2


def test_results_and_parts(spark, tmp_path):
    (tmp_path / "u-A1__7").mkdir()
    (tmp_path / "u-A1__7" / "result.json").write_text('{"verifier_result": {"rewards": {"reward": 1.0}},\n "started_at": "2024-01-01T00:00:00Z"}')
    row = corpus.read_results(spark, str(tmp_path)).withColumns(tasks.parse_trial(F.col("trial"))).first()
    assert (row.trial, row.reward, row.unit, row.level) == ("u-A1__7", 1.0, "u", 3)
    out = str(tmp_path / "parts")
    for v in (1, 2):
        corpus.write_parts(spark.createDataFrame([("h", v)], "h string, v int"), out, ["h"])
    assert [r.v for r in spark.read.parquet(out).collect()] == [2]
    corpus.write_json_lines(spark.createDataFrame([("h", 1)], "h string, v int"), str(tmp_path / "j"))
    assert corpus.read_json_lines(spark, str(tmp_path / "j"), "h string, v int").first().v == 1


def test_buckets_and_levels(spark):
    df = spark.createDataFrame([(0, 3, 0), (1, 3, 3), (2, 3, 1), (3, 3, 2), (4, 2, 2), (5, 6, 3)], "task int, n int, k int").withColumn("s", F.col("k") / F.col("n"))
    got = [r[0] for r in df.orderBy("task").select(tasks.difficulty_bucket(F.col("n"), F.col("s"))).collect()]
    assert got == ["all_fail", "all_pass", "hard", "easy", "unknown", "mid"]
    levels = spark.createDataFrame([("u", 1, 3, 1, 0.25), ("u", 2, 3, 2, 0.75), ("v", 1, 3, 0, 0.0)], "unit string, level int, attempts int, passes int, rate double")
    assert {r.unit: r.flip for r in tasks.flip_point(levels, "unit").collect()} == {"u": 2, "v": None}
    assert {r.unit: r.best_level for r in tasks.nearest_half(levels, "unit").collect()} == {"u": 1, "v": 1}


def test_package_status(spark):
    lines = ['{"Action":"run","Package":"a"}', '{"Action":"fail","Package":"a","Test":"T"}', '{"Action":"pass","Package":"a"}', "noise", '{"Action":"fail","Package":"b"}']
    df = spark.createDataFrame(list(enumerate(lines)), "seq int, line string")
    assert {r.package: r.status for r in tasks.package_status(df).collect()} == {"a": "ok", "b": "fail"}


def response_slopes(rows, b, log_a, theta):
    """The gradient of the joint log posterior at what was fitted, by task and combo."""
    g_b, g_a, g_t = ({i: -b[i] for i in b}, {i: -4 * log_a[i] for i in b}, {c: -t for c, t in theta.items()})
    for i, c, n, k in rows:
        if i in b:
            a = np.exp(log_a[i])
            rest = k - n / (1 + np.exp(-a * (theta[c] - b[i])))
            g_b[i] -= a * rest
            g_a[i] += rest * a * (theta[c] - b[i])
            g_t[c] += a * rest
    return g_b, g_a, g_t


@pytest.mark.parametrize("two", [False, True])
def test_response_model_is_fitted_to_the_end(spark, two):
    rng = np.random.default_rng(1)
    b, a, theta = rng.normal(size=40), np.exp(rng.normal(0, 0.4, 40)) if two else np.ones(40), rng.normal(size=7)
    rows = [(i, f"c{j}", 30, int(rng.binomial(30, 1 / (1 + np.exp(-a[i] * (theta[j] - b[i])))))) for i in range(40) for j in range(7)]
    rows += [(100, "c0", 2, 1)]  # too few trials
    found, abilities = stats.fit_response(spark.createDataFrame(rows, "task int, combo string, n long, k long"), "task", "combo", two_parameters=two)
    got = {r.task: r for r in found.collect()}
    assert set(got) == set(range(40))
    order = np.argsort(np.argsort([got[i].b for i in range(40)])), np.argsort(np.argsort(b))
    assert np.corrcoef(*order)[0, 1] > 0.9
    slopes = response_slopes(rows, {i: r.b for i, r in got.items()}, {i: r.log_a for i, r in got.items()}, dict(abilities.collect()))
    assert max(map(abs, slopes[0].values())) < 1e-6 and max(map(abs, slopes[2].values())) < 0.05
    assert not two or max(map(abs, slopes[1].values())) < 1e-3


def test_logistic_is_the_slow_fit(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2)) * [3, 0.2] + [5, 1]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 5) / 3 + 4 * (x[:, 1] - 1)))).astype(int)
    df = spark.createDataFrame([(int(t), float(u), float(v)) for t, (u, v) in zip(y, x, strict=True)], "y int, u double, v double")
    z = np.column_stack([(x - x.mean(axis=0)) / x.std(axis=0, ddof=1), np.ones(400)])
    w = np.zeros(3)
    for _ in range(50):  # Newton steps with the same penalty, none on the intercept
        p = 1 / (1 + np.exp(-z @ w))
        pull = 1e-4 * np.array([1, 1, 0])
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / 400 + np.diag(pull), z.T @ (p - y) / 400 + pull * w)
    got = dict(stats.logistic(df, "y", ["u", "v"]).collect())
    assert abs(got["u"] - w[0]) < 2e-3 and abs(got["v"] - w[1]) < 2e-3


def test_mixture_is_the_slow_fit(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(n := rng.integers(1, 9)), int(rng.binomial(n, 0.15 if i % 3 else 0.7))) for i in range(120)]
    w, p = [0.5, 0.5], [0.2, 0.8]
    for _ in range(1500):  # task by task
        parts = []
        for _, n, k in rows:
            like = [w[c] * p[c] ** k * (1 - p[c]) ** (n - k) for c in (0, 1)]
            parts.append([x / sum(like) for x in like])
        w = [sum(r[c] for r in parts) / len(rows) for c in (0, 1)]
        p = [sum(r[c] * k for r, (_, n, k) in zip(parts, rows, strict=True)) / sum(r[c] * n for r, (_, n, k) in zip(parts, rows, strict=True)) for c in (0, 1)]
    got = stats.mixture_of(spark.createDataFrame(rows, "task int, n_labeled int, n_resolved int")).collect()
    assert all(abs(r.weight - w[r.component]) < 1e-5 and abs(r.rate - p[r.component]) < 1e-5 for r in got)


@pytest.mark.parametrize("n", [0, 1, 5, 37])
def test_places_by_ranges(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, int(rng.integers(0, 6)), int(rng.integers(1, 9))) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, v int, w int")
    got = {r.id: (r.before, r.all) for r in order.sums_before(df, [F.desc("v"), F.col("id")], F.col("w"), "before", "all").collect()}
    held, want = 0, {}
    for i, _, w in sorted(rows, key=lambda r: (-r[1], r[0])):
        want[i] = (held, sum(r[2] for r in rows))
        held += w
    assert got == want
    for parts in (1, 3, 10):
        ours = {r.id: r.bin for r in tasks.bins(df, parts, F.col("v"), "id").collect()}
        theirs = {r.id: r.b for r in df.withColumn("b", F.ntile(parts).over(Window.orderBy("v", "id"))).collect()}
        assert ours == theirs
    shares = [("a", 1), ("b", 0), ("c", 2)]
    by_place = {i: "a" if 3 * (at + 1) <= n else "c" for at, (i, *_) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r.id: r.bucket for r in stats.quantile_matched(df, [F.col("v"), F.col("id")], shares).collect()} == by_place


def test_fitted_difficulties_take_the_shares_of_pass_rates(spark, small):
    rows = QUERIES["irt_bucket"](spark, small).collect()
    fitted, _ = stats.fit_response(stats.counts_of(rollouts(spark, small), "task", "combo"), "task", "combo", two_parameters=True)
    names = ["all_fail", "hard", "mid", "easy", "all_pass"]
    sizes = [sum(tasks_bucket(r) == n for r in rows) for n in names]
    by_difficulty = sorted(((-r.b, r.task) for r in fitted.collect()))
    ends = np.cumsum(sizes)
    want = {task: names[int(np.searchsorted(ends * len(by_difficulty), (at + 1) * sum(sizes)))] for at, (_, task) in enumerate(by_difficulty)}
    assert len(rows) == len(want) > 50 and {r.task: r.irt_bucket for r in rows} == want


def tasks_bucket(r):
    rate = r.n_resolved / r.n_labeled
    return "all_fail" if rate == 0 else "all_pass" if rate == 1 else "hard" if rate < 0.34 else "mid" if rate <= 0.66 else "easy"


def test_top_coefficients(spark):
    found = spark.createDataFrame([(f, c) for f, c in zip("abcdefg", (0.1, -3.0, 2.0, -2.0, 0.0, 9.0, -0.2), strict=True)], "feature string, coef double")
    assert [(r.place, r.feature) for r in stats.strongest(found).orderBy("place").collect()] == [(1, "f"), (2, "b"), (3, "c"), (4, "d"), (5, "g")]


def test_a_second_database(spark, corpus_dir):
    views.register_views(spark, str(corpus_dir))
    for _ in range(2):
        assert views.build_database(spark, "analysis", views.analysis_frames(spark)) == ["analysis.task_difficulty", "analysis.trials"]
    got = spark.sql("SELECT d.bucket, count(*) AS n FROM analysis.task_difficulty d JOIN trial_summary t USING (instance_id) GROUP BY 1").collect()
    assert {(r.bucket, r.n) for r in got} == {("unknown", 3)} and not [x for x in spark.catalog.listTables("default") if x.name == "task_difficulty" and not x.isTemporary]


def test_mixture():
    found = stats.binomial_mixture([(10, 1, 50), (10, 2, 30), (10, 8, 20), (10, 9, 25)])
    assert abs(sum(w for w, _ in found) - 1) < 1e-9 and found[0][1] < 0.3 < 0.7 < found[1][1]
    assert stats.binomial_mixture([]) == [(0.5, 0.2), (0.5, 0.8)]


def test_stream_ingest(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    spark.createDataFrame([("a", 1)], "k string, v int").write.parquet(src)
    for expected in (1, 1, 2):
        if expected == 2:
            spark.createDataFrame([("b", 2)], "k string, v int").write.mode("append").parquet(src)
        ingest.ingest(ingest.new_shards(spark, src, spark.read.parquet(src).schema), out, ckpt, ["k"]).awaitTermination(60)
        assert spark.read.parquet(out).count() == expected


def test_streaming_health_and_attempts(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    src = str(tmp_path / "events")
    events.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src).withColumn("over", F.col("event_type") == "error")
    q = ingest.rolling_health(stream, "ts", "over", late="1 hour").writeStream.outputMode("append").format("memory").queryName("health").trigger(availableNow=True).start()
    q.awaitTermination(60)
    streamed = {(r.start, r.n, r.n_over) for r in spark.table("health").collect()}
    batch = {(r.start, r.n, r.n_over) for r in ingest.rolling_health(events.withColumn("over", F.col("event_type") == "error"), "ts", "over").collect()}
    assert streamed and streamed <= batch
    once = ingest.first_attempts(spark.readStream.schema(events.schema).parquet(src), "ts", ["user_id", "event_type"], "60 days")
    q = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == events.select("user_id", "event_type").distinct().count()
    assert ingest.new_signatures(spark.createDataFrame([("x",), ("y",)], "signature string"), spark.createDataFrame([("x",)], "signature string")).count() == 1


def test_views_and_summaries(spark, corpus_dir, tmp_path):
    views.register_views(spark, str(corpus_dir))
    assert {r.outcome_label for r in spark.table("trial_summary").collect()} == {"success", "failed", "unknown"}
    turn = spark.table("trace_turns").orderBy("turn_idx").collect()
    assert [(r.turn_idx, r.has_tool_call, r.has_tool_call_nonempty) for r in turn] == [(1, False, False), (2, True, True)]
    assert spark.table("catalog_resolved_rates").first().n == 3
    for expected in (1, 0):
        seen = views.refresh_summaries(spark, str(corpus_dir), str(tmp_path / "store"))
        assert set(seen) == set(views.SUMMARIES) and all(len(files) == expected for files in seen.values())
        row = spark.table("trace_empty_patch_rate").first()
        assert (row.harness, row.teacher_model, row.n, row.pct_empty_model_patch, row.n_tasks) == ("my harness", "teacher", 3, 66.67, 2)
        by_language = {(r.language, r.resolved): (r.n, r.avg_messages, r.avg_model_lines, r.avg_gold_lines) for r in spark.table("trace_summary_by_language").collect()}
        assert by_language == {("go", 1): (1, 2.0, 100.0, 3.0), (None, -1): (1, None, None, None), ("py", 0): (1, 0.0, None, None)}
        assert {(r.category, r.resolved, r.n) for r in spark.table("trace_summary_by_category").collect()} == {("bug", 1, 1), (None, -1, 1), ("c", 0, 1)}
