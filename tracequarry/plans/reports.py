"""Queries that put tables side by side or report on them: merges, backfills, calibration, agreement, arms, listings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracequarry.functions.compat import percent, ratio, ref_round, text_to_int
from tracequarry.operators import stats, tasks
from tracequarry.plans.base import ROLLOUTS, TRIALS, query, rollouts, table, trials
from tracequarry.plans.levels import _DIFF
from tracequarry.plans.turns import _counted

_K = "try_cast(json_extract_string(props, '$.k') AS INTEGER)"


@query("""WITH a AS (SELECT user_id, count(*) AS n_calls, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1),
  b AS (SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event FROM events WHERE event_type = 'signup' GROUP BY 1),
  c AS (SELECT user_id, round(avg(value), 4) AS score FROM events WHERE event_type = 'purchase' GROUP BY 1)
  SELECT user_id, n_calls, n_errors, first_event, last_event, score FROM a JOIN b USING (user_id) LEFT JOIN c USING (user_id)""")
def merged_features(spark, d):
    """Three feature tables merged on their key: both structural ones are needed, the score may be missing."""
    e = table(spark, d, "events")
    calls = e.groupBy("user_id").agg(F.count("*").alias("n_calls"), F.count_if(F.col("event_type") == "error").alias("n_errors"))
    span = e.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
    score = e.filter("event_type = 'purchase'").groupBy("user_id").agg(ref_round(F.avg("value"), 4).alias("score"))
    return calls.join(span, "user_id").join(score, "user_id", "left")


@query("""WITH e AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
  SELECT user_id, bool_or(back <= 5 AND event_type = 'click') AS test_in_tail, arg_max(event_type, -back) = 'purchase' AS ends_with_submit, arg_max(value > 50, -back) FILTER (event_type = 'click') AS last_test_green FROM e GROUP BY 1""")
def tail_inspection(spark, d):
    """What the last turns say: a test among the last five, the last turn's kind, and whether the last test was green (null without a test)."""
    back = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    e = table(spark, d, "events").select("user_id", "event_type", "value", back.alias("back"))
    is_test = F.col("event_type") == "click"
    return e.groupBy("user_id").agg(
        F.bool_or((F.col("back") <= 5) & is_test).alias("test_in_tail"), (F.min_by("event_type", "back") == "purchase").alias("ends_with_submit"),
        F.min_by(F.col("value") > 50, F.when(is_test, F.col("back"))).alias("last_test_green"),
    )


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars}) AS line FROM documents")
def json_rows(spark, d):
    """Rows as JSON objects; fields that are null stay, as null."""
    return table(spark, d, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "n_chars"), {"ignoreNullFields": "false"}).alias("line"))


@query("SELECT quality, count(*) AS n FROM labels GROUP BY 1")
def inline_file(spark, d):
    """A query over a file that it names itself."""
    return spark.sql(f"SELECT quality, count(*) AS n FROM parquet.`{d}/labels.parquet` GROUP BY quality")


@query(f"SELECT user_id AS session, count(*) AS n_steps, coalesce(sum({_K}), 0)::BIGINT AS tokens FROM events GROUP BY 1")
def session_tokens(spark, d):
    k = text_to_int(F.get_json_object("props", "$.k"))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("session")).agg(F.count("*").alias("n_steps"), F.coalesce(F.sum(k), F.lit(0)).alias("tokens"))


_COMBOS = ("F/0", "F/1", "F/2", "O/0", "O/1", "O/2")
_WIDE = ", ".join(f"(sum(resolved) FILTER (combo = '{c}' AND resolved IN (0, 1)))::DOUBLE / nullif(count(*) FILTER (combo = '{c}' AND resolved IN (0, 1)), 0) AS rate_{c[0]}{c[2]}" for c in _COMBOS)


@query(f"""SELECT task, n_rollouts, n_labeled, n_resolved, n_resolved::DOUBLE / nullif(n_labeled, 0) AS solve_rate, {', '.join(f'round(rate_{c[0]}{c[2]}, 6) AS rate_{c[0]}{c[2]}' for c in _COMBOS)}, p_brand AS language, p_type AS category, p_size AS gold_lines, length(p_name) AS issue_chars
  FROM {_DIFF} JOIN (SELECT task, {_WIDE} FROM {ROLLOUTS} GROUP BY 1) USING (task) JOIN part ON p_partkey = task""")
def difficulty_table(spark, d):
    """Difficulty of each task with the rate of every harness in a column of its own, and the task's dimensions."""
    rows = rollouts(spark, d)
    wide = rows.filter(F.col("resolved").isin(0, 1)).groupBy("task").pivot("combo", list(_COMBOS)).agg(ref_round(F.avg("resolved"), 6)).toDF("task", *[f"rate_{c[0]}{c[2]}" for c in _COMBOS])
    dims = table(spark, d, "part").select(F.col("p_partkey").alias("task"), F.col("p_brand").alias("language"), F.col("p_type").alias("category"), F.col("p_size").alias("gold_lines"), F.length("p_name").cast("long").alias("issue_chars"))
    return tasks.difficulty(rows, "task").join(wide, "task", "left").join(dims, "task")


_CELLS = "(SELECT o_custkey % 7 AS repo, o_custkey % 100 AS unit, o_orderstatus AS solver, substr(o_orderpriority, 1, 1)::INT AS level, count(*) AS attempts, count(*) FILTER (o_totalprice > 60000) AS passes FROM orders GROUP BY 1, 2, 3, 4) cells"


def _cells(spark, d):
    cols = {"repo": F.col("o_custkey") % 7, "unit": F.col("o_custkey") % 100, "solver": F.col("o_orderstatus"), "level": F.substring("o_orderpriority", 1, 1).cast("int"), "passed": F.col("o_totalprice") > 60000}
    return tasks.roll_up(table(spark, d, "orders").select(*[c.alias(n) for n, c in cols.items()]), "repo", "unit", "solver", "level")


@query(f"SELECT repo, solver, level, sum(passes)::BIGINT AS passes, sum(attempts)::BIGINT AS attempts, round(sum(passes)::DOUBLE / sum(attempts), 2) AS rate FROM {_CELLS} GROUP BY 1, 2, 3")
def calibration_by_solver(spark, d):
    """Pass rates by repo, solver and level."""
    return _cells(spark, d).groupBy("repo", "solver", "level").agg(F.sum("passes").alias("passes"), F.sum("attempts").alias("attempts"), ref_round(F.sum("passes").cast("double") / F.sum("attempts"), 2).alias("rate"))


@query(f"SELECT solver, flip, count(*) AS n FROM (SELECT repo, unit, solver, min(level) FILTER (3 * passes >= 2 * attempts) AS flip FROM {_CELLS} GROUP BY 1, 2, 3) GROUP BY 1, 2")
def flips_by_solver(spark, d):
    """How many units flip at each level, by solver; null where none does."""
    return tasks.flip_point(_cells(spark, d), "repo", "unit", "solver").groupBy("solver", "flip").agg(F.count("*").alias("n"))


_RATED = "(SELECT least(6, n_chars // 400) AS a, least(6, (length(text) - length(replace(text, ' ', ''))) // 65) AS b FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL) rated"


@query(f"SELECT count(*) AS n, round(100.0::DOUBLE * sum((a = b)::INT) / count(*), 1) AS pct_exact, round(100.0::DOUBLE * sum((abs(a - b) <= 1)::INT) / count(*), 1) AS pct_within_one FROM {_RATED}")
def agreement_rates(spark, d):
    """Exact agreement of two ratings from 0 to 6, and agreement within one."""
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    rated = table(spark, d, "documents").dropna(subset=["text", "n_chars"]).select(F.least(F.lit(6), F.floor(F.col("n_chars") / 400)).alias("a"), F.least(F.lit(6), F.floor(spaces / 65)).alias("b"))
    off = F.abs(F.col("a") - F.col("b"))
    return rated.agg(F.count("*").alias("n"), percent(off == 0, 1).alias("pct_exact"), percent(off <= 1, 1).alias("pct_within_one"))


_HASH = "md5(concat_ws('-', doc_id, '42'))"
_WITHIN = f"row_number() OVER (PARTITION BY harness, language ORDER BY n_chars {{0}}, {_HASH}, doc_id)"


@query(f"""WITH c AS (SELECT harness, language, doc_id, n_chars FROM {TRIALS} WHERE resolved IN (0, 1)),
  o AS (SELECT 'random' AS arm, FALSE AS masked, 0::BIGINT AS place, {_HASH} AS h, doc_id, n_chars FROM c UNION ALL SELECT 'random_masked', TRUE, 0, {_HASH}, doc_id, n_chars FROM c
    UNION ALL SELECT 'top', FALSE, {_WITHIN.format('DESC')}, {_HASH}, doc_id, n_chars FROM c UNION ALL SELECT 'bottom', FALSE, {_WITHIN.format('ASC')}, {_HASH}, doc_id, n_chars FROM c)
  SELECT arm, masked, doc_id, running FROM (SELECT *, sum(n_chars) OVER (PARTITION BY arm ORDER BY place, h, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM o) WHERE running <= 60000""")
def budget_arms(spark, d):
    """Four arms of equal budget: at random, the same masked, and the longest or shortest of each task first, task by task."""
    c = trials(spark, d).filter(F.col("resolved").isin(0, 1)).select("harness", "language", "doc_id", "n_chars", stats.hash_order(F.col("doc_id")).alias("h"))
    within = Window.partitionBy("harness", "language")
    places = {"top": F.row_number().over(within.orderBy(F.desc("n_chars"), "h", "doc_id")), "bottom": F.row_number().over(within.orderBy("n_chars", "h", "doc_id"))}
    ranked = c.withColumns(places).select("doc_id", "n_chars", "h", F.explode(F.array(*[
        F.struct(F.lit(arm).alias("arm"), F.lit(masked).alias("masked"), place.cast("long").alias("place"))
        for arm, masked, place in (("random", False, F.lit(0)), ("random_masked", True, F.lit(0)), ("top", False, F.col("top")), ("bottom", False, F.col("bottom")))
    ])).alias("x")).select("x.*", "h", "doc_id", "n_chars")
    return stats.budgeted(ranked, "arm", "n_chars", ["place", "h", "doc_id"], 60_000).select("arm", "masked", "doc_id", "running")


@query(f"SELECT harness, language, count(*) AS n FROM {TRIALS} GROUP BY 1, 2 HAVING max(resolved) < 0")
def unlabeled_combos(spark, d):
    """The combos that a table of means leaves out, as none of their trials has a label."""
    return trials(spark, d).groupBy("harness", "language").agg(F.count("*").alias("n"), F.max("resolved").alias("top")).filter("top < 0").drop("top")


def _ranked(x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0"


@query(f"""WITH r AS (SELECT l_quantity, l_orderkey, l_linenumber, resolved - (sum(resolved) OVER w - resolved)::DOUBLE / nullif(count(*) OVER w - 1, 0) AS residual FROM {ROLLOUTS} WHERE resolved IN (0, 1) WINDOW w AS (PARTITION BY task)),
  f AS (SELECT residual, l_quantity, l_linenumber, l_orderkey % 97 AS batch FROM r WHERE residual IS NOT NULL),
  c AS (SELECT 'l_quantity' AS feature, (SELECT round(corr(a, b), 6) FROM (SELECT {_ranked('l_quantity')} AS a, {_ranked('residual')} AS b FROM f)) AS rho
    UNION ALL SELECT 'l_linenumber', (SELECT round(corr(a, b), 6) FROM (SELECT {_ranked('l_linenumber')} AS a, {_ranked('residual')} AS b FROM f))
    UNION ALL SELECT 'batch', (SELECT round(corr(a, b), 6) FROM (SELECT {_ranked('batch')} AS a, {_ranked('residual')} AS b FROM f)))
  SELECT feature, rho FROM c ORDER BY abs(rho) DESC, feature LIMIT 8""")
def residual_features(spark, d):
    """The features that go most with beating one's siblings: Spearman with the label less the leave-one-out rate, the first 8."""
    rows = rollouts(spark, d).filter(F.col("resolved").isin(0, 1)).withColumn("batch", F.col("l_orderkey") % 97)
    rows = tasks.leave_one_out(rows, "task", "resolved").withColumn("residual", F.col("resolved") - F.col("loo_rate")).filter("residual is not null")
    found = [stats.spearman(rows, f, "residual").select(F.lit(f).alias("feature"), "rho") for f in ("l_quantity", "l_linenumber", "batch")]
    return found[0].union(found[1]).union(found[2]).orderBy(F.desc(F.abs("rho")), "feature").limit(8)


@query("""WITH e AS (SELECT user_id, event_id, turn_idx, n_turns, cum_edits, cum_tests, cum_tool_errors, event_type, value FROM (SELECT *, sum((event_type = 'purchase')::INT) OVER w::BIGINT AS cum_edits, sum((event_type = 'click')::INT) OVER w::BIGINT AS cum_tests,
    sum((event_type = 'error')::INT) OVER w::BIGINT AS cum_tool_errors, count(*) OVER w AS turn_idx, count(*) OVER (PARTITION BY user_id) AS n_turns FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))),
  s AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(concat_ws('-', user_id, '42')), user_id LIMIT 20)
  SELECT user_id, event_id, turn_idx, round(turn_idx::DOUBLE / n_turns, 6) AS pct_through, event_type AS role, cum_edits, cum_tests, cum_tool_errors FROM e SEMI JOIN s USING (user_id)""")
def turn_sample(spark, d):
    """All turns of a seeded sample of trials, with their running counts."""
    picked = table(spark, d, "events").select("user_id").distinct().orderBy(stats.hash_order(F.col("user_id")), "user_id").limit(20)
    rows = _counted(spark, d).join(picked, "user_id", "left_semi")
    return rows.select("user_id", "event_id", "turn_idx", ref_round(F.col("pct_through"), 6).alias("pct_through"), F.col("event_type").alias("role"), "cum_edits", "cum_tests", "cum_tool_errors")


@query(f"SELECT harness, language, count(*) AS n, sum(CASE WHEN resolved = 1 THEN 1 ELSE 0 END)::BIGINT AS n_pass FROM {TRIALS} GROUP BY GROUPING SETS ((harness, language), (harness), ())")
def rollup_by_shard(spark, d):
    """Counts by source and language, by source, and in all."""
    return trials(spark, d).rollup("harness", "language").agg(F.count("*").alias("n"), F.count_if(F.col("resolved") == 1).alias("n_pass"))

