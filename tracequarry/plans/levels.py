"""Queries over tasks and results: difficulty, bins, pairs, levels, calibration."""

from pyspark.sql import functions as F

from tracequarry.functions.compat import ratio, ref_round
from tracequarry.operators import stats, tasks
from tracequarry.plans.base import ROLLOUTS, query, rollouts, table

_DIFF = f"(SELECT task, count(*) AS n_rollouts, count(*) FILTER (resolved IN (0, 1)) AS n_labeled, count(*) FILTER (resolved = 1) AS n_resolved FROM {ROLLOUTS} GROUP BY 1) diff"
_BUCKET = """CASE WHEN n_labeled < 3 THEN 'unknown' WHEN n_resolved = 0 THEN 'all_fail' WHEN n_resolved = n_labeled THEN 'all_pass'
  WHEN n_resolved::DOUBLE / n_labeled < 0.34 THEN 'hard' WHEN n_resolved::DOUBLE / n_labeled <= 0.66 THEN 'mid' ELSE 'easy' END"""


@query(f"SELECT *, n_resolved::DOUBLE / nullif(n_labeled, 0) AS solve_rate FROM {_DIFF}")
def difficulty_rollup(spark, d):
    return tasks.difficulty(rollouts(spark, d), "task")


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n, sum(n_rollouts)::BIGINT AS n_rollouts FROM {_DIFF} GROUP BY 1")
def difficulty_bucket(spark, d):
    rows = tasks.difficulty(rollouts(spark, d), "task").withColumn("bucket", tasks.difficulty_bucket(F.col("n_labeled"), F.col("solve_rate")))
    return rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_rollouts").alias("n_rollouts"))


@query(f"""WITH i AS (SELECT p_partkey AS task, p_size AS added_lines, n_labeled, n_resolved FROM part JOIN {_DIFF} ON task = p_partkey WHERE n_labeled >= 3)
  SELECT task, ntile(10) OVER (ORDER BY greatest(added_lines, 0), task) AS size_decile, round(ln(1 + greatest(added_lines, 0)), 3) AS log_lines, n_labeled, n_resolved, round(n_resolved::DOUBLE / nullif(n_labeled, 0), 3) AS solve_rate FROM i""")
def size_deciles(spark, d):
    size = F.greatest(F.col("p_size"), F.lit(0))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("task"), size.alias("size")).join(tasks.difficulty(rollouts(spark, d), "task").filter("n_labeled >= 3"), "task")
    binned = tasks.bins(rows, 10, F.col("size"), "task")
    return binned.select("task", F.col("bin").cast("long").alias("size_decile"), ref_round(F.ln(1 + F.col("size")), 3).alias("log_lines"), "n_labeled", "n_resolved", ref_round(ratio(F.col("n_resolved"), F.col("n_labeled")), 3).alias("solve_rate"))


@query(f"""WITH labeled AS (SELECT task, combo, resolved, p_size AS size, p_size % 7 >= 2 AS rung_binary FROM {ROLLOUTS} JOIN part ON p_partkey = task WHERE resolved IN (0, 1) AND p_size IS NOT NULL AND p_retailprice IS NOT NULL),
  inst AS (SELECT DISTINCT task, size FROM labeled), terc AS (SELECT task, ntile(3) OVER (ORDER BY size, task) AS tercile FROM inst)
  SELECT rung_binary, tercile, count(*) AS n, round(avg(resolved), 3) AS pass_rate, round(avg(resolved) FILTER (combo IN ('O/0', 'O/1')), 3) AS pass_rate_top, count(*) FILTER (combo IN ('O/0', 'O/1')) AS n_top
  FROM labeled JOIN terc USING (task) GROUP BY 1, 2""")
def rung_x_tercile(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("task"), F.col("p_size").alias("size"), "p_retailprice")
    labeled = rollouts(spark, d).filter(F.col("resolved").isin(0, 1)).join(part.dropna(), "task").withColumn("rung_binary", F.col("size") % 7 >= 2)
    tercile = tasks.bins(labeled.select("task", "size").distinct(), 3, F.col("size"), "task").select("task", F.col("bin").cast("long").alias("tercile"))
    top = F.col("combo").isin("O/0", "O/1")
    return labeled.join(tercile, "task").groupBy("rung_binary", "tercile").agg(
        F.count("*").alias("n"), ref_round(F.avg("resolved"), 3).alias("pass_rate"), ref_round(F.avg(F.when(top, F.col("resolved"))), 3).alias("pass_rate_top"), F.count_if(top).alias("n_top")
    )


_PAIRS = f"""WITH l AS (SELECT *, count(*) OVER t AS n, sum(resolved) OVER t AS k FROM {ROLLOUTS} WHERE resolved IN (0, 1) WINDOW t AS (PARTITION BY task)),
  e AS (SELECT *, min(resolved) OVER g AS lo, max(resolved) OVER g AS hi FROM l WHERE n >= 5 AND k > 0 AND k < n WINDOW g AS (PARTITION BY task, combo)), pairs AS (SELECT * FROM e WHERE lo = 0 AND hi = 1)"""


@query(f"{_PAIRS} SELECT task, combo, count(*) AS n, sum(resolved)::BIGINT AS k, any_value(CASE WHEN p_size <= 30 THEN 'SMALL' WHEN p_size >= 150 THEN 'LARGE' ELSE 'MID' END) AS stratum FROM pairs JOIN part ON p_partkey = task GROUP BY 1, 2")
def paired_eligible(spark, d):
    size = table(spark, d, "part").select(F.col("p_partkey").alias("task"), tasks.size_stratum(F.col("p_size")).alias("stratum"))
    rows = tasks.pair_groups(rollouts(spark, d), "task", ["task", "combo"]).join(size, "task")
    return rows.groupBy("task", "combo").agg(F.count("*").alias("n"), F.sum("resolved").cast("long").alias("k"), F.any_value("stratum").alias("stratum"))


@query(f"{_PAIRS} SELECT task, combo, round(avg(l_quantity) FILTER (resolved = 0) - avg(l_quantity) FILTER (resolved = 1), 6) AS difference FROM pairs GROUP BY 1, 2")
def sibling_difference(spark, d):
    fail, ok = (F.avg(F.when(F.col("resolved") == v, F.col("l_quantity"))) for v in (0, 1))
    return tasks.pair_groups(rollouts(spark, d), "task", ["task", "combo"]).groupBy("task", "combo").agg(ref_round(fail - ok, 6).alias("difference"))


@query("""SELECT o_orderpriority AS bench_version, o_orderstatus AS task_name, count(DISTINCT o_custkey) AS n_jobs, count(*) FILTER (o_totalprice >= 100000) AS n_pass, round(count(*) FILTER (o_totalprice >= 100000)::DOUBLE / nullif(count(*), 0), 3) AS pass_rate
  FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2""")
def task_rates(spark, d):
    passed = F.count_if(F.col("o_totalprice") >= 100000)
    return table(spark, d, "orders").filter("o_orderstatus <> 'P'").groupBy(F.col("o_orderpriority").alias("bench_version"), F.col("o_orderstatus").alias("task_name")).agg(
        F.countDistinct("o_custkey").alias("n_jobs"), passed.alias("n_pass"), ref_round(ratio(passed, F.count("*")), 3).alias("pass_rate")
    )


_LEVELS = "(SELECT o_custkey % 100 AS unit, substr(o_orderpriority, 1, 1)::INT AS level, count(*) AS attempts, count(*) FILTER (o_totalprice > 60000) AS passes FROM orders GROUP BY 1, 2) levels"


def _levels(spark, d):
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("unit"), level.alias("level"), (F.col("o_totalprice") > 60000).alias("passed"))
    return tasks.roll_up(rows, "unit", "level")


@query(f"SELECT unit, min(level) FILTER (3 * passes >= 2 * attempts) AS flip FROM {_LEVELS} GROUP BY 1")
def flip_point(spark, d):
    return tasks.flip_point(_levels(spark, d), "unit")


@query(f"SELECT unit, level AS best_level FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY abs(passes::DOUBLE / attempts - 0.5), level) AS pos FROM {_LEVELS}) WHERE pos = 1")
def nearest_half(spark, d):
    return tasks.nearest_half(_levels(spark, d).withColumn("rate", F.col("passes").cast("double") / F.col("attempts")), "unit")


@query(f"SELECT level, sum(attempts)::BIGINT AS attempts, sum(passes)::BIGINT AS passes, round(sum(passes)::DOUBLE / sum(attempts), 3) AS pass_rate FROM {_LEVELS} GROUP BY 1")
def calibration_curve(spark, d):
    return _levels(spark, d).groupBy("level").agg(F.sum("attempts").alias("attempts"), F.sum("passes").alias("passes"), ref_round(F.sum("passes").cast("double") / F.sum("attempts"), 3).alias("pass_rate"))


@query(f"SELECT flip, count(*) AS n FROM (SELECT unit, min(level) FILTER (3 * passes >= 2 * attempts) AS flip FROM {_LEVELS} GROUP BY 1) GROUP BY 1")
def flip_histogram(spark, d):
    return tasks.flip_point(_levels(spark, d), "unit").groupBy("flip").agg(F.count("*").alias("n"))


@query(f"""WITH f AS (SELECT unit, min(level) FILTER (3 * passes >= 2 * attempts) AS flip FROM {_LEVELS} GROUP BY 1), p AS (SELECT unit, flip, (unit % 5 + 1)::INT AS pred FROM f)
  SELECT count(*) AS n, count(flip) AS paired, round(avg(abs(pred - flip)), 3) AS mae, count(*) FILTER (pred = flip) AS exact, count(*) FILTER (abs(pred - flip) <= 1) AS within_one FROM p""")
def author_calibration(spark, d):
    rows = tasks.flip_point(_levels(spark, d), "unit").withColumn("off", F.abs((F.col("unit") % 5 + 1).cast("int") - F.col("flip")))
    return rows.agg(F.count("*").alias("n"), F.count("flip").alias("paired"), ref_round(F.avg("off"), 3).alias("mae"), F.count_if(F.col("off") == 0).alias("exact"), F.count_if(F.col("off") <= 1).alias("within_one"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS attempts, count(*) FILTER (o_totalprice > 60000) AS passes FROM orders GROUP BY 1)
  SELECT count(*) FILTER (attempts = 3) AS n_cells, round(avg((passes IN (1, 2))::INT) FILTER (attempts = 3), 3) AS split_share FROM c""")
def attempt_split(spark, d):
    cells = tasks.roll_up(table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") > 60000).alias("passed")), "o_custkey").filter("attempts = 3")
    return cells.agg(F.count("*").alias("n_cells"), ref_round(F.avg(F.col("passes").isin(1, 2).cast("int")), 3).alias("split_share"))


@query("""SELECT l_linenumber AS rule_id, count(*) FILTER (l_returnflag <> 'N') AS n_evaluated, count(*) FILTER (l_returnflag = 'A') AS n_failed, count(*) FILTER (l_returnflag = 'N') AS n_skipped FROM lineitem GROUP BY 1""")
def rule_kill_counts(spark, d):
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("rule_id")).agg(F.count_if(flag != "N").alias("n_evaluated"), F.count_if(flag == "A").alias("n_failed"), F.count_if(flag == "N").alias("n_skipped"))


@query("""WITH n AS (SELECT p_name || '-' || CASE WHEN p_size % 2 = 0 THEN 'L' ELSE 'A' END || (p_size % 5)::VARCHAR || '__' || p_partkey::VARCHAR AS name FROM part)
  SELECT name, regexp_extract(name, '^(.*)-([LA])(\\d+)__', 1) AS unit, try_cast(regexp_extract(name, '^(.*)-([LA])(\\d+)__', 3) AS INT) + CASE regexp_extract(name, '^(.*)-([LA])(\\d+)__', 2) WHEN 'A' THEN 2 ELSE 0 END AS level FROM n""")
def parse_trial_names(spark, d):
    name = F.concat("p_name", F.lit("-"), F.when(F.col("p_size") % 2 == 0, "L").otherwise("A"), (F.col("p_size") % 5).cast("string"), F.lit("__"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(name.alias("name")).withColumns(tasks.parse_trial(F.col("name")))


@query(f"""SELECT task, l_orderkey, l_linenumber, round((sum(resolved) OVER w - resolved)::DOUBLE / nullif(count(*) OVER w - 1, 0), 6) AS loo_rate, round(resolved - (sum(resolved) OVER w - resolved)::DOUBLE / nullif(count(*) OVER w - 1, 0), 6) AS residual
  FROM {ROLLOUTS} WHERE resolved IN (0, 1) WINDOW w AS (PARTITION BY task)""")
def leave_one_out(spark, d):
    rows = tasks.leave_one_out(rollouts(spark, d).filter(F.col("resolved").isin(0, 1)), "task", "resolved")
    return rows.select("task", "l_orderkey", "l_linenumber", ref_round(F.col("loo_rate"), 6).alias("loo_rate"), ref_round(F.col("resolved") - F.col("loo_rate"), 6).alias("residual"))


@query(f"""WITH x AS (SELECT n_resolved::DOUBLE / n_labeled AS y, n_labeled::DOUBLE AS w, p_size::DOUBLE AS u, p_retailprice AS v FROM {_DIFF} JOIN part ON p_partkey = task WHERE n_labeled > 0),
  z AS (SELECT y, w, (u - avg(u) OVER ()) / stddev_samp(u) OVER () AS u, (v - avg(v) OVER ()) / stddev_samp(v) OVER () AS v FROM x),
  m AS (SELECT sum(w * y) / sum(w) AS y, sum(w * u) / sum(w) AS u, sum(w * v) / sum(w) AS v FROM z),
  s AS (SELECT sum(w * (z.u - m.u) * (z.u - m.u)) AS uu, sum(w * (z.v - m.v) * (z.v - m.v)) AS vv, sum(w * (z.u - m.u) * (z.v - m.v)) AS uv, sum(w * (z.u - m.u) * (z.y - m.y)) AS uy, sum(w * (z.v - m.v) * (z.y - m.y)) AS vy FROM z, m)
  SELECT 'p_size' AS feature, round((uy * vv - vy * uv) / (uu * vv - uv * uv), 4) AS coef FROM s UNION ALL SELECT 'p_retailprice', round((vy * uu - uy * uv) / (uu * vv - uv * uv), 4) FROM s""")
def weighted_solve_model(spark, d):
    rows = tasks.difficulty(rollouts(spark, d), "task").join(table(spark, d, "part").withColumnRenamed("p_partkey", "task"), "task")
    return stats.weighted_linear(rows, "solve_rate", "n_labeled", ["p_size", "p_retailprice"]).select("feature", ref_round(F.col("coef"), 4).alias("coef"))


@query()
def size_mixture(spark, d):
    return stats.mixture_of(tasks.difficulty(rollouts(spark, d), "task")).select("component", ref_round(F.col("weight"), 4).alias("weight"), ref_round(F.col("rate"), 4).alias("rate"))


@query()
def irt_fit(spark, d):
    """b of the one-parameter model, b and a of the two-parameter one, of tasks with three labels at least."""
    counts = stats.counts_of(rollouts(spark, d), "task", "combo")
    one = stats.fit_response(counts, "task", "combo")[0].select("task", ref_round(F.col("b"), 3).alias("b_1pl"))
    two = stats.fit_response(counts, "task", "combo", two_parameters=True)[0].select("task", ref_round(F.col("b"), 3).alias("b_2pl"), ref_round(F.exp("log_a"), 3).alias("a_2pl"))
    return one.join(two, "task")


_HARD_FIRST = ("all_fail", "hard", "mid", "easy", "all_pass")


def _bucket_counts(rows) -> list[tuple[str, int]]:
    """How many tasks each bucket of pass rates has, from hard to easy."""
    found = dict(rows.groupBy("pass_bucket").count().collect())
    return [(b, found.get(b, 0)) for b in _HARD_FIRST]


def _bucketed(spark, d):
    rows = tasks.difficulty(rollouts(spark, d), "task").filter("n_labeled >= 3")
    return rows.withColumn("pass_bucket", tasks.difficulty_bucket(F.col("n_labeled"), F.col("solve_rate")))


@query()
def irt_bucket(spark, d):
    """The task table with a bucket by fitted difficulty: the hardest tasks take the share that the hardest bucket of pass rates has, and so on."""
    rows = _bucketed(spark, d)
    fitted = stats.fit_response(stats.counts_of(rollouts(spark, d), "task", "combo"), "task", "combo", two_parameters=True)[0]
    matched = stats.quantile_matched(fitted.select("task", "b"), [F.desc("b"), F.col("task")], _bucket_counts(rows), "irt_bucket")
    return rows.join(matched.select("task", "irt_bucket"), "task", "left")


_CUM = ", ".join(f"count(*) FILTER (bucket IN ({', '.join(repr(x) for x in _HARD_FIRST[: i + 1])})) OVER () AS c{i}" for i in range(5))


@query(f"""WITH b AS (SELECT *, n_resolved::DOUBLE / n_labeled AS solve_rate, {_BUCKET} AS bucket FROM {_DIFF} WHERE n_labeled >= 3),
  p AS (SELECT *, row_number() OVER (ORDER BY added, task) AS pos, {_CUM} FROM (SELECT b.*, p_retailprice AS added FROM b JOIN part ON p_partkey = task))
  SELECT task, n_rollouts, n_labeled, n_resolved, solve_rate, bucket AS pass_bucket,
  CASE WHEN pos <= c0 THEN 'all_fail' WHEN pos <= c1 THEN 'hard' WHEN pos <= c2 THEN 'mid' WHEN pos <= c3 THEN 'easy' ELSE 'all_pass' END AS price_bucket FROM p""")
def matched_bucket(spark, d):
    """The task table, all its columns kept, with a bucket by price whose shares are those of the pass-rate buckets."""
    rows = _bucketed(spark, d)
    priced = rows.select("task").join(table(spark, d, "part").select(F.col("p_partkey").alias("task"), "p_retailprice"), "task")
    matched = stats.quantile_matched(priced, [F.col("p_retailprice"), F.col("task")], _bucket_counts(rows), "price_bucket")
    return rows.join(matched.select("task", "price_bucket"), "task")
