"""Queries that look closely: every match and what is near it, patches by what they change, shards whose schemas drift."""

from pyspark.sql import functions as F

from tracequarry.functions.compat import ratio, ref_round
from tracequarry.operators import matching, patches, robust, rollups
from tracequarry.plans.base import ROLLOUTS, query, rollouts, shared_folder, table
from tracequarry.sources import query_log, trial_logs
from tracequarry.sources.drift import read_drifting

_MATCH, _OTHER = "than ", "tion"
_HITS = f"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_MATCH}') AS found, string_split_regex(coalesce(text, ''), '{_MATCH}') AS gaps FROM documents),
  a AS (SELECT doc_id, t, found[i] AS match, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda g: length(g))), 0) + 1)::BIGINT AS "at" FROM p, unnest(range(1, len(found) + 1)) AS u(i)),
  hits AS (SELECT doc_id, "at", length(match)::BIGINT AS n, match, (1 + length(substr(t, 1, "at" - 1)) - length(replace(substr(t, 1, "at" - 1), chr(10), '')))::BIGINT AS line,
    regexp_matches(substr(t, greatest("at" - 600, 1), "at" + 600 - greatest("at" - 600, 1)), '{_OTHER}') AS near, t FROM a)"""


def _near(spark, d):
    return matching.matches_near(table(spark, d, "documents"), ["doc_id"], "text", _MATCH, _OTHER)


@query(f"""{_HITS} SELECT doc_id, "at", n, match, line, near, substr(trim(string_split(t, chr(10))[line]), 1, 110) AS context FROM hits""")
def context_window_match(spark, d):
    """Every match with its place, its line, and whether the other pattern is within 600 characters."""
    return matching.with_line_text(_near(spark, d), table(spark, d, "documents"), ["doc_id"], "text")


@query(f"""{_HITS}, u AS (SELECT regexp_replace('u' || doc_id % 40 || '-L' || doc_id % 5, '-L[^-]*$', '') AS unit, * FROM hits),
  f AS (SELECT unit, doc_id, line, row_number() OVER (PARTITION BY unit ORDER BY doc_id, "at") AS place FROM u)
  SELECT unit, n_hits, hard, first_hits FROM (SELECT unit, count(*) AS n_hits, bool_or(NOT near) AS hard FROM u GROUP BY 1)
  JOIN (SELECT unit, string_agg(doc_id || ':' || line, ',' ORDER BY place) AS first_hits FROM f WHERE place <= 4 GROUP BY 1) USING (unit)""")
def hits_by_unit(spark, d):
    """Matches counted under the name before the last level mark, with the first four; a unit is hard if a match has nothing near it."""
    name = F.concat(F.lit("u"), (F.col("doc_id") % 40).cast("string"), F.lit("-L"), (F.col("doc_id") % 5).cast("string"))
    hits = _near(spark, d).withColumn("unit", F.regexp_replace(name, "-L[^-]*$", ""))
    return matching.hits_by_unit(hits, "unit", ["doc_id", "at"], ["doc_id", "line"])


#: A task's gold patch of two hunks, and what each trial made of it, by its line number.
_HUNKS = {
    "first": "'diff --git a/src/' || p_brand || '.py b/src/' || p_brand || '.py' || chr(10) || '--- a/src/x' || chr(10) || '+++ b/src/x' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' line ' || p_partkey || chr(10) || '-' || p_name || chr(10) || '+' || p_type || chr(10)",
    "moved": "'diff --git a/src/' || p_brand || '.py b/src/' || p_brand || '.py' || chr(10) || '@@ -40,2 +41,3 @@ def f():' || chr(10) || ' other' || chr(10) || '-  ' || p_name || '  ' || chr(10) || '+' || replace(p_type, ' ', '   ') || chr(10) || '+' || chr(10)",
    "other": "'diff --git a/src/' || p_brand || '.py b/src/' || p_brand || '.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || p_name || chr(10) || '+' || p_type || ' more' || chr(10)",
    "second": "'diff --git a/size.py b/size.py' || chr(10) || '--- a/size.py' || chr(10) || '+++ b/size.py' || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+' || p_size || chr(10)",
}
_GOLD = f"{_HUNKS['first']} || {_HUNKS['second']}"
_MADE = f"CASE l_linenumber % 5 WHEN 0 THEN {_GOLD} WHEN 1 THEN {_HUNKS['second']} || {_HUNKS['first']} WHEN 2 THEN {_HUNKS['moved']} || {_HUNKS['second']} WHEN 3 THEN {_HUNKS['other']} || {_HUNKS['second']} ELSE {_HUNKS['first']} END"


def _sql_changed(sign: str) -> str:
    return f"list_filter(list_transform(list_filter(string_split(h, chr(10)), lambda x: starts_with(x, '{sign}')), lambda x: trim(regexp_replace(substr(x, 2), '[ \\t\\f\\r]+', ' ', 'g'))), lambda x: x <> '')"


def _sql_canonical(patch: str) -> str:
    hunk = f"{{'path': regexp_extract(f, '^\\S+ b/(\\S+)', 1), 'removed': {_sql_changed('-')}, 'added': {_sql_changed('+')}}}"
    told = "sha256(k.path || chr(10) || array_to_string(list_prepend('', k.removed), chr(10) || '-') || chr(10) || array_to_string(list_prepend('', k.added), chr(10) || '+'))"
    of_file = f"list_transform(list_filter(list_transform(string_split_regex(f, '\\n@@[^\\n]*')[2:], lambda h: {hunk}), lambda k: len(k.removed) + len(k.added) > 0), lambda k: {told})"
    return f"sha256(array_to_string(list_sort(flatten(list_transform(string_split(chr(10) || {patch}, chr(10) || 'diff --git ')[2:], lambda f: {of_file}))), ','))"


@query(f"""WITH t AS (SELECT task, combo, l_orderkey, l_linenumber, l_quantity, p_size, {_MADE} AS made, {_GOLD} AS gold FROM {ROLLOUTS} JOIN part ON p_partkey = task WHERE resolved = 1)
  SELECT task, combo, l_orderkey, l_linenumber, l_quantity AS trial_lines, p_size AS gold_lines, round(l_quantity / nullif(p_size, 0), 4) AS ratio, {_sql_canonical('made')} AS patch_digest, {_sql_canonical('made')} <> {_sql_canonical('gold')} AS differs FROM t""")
def gold_backfill(spark, d):
    """Every passed trial's patch beside its task's gold patch, and whether it changes something else; a task's digest is worked out once."""
    gold = table(spark, d, "part").withColumns({"task": F.col("p_partkey"), "gold": patches.canonical(F.expr(_GOLD.replace("chr(10)", "'\\n'")))})
    passed = rollouts(spark, d).filter("resolved = 1").select("task", "combo", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("trial_lines"))
    joined = passed.join(gold, "task").withColumn("patch_digest", patches.canonical(F.expr(_MADE.replace("chr(10)", "'\\n'"))))
    return joined.select(
        "task", "combo", "l_orderkey", "l_linenumber", "trial_lines", F.col("p_size").alias("gold_lines"), ref_round(ratio(F.col("trial_lines"), F.col("p_size")), 4).alias("ratio"),
        "patch_digest", (F.col("patch_digest") != F.col("gold")).alias("differs"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 3 = 1 THEN o_custkey END AS link FROM orders""")
def drifting_shards(spark, d):
    """Orders from shards of three schemas, whose columns, nested fields and types came one after the other: three scans, widened to one table."""
    orders, path, kind = table(spark, d, "orders"), shared_folder(spark, "shards"), F.col("o_orderkey") % 3
    key = F.col("o_orderkey")
    shards = [
        orders.filter(kind == 0).select(key.cast("int").alias("o_orderkey"), F.floor("o_totalprice").cast("int").alias("price")),
        orders.filter(kind == 1).select(key.cast("long").alias("o_orderkey"), F.col("o_totalprice").cast("double").alias("price"), F.struct(F.col("o_orderstatus").alias("status")).alias("info"), F.array(F.col("o_custkey").cast("int"), key.cast("int")).alias("links")),
        orders.filter(kind == 2).select(F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status")).alias("info"), F.col("o_totalprice").cast("double").alias("price"), key.cast("long").alias("O_ORDERKEY")),
    ]
    for i, shard in enumerate(shards):
        shard.repartition(5).write.parquet(f"{path}/{i}")
    return read_drifting(spark, [path]).select("o_orderkey", "price", "info.status", "info.priority", F.get("links", F.lit(0)).cast("long").alias("link"))


_LOGGED = "(SELECT *, 'job' || user_id % 3 AS job, 'u' || user_id % 20 || '__' || user_id % 2 AS trial, event_id % 97 = 0 AS bad, event_type = 'signup' AND value > 90 AS fetched, event_type = 'error' AND user_id % 20 = 7 AND value > 80 AS searched FROM events) e"


@query(f"""SELECT job, trial, split_part(trial, '__', 1) AS task, count(*) AS n_lines, count(*) FILTER (bad) AS n_malformed, count(*) FILTER (fetched AND NOT bad) AS n_fetch, count(*) FILTER (searched AND NOT bad) AS n_search,
    CASE WHEN trial <> 'u9__1' THEN (max(event_id) % 2)::DOUBLE END AS reward, CASE WHEN trial <> 'u9__1' THEN round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 1) END AS minutes,
    CASE WHEN count(*) FILTER ((fetched OR searched) AND NOT bad) > 0 THEN 'CONTAMINATED' WHEN trial = 'u9__1' THEN 'PENDING' WHEN max(event_id) % 2 = 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM {_LOGGED} GROUP BY job, trial""")
def agent_log_audit(spark, d):
    """Trials judged by their logs: events written as agent logs, one folder a trial, some lines broken, and read again beside the trials' results; one trial has none yet."""
    path, user = shared_folder(spark, "jobs"), F.col("user_id")
    trial = F.concat(F.lit("u"), (user % 20).cast("string"), F.lit("__"), (user % 2).cast("string"))
    events = table(spark, d, "events").withColumns({"job": F.concat(F.lit("job"), (user % 3).cast("string")), "trial": trial})
    call = F.when((F.col("event_type") == "signup") & (F.col("value") > 90), "webFetchToolCall").when((F.col("event_type") == "error") & (user % 20 == 7) & (F.col("value") > 80), "webSearchToolCall").otherwise("shellToolCall")
    line = F.when(F.col("event_id") % 97 == 0, F.lit('{"type": ')).otherwise(F.to_json(F.struct(call.alias("type"), "event_id")))
    logs = events.select("job", "trial", F.lit("log").alias("agent"), line.alias("value"))
    logs.repartition("job", "trial").write.partitionBy("job", "trial", "agent").text(path)
    at = F.col("ts").cast("timestamp")
    results = events.filter("trial <> 'u9__1'").groupBy("job", "trial").agg((F.max("event_id") % 2).cast("double").alias("reward"), F.min(at).alias("started_at"), F.max(at).alias("finished_at"))
    named = {c: F.regexp_replace(c, f"^{c}=", "") for c in ("job", "trial")}
    return trial_logs.audited(trial_logs.log_files(spark, path).withColumns(named), trial_logs.log_summary(trial_logs.log_lines(spark, path)).withColumns(named), results)


_DETAIL = f"(SELECT task % 50 AS unit, l_linenumber AS detail, count(*)::DOUBLE AS n, sum(resolved)::DOUBLE AS k FROM {ROLLOUTS} WHERE resolved IN (0, 1) GROUP BY 1, 2) cells"
_CELL = "(k - n * exp(log_p * d)) ** 2 / (n * exp(log_p * d) * (1 - exp(log_p * d)))"
_SLOPE = "sum(n * ((k + 0.5) / (n + 1)) / (1 - (k + 0.5) / (n + 1)) * d * ln((k + 0.5) / (n + 1))) / sum(n * ((k + 0.5) / (n + 1)) / (1 - (k + 0.5) / (n + 1)) * d * d)"
_SCORE = "((statistic / degrees) ** (1 / 3.0::DOUBLE) - (1 - 2.0::DOUBLE / (9 * degrees))) / sqrt(2.0::DOUBLE / (9 * degrees))"


def _details(spark, d):
    rows = rollouts(spark, d).filter(F.col("resolved").isin(0, 1))
    return rows.select((F.col("task") % 50).alias("unit"), F.col("l_linenumber").alias("detail"), "resolved", "l_quantity", "task", F.lit(1).alias("one"))


def _rounded(df, *names):
    return df.withColumns({n: ref_round(F.col(n), 6) for n in names})


@query(f"""WITH c AS (SELECT detail::DOUBLE AS d, sum(n) AS n, sum(k) AS k FROM {_DETAIL} GROUP BY 1), f AS (SELECT {_SLOPE} AS log_p FROM c),
  t AS (SELECT max(log_p) AS log_p, sum({_CELL}) AS statistic, count(*) - 1 AS degrees FROM c, f)
  SELECT round(exp(log_p), 6) AS p, round(statistic, 6) AS statistic, degrees, round({_SCORE}, 6) AS z FROM t""")
def geometric_pass_rate(spark, d):
    """Whether pass rates fall geometrically with the number of details."""
    return _rounded(robust.geometric_test(_details(spark, d), "detail", "one", "resolved"), "p", "statistic", "z")


@query(f"""WITH c AS (SELECT unit, detail::DOUBLE AS d, n, k FROM {_DETAIL}), f AS (SELECT unit, {_SLOPE} AS log_p FROM c GROUP BY 1 HAVING count(*) > 1),
  t AS (SELECT count(DISTINCT unit) AS n_units, sum({_CELL}) AS statistic, count(*) - count(DISTINCT unit) AS degrees FROM c JOIN f USING (unit))
  SELECT n_units, round(statistic, 6) AS statistic, degrees, round(statistic / degrees, 6) AS ratio, round({_SCORE}, 6) AS z FROM t""")
def within_unit_dispersion(spark, d):
    """Whether pass rates within a unit spread more than chance gives."""
    return _rounded(robust.unit_dispersion(_details(spark, d), "unit", "detail", "one", "resolved"), "statistic", "ratio", "z")


#: The inverse of the bends' matrix h, and what a step of Newton's adds to each coefficient.
_DET = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
_INVERSE = {
    "00": f"(h11 * h22 - h12 * h12) / {_DET}", "01": f"(h02 * h12 - h01 * h22) / {_DET}", "02": f"(h01 * h12 - h02 * h11) / {_DET}",
    "11": f"(h00 * h22 - h02 * h02) / {_DET}", "12": f"(h01 * h02 - h00 * h12) / {_DET}", "22": f"(h00 * h11 - h01 * h01) / {_DET}",
}
_SUMS = "sum(w) AS h00, sum(w * u) AS h01, sum(w * v) AS h02, sum(w * u * u) AS h11, sum(w * u * v) AS h12, sum(w * v * v) AS h22"


def _entry(i: int, j: int) -> str:
    return f"{min(i, j)}{max(i, j)}"


_STEPS = ", ".join(f"{c} + {' + '.join(f'({_INVERSE[_entry(i, j)]}) * g{j}' for j in range(3))}" for i, c in enumerate("abc"))
_COVER = ", ".join(f"({' + '.join(f'i{_entry(i, k)} * m{_entry(k, n)} * i{_entry(n, j)}' for k in range(3) for n in range(3))}) * scale AS c{i}{j}" for i in range(3) for j in range(i, 3))


@query(f"""WITH RECURSIVE r AS (SELECT resolved::DOUBLE AS y, task % 50 AS g, l_linenumber::DOUBLE AS u, l_quantity::DOUBLE AS v FROM {ROLLOUTS} WHERE resolved IN (0, 1)),
  s AS (SELECT avg(u) AS mu, stddev_pop(u) AS su, avg(v) AS mv, stddev_pop(v) AS sv, count(*) AS n, count(DISTINCT g) AS n_clusters FROM r),
  x AS (SELECT y, g, (u - mu) / su AS u, (v - mv) / sv AS v FROM r, s),
  fit(i, a, b, c) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL SELECT i + 1, {_STEPS} FROM (
    SELECT i, a, b, c, sum(y - p) AS g0, sum((y - p) * u) AS g1, sum((y - p) * v) AS g2, {_SUMS} FROM (SELECT *, p * (1 - p) AS w FROM (SELECT i, a, b, c, y, u, v, 1 / (1 + exp(-(a + b * u + c * v))) AS p FROM fit, x WHERE i < 15)) GROUP BY i, a, b, c)),
  e AS (SELECT a, b, c, y, g, u, v, 1 / (1 + exp(-(a + b * u + c * v))) AS p FROM fit, x WHERE i = 15),
  h AS (SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, {_SUMS} FROM (SELECT *, p * (1 - p) AS w FROM e)),
  t AS (SELECT sum(y - p) AS s0, sum((y - p) * u) AS s1, sum((y - p) * v) AS s2 FROM e GROUP BY g),
  m AS (SELECT {', '.join(f'sum(s{i} * s{j}) AS m{i}{j}' for i in range(3) for j in range(i, 3))} FROM t),
  k AS (SELECT *, {', '.join(f'{v} AS i{k}' for k, v in _INVERSE.items())}, n_clusters / (n_clusters - 1)::DOUBLE * (n - 1) / (n - 3)::DOUBLE AS scale FROM h, m, s),
  q AS (SELECT *, {_COVER} FROM k),
  o AS (SELECT '(intercept)' AS feature, a - b * mu / su - c * mv / sv AS coef, sqrt(c00 + c11 * (mu / su) ** 2 + c22 * (mv / sv) ** 2 - 2 * c01 * mu / su - 2 * c02 * mv / sv + 2 * c12 * mu / su * mv / sv) AS se, n, n_clusters FROM q
    UNION ALL SELECT 'detail', b / su, sqrt(c11) / su, n, n_clusters FROM q UNION ALL SELECT 'l_quantity', c / sv, sqrt(c22) / sv, n, n_clusters FROM q)
  SELECT feature, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 4) AS z, n, n_clusters FROM o""")
def detail_logistic(spark, d):
    """Passing by the number of details and the size, with errors that allow for units."""
    found = robust.cluster_logistic(_details(spark, d), "resolved", ["detail", "l_quantity"], "unit")
    return found.select("feature", ref_round(F.col("coef"), 6).alias("coef"), ref_round(F.col("se"), 6).alias("se"), ref_round(F.col("z"), 4).alias("z"), "n", "n_clusters")


_BY_LANGUAGE = rollups.RollUp(
    ("lang",), counts={"n_long": "n_chars > 1500"}, sums={"chars": "n_chars"}, means={"avg_chars": "n_chars"}, extremes={"id": "doc_id"}, distinct={"n_sources": "source", "about_ids": "doc_id"}, digits=2
)


@query("""SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1500) AS n_long, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 2) AS avg_chars, min(doc_id) AS min_id, max(doc_id) AS max_id, count(DISTINCT source) AS n_sources, TRUE AS ids_within_error, 2 AS n_new FROM documents GROUP BY 1""")
def incremental_rollup(spark, d):
    """Documents that come as shards: two are summed up, then two more, which alone are read; merged sums are those of the table, and a sketch's count is within its error."""
    docs, path, store = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), shared_folder(spark, "shards"), shared_folder(spark, "rollup")
    new: list[str] = []
    for parts in ((0, 1), (2, 3)):
        for part in parts:
            docs.filter(F.coalesce(F.pmod("doc_id", F.lit(4)), F.lit(0)) == part).coalesce(1).write.parquet(f"{path}/{part}")
        new = rollups.refresh(spark, path, store, _BY_LANGUAGE, lambda files: spark.read.schema(docs.schema).parquet(*files))
    exact = docs.groupBy("lang").agg(F.countDistinct("doc_id").alias("n_ids")).withColumnRenamed("lang", "_lang")
    merged = rollups.rolled(spark, path, store, _BY_LANGUAGE).join(exact, F.col("lang").eqNullSafe(F.col("_lang")))
    close = F.abs(F.col("about_ids") - F.col("n_ids")) <= rollups.DISTINCT_ERROR * F.col("n_ids")
    return merged.select("lang", "n", "n_long", "chars", "avg_chars", "min_id", "max_id", "n_sources", close.alias("ids_within_error"), F.lit(len(new)).alias("n_new"))


@query("""WITH r AS (SELECT user_id, count(*) AS n, avg(value) AS mean, count(*) FILTER (event_type = 'error') AS n_errors FROM events GROUP BY 1), t AS (SELECT count(*) AS n_rows, count(*) FILTER (NOT mean < 60) AS high, count(*) FILTER (NOT n_errors > 0) AS clean FROM r)
  SELECT 'by user' AS name, n_rows, 'a user has an error' AS rule, clean AS violations FROM t WHERE clean > 0 UNION ALL SELECT 'by user', n_rows, 'values are low', high FROM t WHERE high > 0""")
def observed_query(spark, d):
    """What the log says of a query whose rows were counted, and its rules looked at, while its result was written."""
    out, log = shared_folder(spark, "result"), shared_folder(spark, "log")
    rules = {"values are low": "mean < 60", "a user has an error": "n_errors > 0", "rows are counted": "n > 0"}
    sql = "SELECT user_id, count(*) AS n, avg(value) AS mean, count_if(event_type = 'error') AS n_errors FROM {events} GROUP BY user_id"
    query_log.run_observed(spark, sql, out, log, "by user", rules, events=table(spark, d, "events"))
    return spark.read.parquet(log).select("name", "n_rows", F.explode("violations").alias("rule", "violations"))
