"""Queries over turns and counters: unnesting, running counts, runs, sliding windows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracequarry.functions.compat import ref_round, text_to_int
from tracequarry.operators import tasks
from tracequarry.operators import trials as t
from tracequarry.plans.base import conversations, query, shared_folder, table
from tracequarry.streaming import ingest, ledger, signatures

_CONV = "(SELECT conv_id, list({'role': role, 'text': text, 'turn': turn} ORDER BY turn) AS messages FROM conversations GROUP BY 1) c"


@query(f"SELECT conv_id, pos AS turn_idx, m.role AS role, length(m.text) AS content_len FROM {_CONV}, unnest(messages) WITH ORDINALITY AS u(m, pos)")
def turns_exploded(spark, d):
    return t.turns(conversations(spark, d), "conv_id", ("role", "content_len")).withColumn("content_len", F.col("content_len").cast("long"))


_EVENTS = """(SELECT *, sum((event_type = 'purchase')::INT) OVER w::BIGINT AS cum_edits, sum((event_type = 'click')::INT) OVER w::BIGINT AS cum_tests,
  sum((event_type = 'error')::INT) OVER w::BIGINT AS cum_tool_errors, count(*) OVER w AS turn_idx, count(*) OVER (PARTITION BY user_id) AS n_turns
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) e"""


def _counted(spark, d):
    flags = {name: F.col("event_type") == kind for name, kind in (("cum_edits", "purchase"), ("cum_tests", "click"), ("cum_tool_errors", "error"))}
    return t.cumulative(table(spark, d, "events"), "user_id", ("ts", "event_id"), flags)


@query(f"SELECT event_id, user_id, turn_idx, n_turns, cum_edits, cum_tests, cum_tool_errors, turn_idx::DOUBLE / n_turns AS pct_through FROM {_EVENTS}")
def cumulative_turn_counts(spark, d):
    return _counted(spark, d).select("event_id", "user_id", "turn_idx", "n_turns", "cum_edits", "cum_tests", "cum_tool_errors", "pct_through")


@query(f"""SELECT CASE WHEN turn_idx::DOUBLE / n_turns <= 0.25 THEN '0-25' WHEN turn_idx::DOUBLE / n_turns <= 0.5 THEN '25-50' WHEN turn_idx::DOUBLE / n_turns <= 0.75 THEN '50-75' ELSE '75-100' END AS progress,
  event_type, count(*) AS n, count(DISTINCT user_id) AS n_trials, round(avg(cum_edits), 2) AS avg_edits, round(avg(cum_tests), 2) AS avg_tests, round(avg(cum_tool_errors), 2) AS avg_errors FROM {_EVENTS} GROUP BY 1, 2""")
def turn_progress_buckets(spark, d):
    means = [ref_round(F.avg(c), 2).alias(n) for c, n in (("cum_edits", "avg_edits"), ("cum_tests", "avg_tests"), ("cum_tool_errors", "avg_errors"))]
    rows = _counted(spark, d).withColumn("progress", t.progress_bucket(F.col("pct_through")))
    return rows.groupBy("progress", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_trials"), *means)


@query("""WITH c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS change FROM events),
  i AS (SELECT user_id, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c),
  n AS (SELECT user_id, island, count(*) AS n FROM i GROUP BY 1, 2) SELECT user_id, max(n) AS longest_run FROM n GROUP BY 1""")
def max_consecutive_run(spark, d):
    return t.longest_run(table(spark, d, "events"), "user_id", ("ts", "event_id"), "event_type")


@query(f"""SELECT user_id, min(turn_idx) FILTER (event_type = 'purchase') AS first_turn, max(turn_idx) FILTER (event_type = 'purchase') AS last_turn, arg_max(event_type, turn_idx) AS last_kind FROM {_EVENTS} GROUP BY 1""")
def first_last_positions(spark, d):
    rows = _counted(spark, d)
    return rows.groupBy("user_id").agg(*t.positions(rows, "user_id", F.col("event_type") == "purchase"), F.max_by("event_type", "turn_idx").alias("last_kind"))


@query("""SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'assistant') AS n_assistant_turns,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS assistant_chars, coalesce(sum(length(text)) FILTER (role = 'user'), 0)::BIGINT AS user_chars FROM conversations GROUP BY 1""")
def text_chars_by_role(spark, d):
    """Counts and characters by role, which combine before they move."""
    role, n = F.col("role"), F.length("text").cast("long")
    chars = [F.coalesce(F.sum(F.when(role == r, n)), F.lit(0)).alias(f"{r}_chars") for r in ("assistant", "user")]
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.count_if(role == "assistant").alias("n_assistant_turns"), *chars)


@query(f"SELECT conv_id, length(messages[2].text) AS issue_chars FROM {_CONV} WHERE len(messages) >= 2")
def issue_length(spark, d):
    """The length of each conversation's second message; the first two of a conversation are told apart where they are read."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("issue_chars")).withColumn("_place", place)
    return rows.filter(F.col("_place") <= 2).filter("_place = 2").select("conv_id", "issue_chars")


@query("""WITH k AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS kinds FROM events GROUP BY 1)
  SELECT user_id, len(kinds) AS n_tool_calls, len(list_distinct(kinds)) AS n_distinct, 1 - len(list_distinct(kinds))::DOUBLE / len(kinds) AS repeat_call_rate FROM k""")
def repeat_call_rate(spark, d):
    n, distinct = F.count("event_type"), F.countDistinct("event_type")
    rows = table(spark, d, "events").groupBy("user_id").agg(n.alias("n_tool_calls"), distinct.alias("n_distinct"))
    return rows.withColumn("repeat_call_rate", 1 - F.col("n_distinct").cast("double") / F.col("n_tool_calls"))


@query("""SELECT event_id, CASE WHEN k > 90 THEN 'CONTAMINATED' WHEN value > 20 THEN 'PASS' ELSE 'FAIL' END AS verdict
  FROM (SELECT *, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def trial_verdicts(spark, d):
    k = text_to_int(F.get_json_object("props", "$.k"))
    return table(spark, d, "events").select("event_id", tasks.verdict(k - 90, (F.col("value") > 20).cast("int")).alias("verdict"))


@query("""SELECT event_id, round(epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 6e7, 1) AS minutes FROM events""".replace("epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))", "(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id))"))
def minutes_between(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", ref_round((at - F.lag(at).over(w)) / 6e7, 1).alias("minutes"))


@query("""WITH w AS (SELECT unnest(range(date_trunc('hour', ts) - INTERVAL 5 HOUR, date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS start, event_type FROM events)
  SELECT epoch(start)::BIGINT AS start_s, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_over FROM w GROUP BY 1""")
def rolling_health(spark, d):
    rows = ingest.rolling_health(table(spark, d, "events").withColumn("over", F.col("event_type") == "error"), "ts", "over")
    return rows.select(F.unix_timestamp("start").alias("start_s"), "n", "n_over")


@query("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) ANTI JOIN (SELECT DISTINCT user_id, event_type FROM events WHERE event_id < 500) USING (user_id, event_type) GROUP BY 1")
def idempotent_ingest(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return ingest.not_recorded(events, events.filter("event_id < 500"), ["user_id", "event_type"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id AS package, event_id, CASE event_type WHEN 'purchase' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' END AS action FROM events WHERE event_type IN ('purchase', 'error', 'signup'))
  SELECT 'p' || package AS package, CASE WHEN arg_max(action, event_id) = 'pass' THEN 'ok' ELSE arg_max(action, event_id) END AS status FROM e GROUP BY 1""".replace("GROUP BY 1", "GROUP BY e.package"))
def package_status(spark, d):
    action = F.when(F.col("event_type") == "purchase", "pass").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "signup", "skip")
    line = F.when(action.isNotNull(), F.to_json(F.struct(action.alias("Action"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("Package")))).otherwise("not json")
    return tasks.package_status(table(spark, d, "events").select(F.col("event_id").alias("seq"), line.alias("line")))


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_ok FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'purchase') >= 5""")
def repo_keep_filter(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("n_ok")).filter("n_ok >= 5")


@query("""WITH a AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE event_id < 500 GROUP BY 1, 2), b AS (SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2)
  SELECT user_id, event_type, event_id FROM a UNION ALL SELECT user_id, event_type, event_id FROM b ANTI JOIN a USING (user_id, event_type)""".replace("arg_min(event_id, (ts, event_id))", "first(event_id ORDER BY ts, event_id)"))
def ledger_ingest(spark, d):
    """Attempts recorded once: a first batch, one that has it all again, and that one run twice."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    out, led = shared_folder(spark, "attempts"), shared_folder(spark, "ledger")
    for batch, number in ((events.filter("event_id < 500"), 0), (events, 1), (events, 1)):
        ledger.record(batch, "r", number, out, led, ["user_id", "event_type"], ["ts", "event_id"])
    return spark.read.parquet(out).select("user_id", "event_type", "event_id")


@query("""WITH s AS (SELECT event_type || ' <n> of user <n> at <path>' AS signature, ts FROM events WHERE event_type IN ('error', 'click')) SELECT signature, count(*) AS n FROM s GROUP BY 1""")
def error_signatures(spark, d):
    """Messages brought to their signatures, with the number of their occurrences."""
    path = F.concat(F.lit("/var/u"), F.col("user_id").cast("string"), F.lit("/x.log"))
    message = F.concat_ws(" ", "event_type", F.col("event_id").cast("string"), F.lit("of user "), F.col("user_id").cast("string"), F.lit("at"), path)
    rows = table(spark, d, "events").filter(F.col("event_type").isin("error", "click")).select(signatures.signature(message).alias("signature"))
    return rows.groupBy("signature").agg(F.count("*").alias("n"))


_OUTCOME = "CASE last(event_type ORDER BY ts, event_id) WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failed' ELSE 'unknown' END AS outcome_label"


@query(f"""WITH o AS (SELECT user_id, {_OUTCOME} FROM events GROUP BY 1)
  SELECT CASE WHEN turn_idx::DOUBLE / n_turns <= 0.25 THEN '0-25' WHEN turn_idx::DOUBLE / n_turns <= 0.5 THEN '25-50' WHEN turn_idx::DOUBLE / n_turns <= 0.75 THEN '50-75' ELSE '75-100' END AS progress, outcome_label,
  count(DISTINCT user_id) AS trials, round(avg(cum_edits), 2) AS avg_edits_so_far, round(avg(cum_tests), 2) AS avg_tests_so_far, round(avg(cum_tool_errors), 2) AS avg_tool_errors FROM {_EVENTS} JOIN o USING (user_id) WHERE event_type <> 'signup' GROUP BY 1, 2""")
def early_signal(spark, d):
    """How far trials that end well and badly are apart at each quarter; an outcome is a trial's last turn."""
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    resolved = F.when(last == "purchase", 1).when(last == "error", 0).otherwise(-1)
    outcomes = table(spark, d, "events").groupBy("user_id").agg(t.outcome(resolved).alias("outcome_label"))
    rows = _counted(spark, d).filter("event_type <> 'signup'").withColumn("progress", t.progress_bucket(F.col("pct_through"))).join(outcomes, "user_id")
    means = [ref_round(F.avg(c), 2).alias(n) for c, n in (("cum_edits", "avg_edits_so_far"), ("cum_tests", "avg_tests_so_far"), ("cum_tool_errors", "avg_tool_errors"))]
    return rows.groupBy("progress", "outcome_label").agg(F.countDistinct("user_id").alias("trials"), *means)
