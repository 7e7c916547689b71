"""Queries for what plain SQL over the views can ask: joins of all kinds, set operations, cubes, frames, and resampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracequarry.functions.compat import ref_round
from tracequarry.operators import stats, tasks, temporal
from tracequarry.plans.base import ROLLOUTS, query, rollouts, table
from tracequarry.plans.levels import _PAIRS


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, grouping(o_orderstatus, o_orderpriority)::BIGINT AS level, count(*) AS n FROM orders GROUP BY CUBE (1, 2)".replace("CUBE (1, 2)", "CUBE (o_orderstatus, o_orderpriority)"))
def cube_counts(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return df.cube("status", "priority").agg(F.grouping_id().alias("level"), F.count("*").alias("n")).select("status", "priority", "level", "n")


@query("SELECT c_custkey, count(o_orderkey) AS n, coalesce(sum(o_totalprice > 100000), 0)::BIGINT AS n_large FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1".replace("sum(o_totalprice > 100000)", "sum((o_totalprice > 100000)::INT)"))
def outer_join_counts(spark, d):
    orders = table(spark, d, "orders")
    joined = table(spark, d, "customer").join(orders, F.col("c_custkey") == orders["o_custkey"], "left")
    return joined.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("n_large"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS n_suppliers, b.n AS n_customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) b ON a.k = b.k")
def full_join_counts(spark, d):
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"))
    b = table(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    return a.join(b, "k", "full")


@query("SELECT c_custkey FROM customer SEMI JOIN (SELECT o_custkey AS c_custkey FROM orders WHERE o_orderstatus = 'P') USING (c_custkey)")
def semi_join(spark, d):
    pending = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(pending, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 60".replace("SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'", "(SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')"))
def set_operations(spark, d):
    e = table(spark, d, "events")
    return e.filter("event_type = 'signup'").select("user_id").intersect(e.filter("event_type = 'purchase'").select("user_id")).subtract(e.filter("event_type = 'error' and value > 60").select("user_id"))


@query("""SELECT e.event_id, s.event_id AS last_signup FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON e.user_id = s.user_id AND e.ts >= s.ts""")
def asof_signup(spark, d):
    """The latest signup of the same user at or before each event, by one window and no join."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "signup", F.col("event_id")), ignorenulls=True)
    return table(spark, d, "events").select("event_id", last.over(w).alias("last_signup"))


@query("""WITH v AS (SELECT p_retailprice AS price, count(*) AS n FROM part GROUP BY 1), s AS (SELECT price, sum(n) OVER (ORDER BY price RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING) AS upto, n FROM v),
  e AS (SELECT a.price, coalesce(max(b.n), 0) AS last FROM v a LEFT JOIN v b ON b.price = a.price + 5 GROUP BY 1)
  SELECT p_partkey AS band, (upto - last)::BIGINT AS n FROM part JOIN s ON s.price = p_retailprice JOIN e ON e.price = p_retailprice""")
def range_join(spark, d):
    """Parts in the band of 5 above each part's price: whole cells of prices are counted once, and only the two cells that
    a band's ends lie in meet it value by value.
    """
    price = F.col("p_retailprice")
    part = table(spark, d, "part")
    values = part.groupBy(price.alias("price")).agg(F.count("*").alias("n")).withColumn("cell", F.floor("price"))
    cells = values.groupBy("cell").agg(F.sum("n").alias("n"))
    bands = part.select(price.alias("low"), (price + 5).alias("high")).distinct()
    whole = bands.withColumn("cell", F.explode(F.sequence(F.floor("low") + 1, F.floor("high") - 1))).join(cells, "cell").select("low", "n")
    edges = bands.withColumn("cell", F.explode(F.array(F.floor("low"), F.floor("high")))).join(values, "cell").filter("price >= low and price < high").select("low", "n")
    counts = whole.union(edges).groupBy("low").agg(F.sum("n").alias("n"))
    return part.join(counts, price == F.col("low")).select(F.col("p_partkey").alias("band"), "n")


@query("""SELECT o_orderkey, rank() OVER w AS price_rank, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS day_rank, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order,
  first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_order FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)""")
def ranked_orders(spark, d):
    in_time = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"))).cast("long").alias("price_rank"),
        F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate")).cast("long").alias("day_rank"), F.lead("o_orderkey").over(in_time).alias("next_order"), F.first("o_orderkey").over(in_time).alias("first_order"),
    )


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 4) AS median, round(quantile_cont(p_retailprice, 0.9), 4) AS p90 FROM part GROUP BY 1")
def price_percentiles(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(ref_round(F.percentile("p_retailprice", F.lit(0.5)), 4).alias("median"), ref_round(F.percentile("p_retailprice", F.lit(0.9)), 4).alias("p90"))


@query(f"""SELECT task, {', '.join(f"round(avg(resolved) FILTER (combo = '{c}'), 3) AS rate_{c[0]}{c[2]}" for c in ('F/0', 'F/1', 'O/0', 'O/1'))} FROM {ROLLOUTS} WHERE resolved IN (0, 1) GROUP BY 1""")
def rates_by_combo(spark, d):
    """One column for each harness, by pivot."""
    wide = rollouts(spark, d).filter(F.col("resolved").isin(0, 1)).groupBy("task").pivot("combo", ["F/0", "F/1", "O/0", "O/1"]).agg(ref_round(F.avg("resolved"), 3))
    return wide.toDF("task", "rate_F0", "rate_F1", "rate_O0", "rate_O1")


_POISSON = (0.36788, 0.73576, 0.91970, 0.98101, 0.99634, 0.99941)
_DRAW = "('0x' || substr(md5(concat_ws('-', task, b)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"""{_PAIRS}, g AS (SELECT task, combo, avg(l_quantity) FILTER (resolved = 0) - avg(l_quantity) FILTER (resolved = 1) AS difference FROM pairs GROUP BY 1, 2),
  t AS (SELECT task, count(*) AS n, sum(difference) AS s FROM g GROUP BY 1), r AS (SELECT task, n, s, unnest(range(1, 21)) AS b FROM t),
  w AS (SELECT b, n, s, {' + '.join(f'(u >= {p})::INT' for p in _POISSON)} AS weight FROM (SELECT *, {_DRAW} AS u FROM r))
  SELECT b, sum(weight)::BIGINT AS n_tasks, round(sum(weight * s) / nullif(sum(weight * n), 0), 6) AS mean_difference FROM w GROUP BY 1""")
def task_bootstrap(spark, d):
    """Mean difference of failing and passing siblings over resampled tasks: every task is drawn, with all its pairs, a Poisson number of times in each round."""
    fail, ok = (F.avg(F.when(F.col("resolved") == v, F.col("l_quantity"))) for v in (0, 1))
    pairs = tasks.pair_groups(rollouts(spark, d), "task", ["task", "combo"]).groupBy("task", "combo").agg((fail - ok).alias("difference"))
    by_task = pairs.groupBy("task").agg(F.count("*").alias("n"), F.sum("difference").alias("s")).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(20))))
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("task").cast("string"), F.col("b").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0
    w = by_task.withColumn("weight", sum((u >= p).cast("int") for p in _POISSON))
    mean = F.sum(F.col("weight") * F.col("s")) / F.nullif(F.sum(F.col("weight") * F.col("n")), F.lit(0))
    return w.groupBy(F.col("b").cast("long").alias("b")).agg(F.sum("weight").alias("n_tasks"), ref_round(mean, 6).alias("mean_difference"))


@query("""SELECT CASE WHEN k > 90 THEN 'contaminated' WHEN value > 60 THEN 'infra' WHEN event_type = 'error' THEN 'test-edit' ELSE 'clean' END AS audit_class, count(*) AS n
  FROM (SELECT *, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY 1""")
def audit_classes(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    kind = F.when(k > 90, "contaminated").when(F.col("value") > 60, "infra").when(F.col("event_type") == "error", "test-edit").otherwise("clean")
    return table(spark, d, "events").groupBy(kind.alias("audit_class")).agg(F.count("*").alias("n"))


@query("""SELECT p_type, count(*) AS n, round(avg(p_size), 2) AS avg_size, count(DISTINCT p_brand) AS n_brands FROM part WHERE ('0x' || substr(md5(concat_ws('-', p_partkey, '42')), 1, 8))::BIGINT % 100 >= 80 GROUP BY 1""")
def held_out_parts(spark, d):
    held = table(spark, d, "part").filter(stats.hash_share(F.col("p_partkey")) >= 80)
    return held.groupBy("p_type").agg(F.count("*").alias("n"), ref_round(F.avg("p_size"), 2).alias("avg_size"), F.countDistinct("p_brand").alias("n_brands"))


@query("""WITH a AS (SELECT user_id, event_id AS order_id, ts AS s, ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS e FROM events WHERE event_type = 'purchase'),
  b AS (SELECT user_id, event_id AS error_id, ts AS s, ts + to_seconds(CAST(floor(value * 30) AS BIGINT)) AS e FROM events WHERE event_type = 'error')
  SELECT user_id, order_id, error_id FROM a JOIN b USING (user_id) WHERE a.s < b.e AND b.s < a.e AND a.s < a.e AND b.s < b.e""")
def overlapping_spans(spark, d):
    """Spans of purchases and of errors of one user that overlap, by cells of time."""
    at = temporal.micros("ts")
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", at.alias("at"), F.floor(F.col("value") * 60).alias("long_s"), F.floor(F.col("value") * 30).alias("short_s"))
    a = rows.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("order_id"), F.col("at").alias("a_from"), (F.col("at") + F.col("long_s") * 1_000_000).alias("a_to"))
    b = rows.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("at").alias("b_from"), (F.col("at") + F.col("short_s") * 1_000_000).alias("b_to"))
    return temporal.overlap_join(a, b, ["user_id"], (F.col("a_from"), F.col("a_to")), (F.col("b_from"), F.col("b_to")), 600_000_000).select("user_id", "order_id", "error_id")


@query("""WITH r AS (SELECT user_id AS cust, DATE '1995-01-01' + (event_id % 2400)::INT AS day, max(event_id) AS event_id FROM events GROUP BY 1, 2)
  SELECT o_orderkey, r.event_id, date_diff('day', r.day, o_orderdate::DATE) AS days_since FROM orders o ASOF LEFT JOIN r ON o.o_custkey = r.cust AND o.o_orderdate >= r.day""")
def asof_orders(spark, d):
    """Each order with its customer's latest event of another table, on or before its day."""
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("event_id") % 2400).cast("int"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), "o_orderkey", temporal.micros("o_orderdate").alias("at"))
    events = table(spark, d, "events").select(F.col("user_id").alias("cust"), "event_id", temporal.micros(day).alias("event_at"))
    found = temporal.asof_join(orders, events, ["cust"], F.col("at"), F.col("event_at"), 30 * 86_400_000_000, ["event_id"])
    return found.select("o_orderkey", "event_id", F.floor((F.col("at") - F.col("event_at")) / 86_400_000_000).alias("days_since"))
