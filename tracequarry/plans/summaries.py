"""Queries over trials: corpus summaries, catalogs, rates, samples."""

from pyspark.sql import functions as F

from tracequarry.functions.compat import last_order, percent, rate, ratio, ref_round, text_to_int
from tracequarry.operators import features, stats, tasks
from tracequarry.operators import trials as t
from tracequarry.plans.base import TRIALS, query, table, trials
from tracequarry.sources.corpus import union_by_name

_SPLIT = "sum((resolved = 1)::INT)::BIGINT AS n_pass, sum((resolved = 0)::INT)::BIGINT AS n_fail, sum((resolved = -1)::INT)::BIGINT AS n_unknown"


@query(f"SELECT count(*) AS n_rows, count(DISTINCT harness) AS n_tasks, count(DISTINCT language) AS n_repos, {_SPLIT} FROM {TRIALS}")
def verify_summary(spark, d):
    return t.corpus_summary(trials(spark, d), "harness", "language")


@query(f"SELECT language, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 2) AS pct FROM {TRIALS} GROUP BY 1")
def dataset_profile_pct(spark, d):
    return t.shares(trials(spark, d), "language").orderBy(F.desc("n"), *last_order("language"))


@query(f"SELECT harness, count(*) AS n FROM {TRIALS} GROUP BY 1 ORDER BY n DESC, harness LIMIT 15")
def top_harnesses(spark, d):
    return trials(spark, d).groupBy("harness").agg(F.count("*").alias("n")).orderBy(F.desc("n"), *last_order("harness")).limit(15)


@query("SELECT count(*) AS n_rows, count(DISTINCT source) AS n_sources, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents")
def download_catalog(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query(f"SELECT harness, language, count(*) AS n, round(avg(n_chars), 1) AS avg_chars FROM {TRIALS} GROUP BY 1, 2")
def catalog_by_source(spark, d):
    return trials(spark, d).groupBy("harness", "language").agg(F.count("*").alias("n"), ref_round(F.avg("n_chars"), 1).alias("avg_chars"))


def _pct(v: int, name: str) -> str:
    return f"round(100.0::DOUBLE * sum((resolved = {v})::INT) / count(*), 1) AS {name}"


@query(f"SELECT harness, count(*) AS n, {_pct(1, 'pct_pass')}, {_pct(0, 'pct_fail')}, {_pct(-1, 'pct_unknown')} FROM {TRIALS} GROUP BY 1")
def resolved_rates(spark, d):
    return t.resolved_rates(trials(spark, d), "harness").orderBy(*last_order("harness"))


@query(f"SELECT language, CASE resolved WHEN 1 THEN 'success' WHEN 0 THEN 'failed' ELSE 'unknown' END AS outcome_label, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM {TRIALS} GROUP BY 1, 2")
def trial_summary_outcome(spark, d):
    return trials(spark, d).groupBy("language", t.outcome(F.col("resolved")).alias("outcome_label")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"SELECT language, count(DISTINCT harness) AS n_harnesses, count(*) AS n, round(avg(CASE WHEN resolved = 1 THEN 1.0 ELSE 0.0 END), 3) AS success_rate FROM {TRIALS} GROUP BY 1")
def trial_eda(spark, d):
    return trials(spark, d).groupBy("language").agg(F.countDistinct("harness").alias("n_harnesses"), F.count("*").alias("n"), ref_round(F.avg(F.when(F.col("resolved") == 1, 1.0).otherwise(0.0)), 3).alias("success_rate"))


@query(f"SELECT harness, count(*) AS n, round(100.0::DOUBLE * sum(CASE WHEN length(coalesce(text, '')) < 500 THEN 1 ELSE 0 END) / count(*), 2) AS pct_short FROM {TRIALS} GROUP BY 1")
def empty_text_rate(spark, d):
    short = F.length(F.coalesce("text", F.lit(""))) < 500
    return trials(spark, d).groupBy("harness").agg(F.count("*").alias("n"), percent(short, 2).alias("pct_short"))


@query(f"SELECT language, harness, count(*) AS n, {_SPLIT} FROM {TRIALS} GROUP BY 1, 2")
def summary_by_language(spark, d):
    """What refresh_summaries() in sources.views writes as a table."""
    df = trials(spark, d)
    return df.groupBy("language", "harness").agg(F.count("*").alias("n"), *t.resolved_split(df))


@query(f"""SELECT resolved, count(*) AS n,
  round(avg((instr(text, 'the ') > 0)::INT), 3) AS asserts_done, round(avg((instr(text, '.') > 0)::INT), 3) AS ran_test_in_tail,
  round(avg(CASE WHEN toxic IS NOT NULL THEN (toxic = 1)::INT END), 3) AS last_green_among_known, count(toxic) AS n_known
  FROM {TRIALS} GROUP BY 1""")
def flag_rates(spark, d):
    flags = trials(spark, d).select("resolved", (F.instr("text", "the ") > 0).alias("done"), (F.instr("text", ".") > 0).alias("tail"), (F.col("toxic") == 1).alias("green"))
    return flags.groupBy("resolved").agg(F.count("*").alias("n"), rate(F.col("done")).alias("asserts_done"), rate(F.col("tail")).alias("ran_test_in_tail"), rate(F.col("green")).alias("last_green_among_known"), F.count("green").alias("n_known"))


@query("""WITH j AS (SELECT doc_id, {'patch': {'files': (n_chars / 4.0)::VARCHAR, 'size': n_chars}} AS metadata FROM documents)
  SELECT doc_id, try_cast(metadata.patch.files AS INTEGER) AS files, metadata.patch.size AS size FROM j""")
def nested_struct_fields(spark, d):
    nested = table(spark, d, "documents").select("doc_id", F.struct(F.struct((F.col("n_chars") / 4.0).cast("string").alias("files"), F.col("n_chars").alias("size")).alias("patch")).alias("metadata"))
    return nested.select("doc_id", text_to_int(F.col("metadata.patch.files")).alias("files"), F.col("metadata.patch.size").alias("size"))


@query(r"""SELECT regexp_extract(url, '://([^/]+)/([^/]+)/', 1) AS site, regexp_extract(url, '://([^/]+)/([^/]+)/', 2) AS section, count(*) AS n FROM pages GROUP BY 1, 2""")
def path_segments(spark, d):
    part = [F.regexp_extract("url", "://([^/]+)/([^/]+)/", i) for i in (1, 2)]
    return table(spark, d, "pages").groupBy(part[0].alias("site"), part[1].alias("section")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, sum(try_cast(json_extract_string(props, '$.k') AS INTEGER))::BIGINT AS tokens, sum((json_extract(props, '$.missing') IS NULL)::INT)::BIGINT AS n_missing FROM events GROUP BY 1")
def json_props(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(text_to_int(F.get_json_object("props", "$.k"))).alias("tokens"), F.count_if(F.get_json_object("props", "$.missing").isNull()).alias("n_missing"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, ' the '))::BIGINT AS n_the, coalesce(list_aggregate(list_distinct(regexp_extract_all(lower(text), ' (an[a-z]+)', 1)), 'count'), 0)::BIGINT AS n_distinct_an FROM documents""")
def regex_occurrences(spark, d):
    docs = table(spark, d, "documents")
    found = F.regexp_extract_all(F.lower("text"), F.lit(" (an[a-z]+)"), F.lit(1))
    return docs.select("doc_id", F.regexp_count("text", F.lit(" the ")).cast("long").alias("n_the"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct_an"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first_id) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2) GROUP BY 1""")
def ordered_dedupe(spark, d):
    """Kinds in the order of their first events; only one row of each kind is brought together."""
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    in_order = F.transform(F.sort_array(F.collect_list(F.struct("first_id", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.concat_ws(",", in_order).alias("kinds"))


@query("""WITH d AS (SELECT doc_id, list_distinct(string_split(text, chr(10))) AS lines FROM documents WHERE doc_id >= 0)
  SELECT a.doc_id, round(len(list_intersect(a.lines, b.lines))::DOUBLE / len(list_distinct(list_concat(a.lines, b.lines))), 6) AS jaccard
  FROM d a JOIN d b ON b.doc_id = a.doc_id + 1""")
def line_jaccard(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.array_distinct(F.split("text", "\n")).alias("lines"))
    nxt = lines.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lines").alias("other"))
    return lines.join(nxt, "doc_id").select("doc_id", ref_round(features.jaccard(F.col("lines"), F.col("other")), 6).alias("jaccard"))


_ADDED = "len([x FOR x IN string_split({0}, chr(10)) IF starts_with(x, '+') AND NOT starts_with(x, '+++')])"
_PATCHES = r"""(SELECT a.doc_id, '+++ b/f' || chr(10) || regexp_replace(a.text, '(^|\n)([A-Z])', '\1+\2', 'g') AS patch, '+++ b/f' || chr(10) || regexp_replace(b.text, '(^|\n)([A-Za-z])', '\1+\2', 'g') AS gold
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"""


@query(f"""WITH n AS (SELECT doc_id, {_ADDED.format('patch')}::BIGINT AS n, {_ADDED.format('gold')}::BIGINT AS gold_n FROM {_PATCHES})
  SELECT doc_id, n, gold_n, round(CASE WHEN gold_n > 0 THEN n::DOUBLE / gold_n ELSE 0 END, 6) AS ratio, CASE WHEN gold_n > 0 THEN n::DOUBLE / gold_n ELSE 0 END < 0.6 AS small FROM n""")
def added_line_ratio(spark, d):
    """Added lines of one diff against those of another; a ratio below 0.6 passes."""
    docs = table(spark, d, "documents")
    head = F.lit("+++ b/f\n")
    ours = docs.select("doc_id", F.concat(head, F.regexp_replace("text", r"(^|\n)([A-Z])", "$1+$2")).alias("patch"))
    gold = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.concat(head, F.regexp_replace("text", r"(^|\n)([A-Za-z])", "$1+$2")).alias("gold"))
    n, gold_n = features.added_lines(F.col("patch")).cast("long"), features.added_lines(F.col("gold")).cast("long")
    share = F.when(F.col("gold_n") > 0, F.col("n").cast("double") / F.col("gold_n")).otherwise(0.0)
    return ours.join(gold, "doc_id").select("doc_id", n.alias("n"), gold_n.alias("gold_n")).withColumns({"ratio": ref_round(share, 6), "small": share < 0.6})


@query("""SELECT 'docs' AS source_id, doc_id::VARCHAR AS trial_id, n_chars / 100.0::DOUBLE AS cost_usd, NULL::BIGINT AS tokens, (n_chars > 1000) AS resolved FROM documents
  UNION ALL SELECT 'pages', page_id::VARCHAR, NULL, length(html), NULL FROM pages""")
def external_union(spark, d):
    docs = table(spark, d, "documents").select(F.lit("docs").alias("source_id"), F.col("doc_id").cast("string").alias("trial_id"), (F.col("n_chars") / 100.0).alias("cost_usd"), (F.col("n_chars") > 1000).alias("resolved"))
    pages = table(spark, d, "pages").select(F.lit("pages").alias("source_id"), F.col("page_id").cast("string").alias("trial_id"), F.length("html").cast("long").alias("tokens"))
    return union_by_name([docs, pages]).select("source_id", "trial_id", "cost_usd", "tokens", "resolved")


@query("""SELECT 'unlabeled' AS side, doc_id FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'unknown' AS side, doc_id FROM labels ANTI JOIN documents USING (doc_id)""")
def catalog_diff(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return docs.join(labels, "doc_id", "left_anti").select(F.lit("unlabeled").alias("side"), "doc_id").union(labels.join(docs, "doc_id", "left_anti").select(F.lit("unknown").alias("side"), "doc_id"))


@query("SELECT column_name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'VARCHAR' THEN 'string' ELSE lower(column_type) END AS data_type FROM (DESCRIBE SELECT * FROM documents)")
def schema_listing(spark, d):
    return stats.described(table(spark, d, "documents"))


_ORDER = "md5(concat_ws('-', doc_id, '42'))"


@query(f"SELECT doc_id, harness, resolved FROM (SELECT *, row_number() OVER (PARTITION BY harness ORDER BY {_ORDER}, doc_id) AS pos FROM {TRIALS}) WHERE pos <= 10")
def stratified_sample(spark, d):
    return stats.stratified(trials(spark, d).select("doc_id", "harness", "resolved"), "harness", "doc_id", 10)


@query(f"SELECT doc_id FROM documents ORDER BY {_ORDER}, doc_id LIMIT 50")
def random_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(stats.hash_order(F.col("doc_id")), "doc_id").limit(50)


@query("SELECT l_partkey AS task, count(*) AS n, ('0x' || substr(md5(concat_ws('-', l_partkey, '42')), 1, 8))::BIGINT % 100 < 80 AS train FROM lineitem GROUP BY ALL")
def grouped_split(spark, d):
    line = table(spark, d, "lineitem")
    return line.groupBy(F.col("l_partkey").alias("task")).agg(F.count("*").alias("n")).withColumn("train", stats.hash_share(F.col("task")) < 80)


@query(f"SELECT harness, doc_id, running FROM (SELECT harness, doc_id, sum(n_chars) OVER (PARTITION BY harness ORDER BY resolved DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM {TRIALS}) WHERE running <= 20000")
def budget_manifest(spark, d):
    return stats.budgeted(trials(spark, d), "harness", "n_chars", [F.desc("resolved"), "doc_id"], 20_000).select("harness", "doc_id", "running")


@query("""WITH x AS (SELECT try_cast(quality AS DOUBLE) AS q, n_chars, length(text) - length(replace(text, ' ', '')) AS spaces FROM documents JOIN labels USING (doc_id) WHERE quality IN (0, 1))
  SELECT 'n_chars' AS feature, round(corr(q, n_chars), 6) AS r FROM x UNION ALL SELECT 'spaces', round(corr(q, spaces), 6) FROM x""")
def pearson_corr(spark, d):
    rows = trials(spark, d).filter(F.col("resolved").isin(0, 1)).withColumn("spaces", F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))))
    return stats.pearson(rows, "resolved", ["n_chars", "spaces"])


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
  SELECT round(corr(a, b), 6) AS rho FROM r""")
def spearman_corr(spark, d):
    return stats.spearman(table(spark, d, "part"), "p_size", "p_retailprice")


_SHARE = "('0x' || substr(md5(concat_ws('-', doc_id, '42')), 1, 8))::BIGINT % 100"
_SPLIT_RATES = f"""t AS (SELECT *, {_SHARE} < 80 AS train FROM {TRIALS} WHERE resolved IN (0, 1)),
  m AS (SELECT harness, language, (sum(resolved) + 1)::DOUBLE / (count(*) + 2)::DOUBLE AS p FROM t WHERE train GROUP BY 1, 2),
  g AS (SELECT (sum(resolved) + 1)::DOUBLE / (count(*) + 2)::DOUBLE AS p0 FROM t WHERE train),
  h AS (SELECT t.*, coalesce(m.p, g.p0) AS p, g.p0 FROM t CROSS JOIN g LEFT JOIN m ON m.harness IS NOT DISTINCT FROM t.harness AND m.language IS NOT DISTINCT FROM t.language WHERE NOT train)"""


def _held_out(spark, d):
    """Held-out trials with p, the pass rate of their harness and language among the training trials, and p0, that of all of these."""
    labeled = trials(spark, d).filter(F.col("resolved").isin(0, 1)).withColumn("train", stats.hash_share(F.col("doc_id")) < 80)
    smoothed = (F.sum("resolved") + 1).cast("double") / (F.count("*") + 2).cast("double")
    train = labeled.filter("train")
    rates = train.groupBy(F.col("harness").alias("_h"), F.col("language").alias("_l")).agg(smoothed.alias("p"))
    held = labeled.filter("not train").join(F.broadcast(train.agg(smoothed.alias("p0"))))  # one row
    held = held.join(rates, F.col("harness").eqNullSafe(F.col("_h")) & F.col("language").eqNullSafe(F.col("_l")), "left")
    return held.withColumn("p", F.coalesce("p", "p0"))


@query(f"""WITH {_SPLIT_RATES}, r AS (SELECT resolved, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM h)
  SELECT round((sum(rk) FILTER (resolved = 1) - count(*) FILTER (resolved = 1) * (count(*) FILTER (resolved = 1) + 1) / 2.0) / nullif(count(*) FILTER (resolved = 1)::DOUBLE * count(*) FILTER (resolved = 0), 0), 6) AS auc FROM r""")
def held_out_auc(spark, d):
    """How well pass rates of the training trials rank the held-out ones."""
    return stats.auc(_held_out(spark, d), "resolved", "p")


@query(f"""WITH {_SPLIT_RATES} SELECT 'rates' AS model, count(*) AS n, round(-sum(CASE resolved WHEN 1 THEN ln(p) ELSE ln(1 - p) END), 4) AS nll FROM h
  UNION ALL SELECT 'baseline', count(*), round(-sum(CASE resolved WHEN 1 THEN ln(p0) ELSE ln(1 - p0) END), 4) FROM h""")
def held_out_likelihood(spark, d):
    """Negative log-likelihood of the held-out trials by two models of the training trials."""
    def nll(p: str):
        return ref_round(-F.sum(F.when(F.col("resolved") == 1, F.ln(p)).otherwise(F.ln(1 - F.col(p)))), 4)

    row = _held_out(spark, d).agg(F.count("*").alias("n"), nll("p").alias("rates"), nll("p0").alias("baseline"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("model"), "n", F.col(m).alias("nll")) for m in ("rates", "baseline")])).alias("x")).select("x.*")


@query("""WITH m AS (SELECT doc_id, (n_chars > 1500)::INT AS pred, quality FROM documents JOIN labels USING (doc_id))
  SELECT pred, quality, count(*) AS n FROM m GROUP BY 1, 2""")
def confusion_matrix(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy((F.col("n_chars") > 1500).cast("int").alias("pred"), "quality").agg(F.count("*").alias("n"))


@query()
def logistic_model(spark, d):
    rows = trials(spark, d).filter(F.col("resolved").isin(0, 1)).withColumn("spaces", F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))))
    return stats.logistic(rows, "resolved", ["n_chars", "spaces"]).select("feature", ref_round(F.col("coef"), 3).alias("coef"))


@query()
def logistic_top_features(spark, d):
    """The five features that tell most of a label by the absolute size of their standardized coefficients."""
    text = F.col("text")
    counts = {"spaces": " ", "commas": ",", "stops": r"\\.", "capitals": "[A-Z]", "digits": "[0-9]", "line_ends": "\\n"}
    rows = trials(spark, d).filter(F.col("resolved").isin(0, 1)).select("resolved", "n_chars", *[F.regexp_count(text, F.lit(p.replace("\\\\", "\\"))).alias(n) for n, p in counts.items()])
    top = stats.strongest(stats.logistic(rows, "resolved", ["n_chars", *counts]))
    return top.select("place", "feature", ref_round(F.col("coef"), 3).alias("coef"))


@query(f"""SELECT harness, language, count(*) AS n, round(avg(n_chars), 1) AS avg_chars FROM {TRIALS} GROUP BY 1, 2 HAVING max(resolved) >= 0""")
def labeled_combo_means(spark, d):
    return trials(spark, d).groupBy("harness", "language").agg(F.count("*").alias("n"), ref_round(F.avg("n_chars"), 1).alias("avg_chars"), F.max("resolved").alias("top")).filter("top >= 0").drop("top")


@query(f"""WITH c AS (SELECT harness, count(*) FILTER (resolved IN (0, 1)) AS n, count(*) FILTER (resolved = 1) AS k, sum(n_chars)::BIGINT AS chars FROM {TRIALS} GROUP BY 1)
  SELECT count(*) AS n_all, count(*) FILTER (k > 0 AND k < n) AS n_learnable, coalesce(sum(chars) FILTER (k = 0 OR k = n), 0)::BIGINT AS chars_removed FROM c""")
def learnability_strip(spark, d):
    cells = trials(spark, d).groupBy("harness").agg(F.count_if(F.col("resolved").isin(0, 1)).alias("n"), F.count_if(F.col("resolved") == 1).alias("k"), F.sum("n_chars").alias("chars"))
    learnable = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    return cells.agg(F.count("*").alias("n_all"), F.count_if(learnable).alias("n_learnable"), F.coalesce(F.sum(F.when((F.col("k") == 0) | (F.col("k") == F.col("n")), F.col("chars"))), F.lit(0)).alias("chars_removed"))


@query("""WITH v AS (SELECT doc_id % 50 AS task, CASE lang WHEN 'en' THEN 'executed' WHEN 'fr' THEN 'static' ELSE 'documentary' END AS tier, doc_id, n_chars > 1000 AS passed FROM documents)
  SELECT task, tier, doc_id, passed, row_number() OVER (PARTITION BY task ORDER BY CASE tier WHEN 'executed' THEN 1 WHEN 'static' THEN 2 ELSE 3 END, doc_id) AS tier_rank FROM v""")
def verdict_tiers(spark, d):
    tier = F.when(F.col("lang") == "en", "executed").when(F.col("lang") == "fr", "static").otherwise("documentary")
    rows = table(spark, d, "documents").select((F.col("doc_id") % 50).alias("task"), tier.alias("tier"), "doc_id", (F.col("n_chars") > 1000).alias("passed"))
    return tasks.top_tier(rows, ["task"], "tier", "doc_id").withColumn("tier_rank", F.col("tier_rank").cast("long"))
