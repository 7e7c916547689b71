"""The queries over the operators, each over its whole table, and their SQL."""

import hashlib

from . import ann, exact_dedup, html_extract, jaccard_join, language_id, lm_scoring, merkle, mixing, packing, quality, sharding, url_filter, whitening
from .common import table


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file lies; every executor has the same installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chosen_path_jaccard(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op2_virtual_slot_sharding(spark, sf_dir):
    # Each table has a map of its own, which a later run over it goes on with.
    return sharding.shard_documents(spark, table(spark, sf_dir, "documents"), name=hashlib.md5(sf_dir.encode()).hexdigest())


def op3_attention_lm_scoring(spark, sf_dir):
    import public_tokenizers

    return lm_scoring.scored(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_nearest_centroid_language(spark, sf_dir):
    return language_id.identified(table(spark, sf_dir, "documents"))


def op5_hierarchical_mix(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op6_collision_counting_ann(spark, sf_dir):
    return ann.divisible_queries(table(spark, sf_dir, "embeddings"))


def op7_extendible_hash_dedup(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op8_redirect_url_filter(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages")).drop("inherited")


def op9_best_two_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_wrapper_html_extraction(spark, sf_dir):
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def op11_compensated_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_additive_quality_model(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_sparse_forest_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chosen_path_jaccard,
        op2_virtual_slot_sharding,
        op3_attention_lm_scoring,
        op4_nearest_centroid_language,
        op5_hierarchical_mix,
        op6_collision_counting_ann,
        op7_extendible_hash_dedup,
        op8_redirect_url_filter,
        op9_best_two_fit_packing,
        op10_wrapper_html_extraction,
        op11_compensated_whitening,
        op12_additive_quality_model,
        op13_sparse_forest_manifest,
    )
}


def pipeline(spark, sf_dir):
    import corpus_pipeline  # its stages come from this package, so it is imported when it is asked for

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

_BARE = r"regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1|br)>', ' ', 'g'), '</?b>', '', 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_entity}', '{_char}')"

#: A value as the manifest writes it, and the parity of a decimal id's CRC-32, bit by bit.
_TOLD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                         lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"""
_LEAF = f"sha256({' || '.join(_TOLD.format(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {{0}})"

ORACLE = {
    # For pages as the tables have them: one bare article of headings, paragraphs, breaks and bold text.
    "op10_wrapper_html_extraction": rf"""
        SELECT page_id, url, text, length(text) AS n_chars
        FROM (SELECT page_id, url, trim(regexp_replace({_BARE}, '\s+', ' ', 'g')) AS text FROM pages)
    """,
    # All pairs that share a shingle, compared exactly; classes by reachability.
    "op1_chosen_path_jaccard": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
          FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
        links AS (
          SELECT a, b, c = na.n AND c = nb.n AS equal
          FROM pairs JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 5 * c >= 4 * (na.n + nb.n - c)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        classes AS (SELECT a, min(b) AS class_id FROM reach GROUP BY 1),
        counts AS (SELECT a, count(*) AS n_links, count(*) FILTER (equal) AS n_equal FROM links GROUP BY 1)
        SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, 1 + coalesce(n_equal, 0)::BIGINT AS n_copies, coalesce(n.n, 0)::INT AS n_shingles
        FROM documents JOIN classes ON classes.a = doc_id LEFT JOIN counts ON counts.a = doc_id LEFT JOIN n USING (doc_id)
    """,
    # Water filling at each level, as in mixing.leaf_budgets; the order's key is an MD5, which DuckDB has too.
    "op5_hierarchical_mix": r"""
        WITH rows AS (
          SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
          FROM documents),
        placed AS (SELECT *, 'd' || (('0x' || substr(md5(source), 1, 6))::BIGINT % 3) AS domain FROM rows),
        leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, 2 * sum(n_tokens)::BIGINT AS cap FROM placed GROUP BY ALL),
        root AS (SELECT coalesce(sum(tokens), 0)::BIGINT * 0.5::DOUBLE AS budget FROM leaves),
        n1 AS (
          SELECT domain, sum(cap)::BIGINT AS cap, CASE domain WHEN 'd0' THEN 500 WHEN 'd1' THEN 300 WHEN 'd2' THEN 200 ELSE 100 END AS weight
          FROM leaves GROUP BY 1),
        l1 AS (
          SELECT *, cap::DOUBLE / weight AS ratio,
                 (budget - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
          FROM n1, root WINDOW b AS (ORDER BY cap::DOUBLE / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g1 AS (
          SELECT domain, CASE WHEN ratio <= level THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * (max(level) FILTER (WHERE ratio > level) OVER ())) END AS budget FROM l1),
        n2 AS (
          SELECT domain, lang, sum(cap)::BIGINT AS cap, CASE lang WHEN 'en' THEN 400 WHEN 'fr' THEN 250 WHEN 'de' THEN 200 WHEN 'es' THEN 150 ELSE 100 END AS weight
          FROM leaves GROUP BY 1, 2),
        l2 AS (
          SELECT *, cap::DOUBLE / weight AS ratio,
                 (budget - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER (PARTITION BY domain) - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
          FROM n2 JOIN g1 USING (domain) WINDOW b AS (PARTITION BY domain ORDER BY cap::DOUBLE / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g2 AS (
          SELECT domain, lang, CASE WHEN ratio <= level THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * (max(level) FILTER (WHERE ratio > level) OVER (PARTITION BY domain))) END AS budget FROM l2),
        l3 AS (
          SELECT domain, lang, source, tokens, cap, 100 AS weight, cap::DOUBLE / 100 AS ratio,
                 (budget - coalesce(sum(cap) OVER b, 0)) / (sum(100) OVER (PARTITION BY domain, lang) - coalesce(sum(100) OVER b, 0))::DOUBLE AS level
          FROM leaves JOIN g2 USING (domain, lang) WINDOW b AS (PARTITION BY domain, lang ORDER BY cap::DOUBLE / 100, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g3 AS (
          SELECT domain, lang, source, tokens, CASE WHEN ratio <= level THEN cap::DOUBLE ELSE least(cap::DOUBLE, weight * (max(level) FILTER (WHERE ratio > level) OVER (PARTITION BY domain, lang))) END AS leaf_budget FROM l3),
        plan AS (
          SELECT *, CASE WHEN tokens > 0 THEN floor(leaf_budget / tokens)::INT ELSE 1 END AS full_epochs FROM g3),
        offered AS (
          SELECT p.*, plan.leaf_budget, plan.tokens, plan.full_epochs, unnest(range(0, plan.full_epochs + 1))::INT AS epoch
          FROM placed p JOIN plan USING (domain, lang, source)),
        ordered AS (
          SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5(concat_ws('-', doc_id, '42', epoch)), doc_id
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM offered)
        SELECT doc_id, domain, lang, source, epoch, n_tokens, leaf_budget FROM ordered
        WHERE epoch < full_epochs OR (tokens > 0 AND before < leaf_budget - full_epochs * tokens)
    """,
    "op7_extendible_hash_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS n_points,
                 regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM n
        WINDOW w AS (PARTITION BY norm ORDER BY n_points DESC, doc_id)
    """,
    "op8_redirect_url_filter": r"""
        WITH RECURSIVE rules(verdict, rule, rhost, rpath) AS (VALUES
          ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
          ('block', 'net/de/', 'net', '/de/'), ('allow', 'example.net/de/8', 'example.net', '/de/8'),
          ('block', 'org/es/', 'org', '/es/')),
        p AS (
          SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest
          FROM pages),
        parts AS (
          SELECT page_id, html, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS node
          FROM p),
        tags AS (
          SELECT host, node, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*canonical[^>]*>')) AS tag FROM parts),
        links AS (
          SELECT node AS u, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*(?:\w+:)?//([^"''\s>#]+)', 1) AS v FROM tags),
        both_ways AS (SELECT u, v FROM links WHERE v <> '' UNION SELECT v, u FROM links WHERE v <> ''),
        reach(node, other) AS (
          SELECT u, u FROM both_ways UNION
          SELECT r.node, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
        ruled AS (
          SELECT parts.page_id, parts.node, arg_max(rules.rule, length(rules.rule)) AS rule, arg_max(rules.verdict, length(rules.rule)) AS verdict
          FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
          GROUP BY ALL),
        said AS (
          SELECT reach.node, CASE WHEN bool_or(ruled.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
          FROM reach JOIN ruled ON reach.other = ruled.node GROUP BY 1)
        SELECT parts.page_id, parts.host, parts.path, ruled.rule,
               coalesce(ruled.verdict, said.verdict, 'allow') AS verdict
        FROM parts LEFT JOIN ruled USING (page_id) LEFT JOIN said ON parts.node = said.node
    """,
    # Level by level from the leaves, then each leaf's way up.
    "op13_sparse_forest_manifest": f"""
        WITH RECURSIVE d AS (
          SELECT *, coalesce('s' || source, '') AS tree, {_LEAF.format(_TOLD.format('text'))} AS leaf,
                 CASE WHEN xor({_CRC}, 4294967295::BIGINT) % 2 = 0 THEN {_LEAF.format(_TOLD.format("replace(text, chr(10), '')"))} END AS changed
          FROM documents),
        base AS (
          SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS rid FROM d),
        nodes(tree, level, idx, n, digest) AS (
          SELECT tree, 0, idx, n, leaf FROM base UNION ALL
          SELECT tree, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 3, n),
        tops(level, idx, n, digest, tree) AS (
          SELECT 0, row_number() OVER (ORDER BY tree) - 1, count(*) OVER (), digest, tree FROM nodes WHERE n = 1 UNION ALL
          SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)), NULL FROM tops WHERE n > 1 GROUP BY level, idx // 3, n),
        beside AS (
          SELECT tree, level, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                 coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
          FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, idx // 3 ORDER BY idx)),
        top_beside AS (
          SELECT level, idx, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
                 coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
          FROM tops WHERE n > 1 WINDOW w AS (PARTITION BY level, idx // 3 ORDER BY idx)),
        up(rid, tree, level, idx, h, proof) AS (
          SELECT rid, tree, 0, idx, coalesce(changed, leaf), '' FROM base UNION ALL
          SELECT rid, up.tree, up.level + 1, up.idx // 3, sha256(l || h || r), proof || l || r FROM up JOIN beside b ON b.tree = up.tree AND b.level = up.level AND b.idx = up.idx),
        at_top AS (SELECT rid, tops.idx, h, proof FROM (SELECT * FROM up QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level DESC) = 1) u JOIN tops ON tops.tree = u.tree AND tops.level = 0),
        over(rid, level, idx, h, proof) AS (
          SELECT rid, 0, idx, h, proof FROM at_top UNION ALL
          SELECT rid, o.level + 1, o.idx // 3, sha256(l || h || r), proof || l || r FROM over o JOIN top_beside b ON b.level = o.level AND b.idx = o.idx),
        done AS (SELECT * FROM over QUALIFY row_number() OVER (PARTITION BY rid ORDER BY level DESC) = 1)
        SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = t.digest AS verified
        FROM base JOIN done USING (rid) JOIN nodes s ON s.tree = base.tree AND s.n = 1 JOIN tops t ON t.n = 1
    """,
}
