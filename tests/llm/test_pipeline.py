"""The pipeline on planted documents, and the registered queries on the smallest tables."""

import os
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

from oracle import same

import corpus_pipeline
from tracequarry.llm.queries import ORACLE, QUERIES, tokenizer_path
from tracequarry.llm.wordpieces import Words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = np.random.default_rng(9)
    en = [f"{a}{b}" for a in ("th", "wh", "sh", "st") for b in ("ing", "tion", "er", "and", "the")]
    fr = [f"{a}{b}" for a in ("é", "ou", "eau", "qu") for b in ("ment", "elle", "çon", "eux", "oi")]
    rows = []
    for i in range(120):
        vocabulary, lang = (en, "en") if i % 3 else (fr, "fr")
        rows.append((i, " ".join(map(str, rng.choice(vocabulary, int(rng.integers(40, 200))))), lang, f"s{i % 4}"))
    rows += [(200 + i, rows[i][1].replace(" ", " \n", 3), rows[i][2], rows[i][3]) for i in range(10)]  # equal but for white space
    rows += [(300 + i, rows[30 + i][1] + " extra", rows[30 + i][2], "s1") for i in range(10)]  # near copies
    rows += [(400, None, "en", "s0"), (401, "12 34", "en", "s0"), (402, "", None, None)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def test_pipeline(spark, tmp_path):
    rows = planted()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen, out = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = out
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes
    ids = {n: Counter(r.doc_id for r in df.select("doc_id").collect()) for n, df in seen.items()}
    clean = {i for i, *_ in rows} - {400, 401, 402}
    assert set(ids["language_id"]) == clean
    assert set(ids["exact_dedup"]) == clean - set(range(10))  # the longer original stays
    assert set(ids["ngram_jaccard_join"]) == clean - set(range(10)) - {300 + i for i in range(10)}
    mixed = ids["mix_to_weights"]
    assert set(mixed) < set(ids["ngram_jaccard_join"]) and max(mixed.values()) <= 2
    words, text = Words(tokenizer_path("word_bpe_49k.json")), {r[0]: r[1] for r in rows}
    pieces = defaultdict(int)
    for r in seen["best_fit_packing"].collect():
        pieces[r.doc_id] += r.length
    assert pieces == {i: n * (len(words.encode(text[i])) // 4 + 1) for i, n in mixed.items()}
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(again.select("doc_id", "piece", "ids_crc32").collect()) == Counter(seen["best_fit_packing"].select("doc_id", "piece", "ids_crc32").collect())


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, small, name):
    same(QUERIES[name](spark, small), ORACLE[name], small)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES


def test_stages_get_texts_in_bounded_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        kept = corpus_pipeline.keep_recognised(spark, spark.createDataFrame([(i, "the fox and the dog ran home again " * 9, "en", "a", 9) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long"), "")
        assert spark.conf.get(name) == corpus_pipeline.packing.BATCH_BYTES
        assert kept.count() == 20
    finally:
        spark.conf.set(name, before)
