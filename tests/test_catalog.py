"""The catalogue's lint with one gap of each kind, and the log of queries."""

import pytest
from test_functions import corpus_dir  # noqa: F401

from tracequarry.operators import features
from tracequarry.sources import catalog, corpus, query_log

SQL = {
    "a.sql": """-- CREATE VIEW commented AS SELECT 1; FROM nowhere
CREATE OR REPLACE VIEW raw AS SELECT *, 'FROM text' AS x FROM read_parquet('d/*.parquet', union_by_name=true);
create table Summary AS WITH part AS (SELECT * FROM raw), other AS MATERIALIZED (SELECT 1) SELECT * FROM part JOIN other USING (x) JOIN outside.t ON true;
/* CREATE TABLE hidden AS SELECT 1; */
CREATE VIEW loose AS SELECT * FROM lost, raw;
""",
    "sub/b.sql": "CREATE TEMP VIEW IF NOT EXISTS wrong_kind AS SELECT 1;\nCREATE VIEW raw AS SELECT * FROM Summary\n",
}
REGISTRY = [("raw", "view"), ("summary", "table"), ("outside.t", "external"), ("wrong_kind", "table"), ("gone", "view"), ("d/a.parquet", "parquet"), ("d/gone.parquet", "parquet"), ("both", "external"), ("both", "view")]


def test_schema_texts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in SQL.items():
        (tmp_path / name).write_text(text)
    got = sorted((r.name, r.kind, r.file.removeprefix(f"{tmp_path}/"), r.reads) for r in catalog.schema_objects(spark, str(tmp_path)).collect())
    assert got == [
        ("loose", "view", "a.sql", ["lost"]), ("raw", "view", "a.sql", []), ("raw", "view", "sub/b.sql", ["summary"]),
        ("summary", "table", "a.sql", ["outside.t", "raw"]), ("wrong_kind", "view", "sub/b.sql", []),
    ]


def test_one_gap_of_each_kind(spark, tmp_path):
    sql, data = tmp_path / "sql", tmp_path / "data"
    for name, text in SQL.items():
        (sql / name).parent.mkdir(parents=True, exist_ok=True)
        (sql / name).write_text(text)
    (data / "d").mkdir(parents=True)
    for name in ("a", "b"):
        (data / "d" / f"{name}.parquet").write_bytes(b"not read")
    spark.createDataFrame([(1,)], "x int").createOrReplaceTempView("raw")
    objects, files = catalog.schema_objects(spark, str(sql)), catalog.data_files(spark, str(data))
    registry = spark.createDataFrame(REGISTRY, "name string, kind string")
    got = sorted(map(tuple, catalog.lint(registry, objects, files).collect()))
    assert got == [
        ("both", "registered as several kinds"), ("both", "registered but not created"), ("d/b.parquet", "file not registered"), ("d/gone.parquet", "registered file is not there"), ("gone", "registered but not created"),
        ("loose", "created but not registered"), ("lost", "read by loose but made by nothing"), ("raw", f"created more than once, in {sql}/a.sql, {sql}/sub/b.sql"), ("wrong_kind", "registered as table but created as view"),
    ]
    here = catalog.lint(registry, objects, files, catalog.session_objects(spark)).filter("problem LIKE '%session%'").collect()
    assert sorted(r.name for r in here) == ["loose", "summary", "wrong_kind"]
    fine = spark.createDataFrame([("raw", "view")], "name string, kind string")
    assert catalog.lint(fine, objects.filter("name = 'raw' AND size(reads) = 0"), files.filter("false")).count() == 0


def test_a_log_of_what_came_out(spark, tmp_path):
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    got = query_log.run_observed(spark, "SELECT k, v FROM {t} WHERE k > 1", out, log, "some", {"v is known": "v IS NOT NULL", "v is not negative": "v >= 0", "k is small": "k < 10"}, t=rows)
    assert sorted(r.k for r in got.collect()) == [2, 3]
    with pytest.raises(Exception, match="nowhere"):
        query_log.run_observed(spark, "SELECT * FROM nowhere", out, log, "bad")
    query_log.run_observed(spark, "SELECT * FROM {t}", out, log, "some", t=rows)
    runs = {(r.name, r.n_rows): r for r in spark.read.parquet(log).collect()}
    assert runs["some", 2].violations == {"v is known": 1, "v is not negative": 2} and runs["some", 2].error is None and runs["some", 2].seconds > 0
    assert "nowhere" in runs["bad", None].error and runs["some", 3].violations == {}
    last = {r.name: (r.n_rows, r.n_runs, r.rows_gained) for r in query_log.latest_runs(spark, log).collect()}
    assert last == {"some": (3, 2, 1), "bad": (None, 1, None)}


def test_features_keep_their_rules(spark, corpus_dir, tmp_path):  # noqa: F811
    rows = features.proxy_features(corpus.read_trials(spark, str(corpus_dir)))
    query_log.run_observed(spark, "SELECT * FROM {t}", str(tmp_path / "out"), str(tmp_path / "log"), "features", query_log.FEATURE_RULES, t=rows)
    assert spark.read.parquet(str(tmp_path / "log")).first().violations == {}
