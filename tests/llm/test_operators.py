"""The operators on small tables of awkward rows, against brute force."""

import ctypes
import hashlib
import pickle
import re
import resource
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracequarry.llm import ann, components, exact_dedup, html_extract, jaccard_join, language_id, lm_scoring, mixing, packing, sharding, url_filter, wordpieces
from tracequarry.llm.common import holding_memory
from tracequarry.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, vslot int, lang_pred string, node string, h string, chunk string, _block string"
EN = "The quick brown fox jumps over the lazy dog and then it runs through the green forest with the other animals of the wood. "
DE = "Der schnelle braune Fuchs springt über den faulen Hund und läuft dann durch den grünen Wald mit den anderen Tieren. "


def documents(spark, rows):
    """Documents with extra columns whose names clash with those that operators use inside."""
    full = [(i, t, lang, src, len(t) if t else None, 7, "x", "n", "h", "c", "b") for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


AWKWARD = [
    (0, EN * 3, "en", "a"), (1, EN * 3, "en", "a"), (2, EN * 3 + "one more word here", "en", "a"), (3, None, "en", None), (4, "", None, "b"),
    (5, " \t\n\x0b\x0c\r", "de", "b"), (6, DE * 4, "de", "b"), (7, DE * 4, None, None), (8, "123 456", "de", "b"), (9, "a", "en", "a"), (9, "a", "en", "a"),
    (10, "naïve café x 😀 é", "fr", "c"), (None, "orphan text without an id", "en", "c"), (11, EN * 900, "en", "a"), (12, EN.replace("fox", "cat") * 3, "en", "a"),
]


@pytest.fixture()
def docs(spark):
    return documents(spark, AWKWARD)


@pytest.fixture()
def none(spark):
    return documents(spark, [])


# --- 2 -------------------------------------------------------------------------------------------


def test_sharding(spark, docs, none):
    rows = sharding.shard_documents(spark, docs, n_shards=3, name="awkward").collect()
    assert len(rows) == len(AWKWARD)
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    texts = Counter((i, 8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, _, _ in AWKWARD)
    assert texts == Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert sharding.shard_documents(spark, none, name="none").count() == 0


def test_the_stored_map_goes_on(spark):
    """A later run takes the stored map; over more rows it edits it, and only rows of edited slots move."""
    rng = np.random.default_rng(8)
    rows = [(i, "x" * int(rng.integers(1, 900)), "en", "a") for i in range(3000)] + [(7, "same id", "en", "a")] * 300
    few, more = documents(spark, rows[:2000]), documents(spark, rows)

    def run(df):
        return [r for r in sharding.shard_documents(spark, df, n_shards=24, name="grows").collect()]

    first, again, then = run(few), run(few), run(more)
    assert {r.map_version for r in first} == {r.map_version for r in again} == {2} and {r.map_version for r in then} == {3}
    assert {(r.vslot, r.shard) for r in first} == {(r.vslot, r.shard) for r in again}
    old, new = dict((r.vslot, r.shard) for r in first), dict((r.vslot, r.shard) for r in then)
    assert sum(old[s] != new[s] for s in old.keys() & new.keys()) < 0.6 * len(old)  # id 7 has so many rows now that it has left its slot
    for result in (first, then):  # the law: shards of nearly equal bytes
        held, places = Counter(), defaultdict(list)
        for r in result:
            assert r.law == "bytes"
            held[r.shard] += r.size
            places[r.shard].append(r.slot)
        assert set(held) == set(range(24)) and max(held.values()) - min(held.values()) <= 0.02 * sum(held.values()) / 24
        assert all(sorted(p) == list(range(len(p))) for p in places.values())


@pytest.mark.parametrize("hot", [77, None])
def test_rows_of_one_id_are_spread(spark, hot):
    """An id, or no id, on a third of all bytes: shards are equal all the same, and rows of other ids stay where their ids say."""
    rng = np.random.default_rng(9)
    rows = [(1000 + i, "x" * int(rng.integers(1, 900)), "en", "a") for i in range(4000)]
    rows += [(hot, "y" * int(rng.integers(1, 900)), "en", "a") for i in range(2000)]
    got = sharding.shard_documents(spark, documents(spark, rows), n_shards=24, name=f"hot-{hot}").collect()
    held = Counter()
    for r in got:
        held[r.shard] += r.size
    assert len(got) == 6000 and max(held.values()) <= 1.02 * sum(held.values()) / 24 and len({r.vslot for r in got if r.doc_id == hot}) > 1000
    alone = {r.doc_id: r.vslot for r in sharding.shard_documents(spark, documents(spark, rows[:4000]), n_shards=24, name=f"cold-{hot}").collect()}
    assert all(alone[r.doc_id] == r.vslot for r in got if r.doc_id != hot)


def test_a_version_is_added_once(spark, tmp_path):
    shard, zero = sharding.initial_map(8, 3), np.zeros(8, np.int64)
    sharding.save_map(spark, str(tmp_path / "map"), 1, shard, zero, zero)
    sharding.save_map(spark, str(tmp_path / "map"), 2, shard, zero, zero)
    with pytest.raises(ValueError, match="has version 2"):
        sharding.save_map(spark, str(tmp_path / "map"), 2, shard, zero, zero)
    sharding.load_map(spark, str(tmp_path / "map"), 2).limit(3).write.parquet(str(tmp_path / "map" / "version=3"))  # not written whole
    sharding.save_map(spark, str(tmp_path / "map"), 3, shard, zero, zero)
    assert sharding.latest_map(spark, str(tmp_path / "map"), 8)[0] == 3


def test_the_query_gives_shards_of_nearly_equal_bytes(spark, small):
    from tracequarry.llm import queries

    held, largest = Counter(), 0
    for r in queries.op2_virtual_slot_sharding(spark, small).collect():
        held[r.shard] += r.size
        largest = max(largest, r.size)
    assert len(held) == 24 and max(held.values()) <= max(largest, 1.1 * sum(held.values()) / 24)


@given(st.lists(st.integers(0, 10_000), min_size=40, max_size=300), st.integers(2, 8))
@settings(max_examples=40, deadline=None)
def test_rebalanced_map(sizes, n):
    size = np.array(sizes, np.int64)
    first = sharding.initial_map(len(size), n)
    out = sharding.rebalanced(first, size, n)
    total, before = (np.bincount(m, weights=size, minlength=n) for m in (out, first))
    assert total.sum() == before.sum() and total.max() <= before.max()
    assert total.max() - total.min() <= max(sizes)
    more = sharding.grown(out, size, n)
    assert ((more == out) | (more == n)).all()
    high = int(np.argsort(total, kind="stable")[-1])
    for low in set(range(n)) - {high}:  # no move out of the fullest shard and no swap would help any more
        gap, theirs = total[high] - total[low], [0, *size[out == low]]
        assert not any(0 < a - b < gap for a in size[out == high] for b in theirs)


def test_rebalancing_equalises_and_moves_few():
    rng = np.random.default_rng(0)
    size = rng.lognormal(10, 1, 8192).astype(np.int64)
    first = sharding.initial_map(8192, 24)
    out = sharding.rebalanced(first, size, 24)
    total = np.bincount(out, weights=size)
    assert total.max() / total.mean() < 1.001 and (out != first).mean() < 0.3


def test_stored_map_and_shards(spark, docs, tmp_path):
    shard = sharding.initial_map(sharding.N_SLOTS, 3)
    zero = np.zeros(sharding.N_SLOTS, np.int64)
    sharding.save_map(spark, str(tmp_path / "map"), 1, shard, zero, zero)
    stored = sharding.load_map(spark, str(tmp_path / "map"), 1)
    assert stored.count() == sharding.N_SLOTS
    sharding.write_shards(docs, stored, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(AWKWARD)


# --- 7 -------------------------------------------------------------------------------------------


def keepers(rows):
    norm = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t, _, _ in rows]
    groups = defaultdict(list)
    for (i, t, _, _), n in zip(rows, norm, strict=True):
        groups[n].append((-len(t or ""), i is None, i or 0, i))
    return {n: (min(g)[3], len(g)) for n, g in groups.items()}, norm


def expected_dedup(rows):
    found, norm = keepers(rows)
    return Counter((i, *found[n], i == found[n][0], hashlib.sha256(n.encode()).hexdigest()) for (i, *_), n in zip(rows, norm, strict=True))


def dedup_rows(df, **kwargs):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.dedup(df, **kwargs).collect())


def test_exact_dedup(spark, docs, none):
    assert dedup_rows(docs, bucket_rows=2) == expected_dedup(AWKWARD)
    assert exact_dedup.dedup(none).count() == 0
    stay = exact_dedup.one_of_each(docs)
    assert stay.columns == docs.columns and stay.count() == len(keepers(AWKWARD)[0])


def test_texts_of_one_key_are_told_apart_by_their_bytes(spark, docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "key_of", lambda norm: F.pmod(F.length(norm), F.lit(2)).cast("long") * (1 << 62))
    assert dedup_rows(docs, bucket_rows=2) == expected_dedup(AWKWARD)  # two keys, with long chains, in buckets of all bits


def test_the_directory_deals_the_work(spark, docs, monkeypatch):
    """A directory without one of its buckets loses the copies in it."""
    whole = exact_dedup.directory
    key = docs.filter("doc_id = 0").select(exact_dedup.key_of(exact_dedup.stripped(F.col("text"))).alias("key"))

    def short(entries, bucket_rows):
        found = whole(entries, bucket_rows)
        held = key.crossJoin(found).filter(exact_dedup._prefix(F.col("key"), F.col("depth")) == F.col("bucket"))
        return found.join(held.select("depth", "bucket"), ["depth", "bucket"], "left_anti")

    monkeypatch.setattr(exact_dedup, "directory", short)
    lost = expected_dedup(AWKWARD) - dedup_rows(docs, bucket_rows=2)
    assert {r[0] for r in lost} >= {0, 1}


def test_directory_doubles_until_buckets_fit(spark):
    keys = [((i % 37) << 56) + i if i % 37 < 20 else (5 << 40) + i for i in range(3000)] + [-1 - i for i in range(50)] + [7 << 60] * 300
    rows = exact_dedup.directory(spark.createDataFrame([(k - (1 << 64) if k >= 1 << 63 else k,) for k in keys], "key long"), bucket_rows=40).collect()
    held = Counter()
    for k in keys:
        bits = f"{k % (1 << 64):064b}"
        mine = [(r.depth, r.bucket) for r in rows if r.depth == 0 or int(bits[: r.depth], 2) == r.bucket % (1 << 64)]
        assert len(mine) == 1  # each key has one bucket
        held[mine[0]] += 1
    assert held == {(r.depth, r.bucket): r.n for r in rows}
    assert all(n <= 40 or d == 64 for (d, _), n in held.items()) and max(held.values()) == 300
    parents = Counter((d - 1, (b % (1 << 64)) >> 1) for (d, b) in held)
    assert all(sum(1 for k in keys if int(f"{k % (1 << 64):064b}"[:d] or "0", 2) == b) > 40 for d, b in parents)  # no bucket is deeper than it has to be
    assert exact_dedup.directory(spark.createDataFrame([], "key long")).count() == 0


# --- 8 -------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, node string, root string, rule string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def test_url_rules_and_aliases(spark):
    link = '<html><head><link rel="canonical" href="{}"></head></html>'
    rows = [
        (1, "http://A.example.com/en/123?x#y", None), (2, "https://b.example.com/en/7x", ""), (3, "http://example.net/de/81", "<p>"), (4, "http://x.net/de/8", None),
        (5, "http://x.org/fr/1", link.format("http://A.example.com/en/123?x")), (6, "http://x.org/fr/2", "<META HTTP-EQUIV='refresh' CONTENT='0; url=/fr/1'>"),
        (7, "http://x.org/fr/3", link.format("http://b.example.com/en/7x")), (8, "http://x.org/fr/3#top", None), (9, None, None), (10, "no scheme/en/", None),
        (11, "http://notcom/en/", None), (12, "http://x.org/es", None), (12, "http://x.org/es/", None), (13, "http://x.org/a/b", link.format("c")), (14, "http://x.org/a/c", link.format("//www.x.org/es/1")),
    ]
    got = {(r.page_id, r.path): r for r in url_filter.judged(pages(spark, rows)).collect()}
    verdicts = {k[0]: r.verdict for k, r in got.items()}
    assert got[1, "/en/123"].host == "a.example.com" and got[1, "/en/123"].rule == "com/en/"
    assert [verdicts[i] for i in (1, 2, 3, 4)] == ["block", "allow", "allow", "block"]
    assert [verdicts[i] for i in (5, 6)] == ["block", "block"]  # aliases, one of them at two steps
    assert [verdicts[i] for i in (7, 8)] == ["allow", "allow"]
    assert [verdicts[i] for i in (9, 10, 11)] == ["allow"] * 3 and got[9, ""].host == ""
    assert got[12, "/es"].verdict == "allow" and got[12, "/es/"].rule == "org/es/"
    assert [verdicts[i] for i in (13, 14)] == ["block", "block"]  # relative and scheme-less links
    assert url_filter.judged(pages(spark, [])).count() == 0
    log = spark.createDataFrame([("http://x.org/fr/9", "http://y.com/en/1")], "from_url string, to_url string")
    assert url_filter.judged(pages(spark, [(1, "http://x.org/fr/9", None)]), log).first().verdict == "block"


def test_each_rule_gives_its_contracts_verdict(spark):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    rows = [(i, f"http://www.{rule}1", None) for i, (rule, _) in enumerate(rules)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(pages(spark, rows)).collect()}
    assert got == dict(enumerate(rules))


def test_allowed_alias_takes_precedence(spark):
    link = '<link href="{}" rel=canonical>'
    rows = [(1, "http://x.org/1", link.format("http://a.com/en/1")), (2, "http://x.org/1?q", link.format("http://x.org/1")), (3, "http://x.org/2", link.format("http://x.org/1") + link.format("http://example.com/en/7"))]
    assert {r.verdict for r in url_filter.judged(pages(spark, rows)).collect()} == {"allow"}


@pytest.mark.parametrize("unit", ["<link canonical ", "<link rel=canonical href=", "<meta refresh url=  ", "<link rel='canonical\" ", "<", "canonical>", "<link " + "x" * 50, "rel = ", "<link rel"])
def test_links_are_read_in_linear_time(spark, unit):
    html = unit * (1_000_000 // len(unit))
    df = pages(spark, [(1, "http://x.org/fr/9", html), (2, "http://x.org/fr/9", html + ">"), (3, "http://x.org/fr/9", "<link " + html.replace(">", "") + ">"), (4, "http://x.org/fr/8", html + '"><link href=/en rel="x canonical y">')])
    began = time.time()
    url_filter.page_links(df).collect()
    assert time.time() - began < 20


def test_links_of_many_shapes(spark):
    html = [
        '<LINK REL = "Canonical" HREF = " /a?x=1&amp;y=2#z ">', "<link href='/b' data-rel=canonical><link rel=canonical href=/c>", '<link title="a>b" rel=canonical href=/no>', "<meta content='5;URL=/d;x' http-equiv=refresh>",
        "<meta http-equiv=Refresh content=\"0; url='/e'\">", '<linker rel=canonical href=/no><meta name=refresh content="url=/no">', "<link rel=canonical>", "<link rel=canonical href=/f", '<link rel="canonical" rel="x" href="/g" href="/no">',
    ]
    got = {r.u: r.v for r in url_filter.page_links(pages(spark, [(i, f"http://h.org/p{i}", x) for i, x in enumerate(html)])).collect()}
    assert got == {f"h.org/p{i}": f"h.org/{v}" for i, v in ((0, "a?x=1&y=2"), (1, "c"), (3, "d"), (4, "e"), (8, "g"))}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5080)]
    root = list(range(6000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges + [(None, 3)], "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 -------------------------------------------------------------------------------------------


def similar(rows):
    """(class, links) of each row by comparing all pairs of shingle sets."""
    sets = []
    for _, t, _, _ in rows:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set())
    n = len(rows)
    near = [[i != j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    out, ids = [], [jaccard_join.NULL_ID if r[0] is None else r[0] for r in rows]
    for i in range(n):
        seen, front = {i}, [i]
        while front:
            a = front.pop()
            new = {j for j in range(n) if near[a][j]} - seen
            seen |= new
            front += new
        out.append((ids[i], min(ids[j] for j in seen), sum(map(bool, near[i])), len(sets[i])))
    return Counter(out)


def test_jaccard_join(spark, docs, none):
    got = Counter((r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in jaccard_join.join(docs).collect())
    assert got == similar(AWKWARD)
    assert jaccard_join.join(none).count() == 0
    assert jaccard_join.one_of_each(docs).columns == docs.columns


def test_recall_of_paths_that_reach_the_last_level():
    """Pairs at the threshold whose buckets stay large down to the last level share a bucket there with chance RECALL."""
    rng, n, runs = np.random.default_rng(1), 3000, jaccard_join.runs_for(jaccard_join.RECALL)
    tokens = []
    for _ in range(n):
        x = rng.integers(1, 1 << 63, 50, dtype=np.uint64)
        tokens += [jaccard_join.min_tokens(x[:45]).tobytes(), jaccard_join.min_tokens(x[5:]).tobytes()]  # 40 of 50 are shared
    rows = pd.DataFrame({"path": 0, "node": np.arange(2 * n)})
    for level in range(jaccard_join.DEPTH):
        rows["tokens"] = [tokens[x] for x in rows["node"]]
        rows = next(jaccard_join._children(iter([rows]), runs, level))
        if level == 0:
            single = [next(jaccard_join._children(iter([pd.DataFrame({"path": 0, "node": np.arange(2 * n), "tokens": tokens})]), r, 0)) for r in range(1, runs + 1)]
            drawn = np.diff([0] + [len(x) for x in single])
            assert drawn.min() > n  # every run draws for most sets
            assert rows["path"].is_unique is False and len(rows) == len(single[-1])
    rows["pair"] = rows["node"] // 2
    found = rows.groupby(["path", "pair"])["node"].nunique()
    found = found[found == 2].reset_index()["pair"].nunique()
    print("recall at the last level:", found / n, "runs:", runs)
    assert found >= n - 9  # 3 are expected to be lost at most


def test_jaccard_join_of_large_classes(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    base = [str(x) for x in rng.choice(words, 150)]
    rows = []
    for i in range(230):  # more than a bucket may hold, at many similarities
        text = list(base)
        for at in rng.choice(150, rng.integers(0, 6), replace=False):
            text[at] = f"x{rng.integers(50)}"
        rows.append((i, " ".join(text), "en", "a"))
    rows += [(1000 + i, " ".join(map(str, rng.choice(words, 80))), "en", "a") for i in range(60)]
    old = jaccard_join.BLOCK
    try:
        jaccard_join.BLOCK = 64  # a class of several blocks
        got = Counter((r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in jaccard_join.join(documents(spark, rows)).collect())
    finally:
        jaccard_join.BLOCK = old
    assert got == similar(rows)


# --- 3 -------------------------------------------------------------------------------------------


@pytest.fixture()
def small_model(monkeypatch):
    monkeypatch.setattr(lm_scoring, "LEAST_WINDOWS", 300)
    monkeypatch.setattr(lm_scoring, "EPOCHS", 1)


def test_lm_scoring(spark, docs, none, small_model):
    import public_tokenizers

    args = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = lm_scoring.scored(docs, *args).collect()
    words = [(t or "").encode().lower().split() for _, t, _, _ in AWKWARD]
    training = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in AWKWARD]
    c, n_docs = Counter(), sum(training)
    for w, yes in zip(words, training, strict=True):
        c.update(w if yes else [])
    n, v = sum(c.values()) + n_docs, len(c) + 1
    expected = Counter()
    for (i, *_), w, yes in zip(AWKWARD, words, training, strict=True):
        base = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w) + np.log10((n_docs + 1) / (n + v + 1))
        expected[i, not yes, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base, 6)] += 1
    assert expected == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert lm_scoring.scored(none, *args).count() == 0


def slow_score(learnt, subwords, text):
    """A text's score one word, window and id at a time."""
    m = {k: v.astype(np.float64) for k, v in learnt["model"].items()}
    words = [w.decode("utf-8", "replace") for w in lm_scoring.words_of(text)]
    pieces = [subwords.encode(" " + w) for w in words]
    known = learnt["known"]
    read = [lm_scoring.END] + [int(known[i]) for p in pieces for i in p]
    after = read[1:] + [lm_scoring.END]
    chance, starting = [], []
    for start, end, first in lm_scoring.windows_of(len(read)):
        out = lm_scoring._forward(m, np.array([read[start:end]]))["out"][0]
        for at in range(first, end):
            by_class = np.exp(out[at - start] @ m["cls"] + m["cls_b"])
            c, i = divmod(after[at], lm_scoring.MEMBERS)
            inside = np.exp(out[at - start] @ m["mem"][c] + m["mem_b"][c])
            chance.append(by_class[c] / by_class.sum() * inside[i] / inside.sum())
            starting.append(by_class[: lm_scoring.STARTS].sum() / by_class.sum())
    total, at, pairs, begins = 0.0, 0, learnt["pairs"], learnt["begins"]
    for word, ids in zip([*words, None], [*pieces, []], strict=True):
        n = max(1, len(ids))
        rare = [np.exp(learnt["rare_log"][i]) for i in ids] or [1.0]
        spelled = np.prod([chance[at + k] * rare[k] for k in range(n)]) / starting[at]
        paired = np.prod([float(pairs[read[at + k], after[at + k]]) * rare[k] for k in range(n)])
        paired = paired / begins[read[at]] if begins[read[at]] > 0 else 0.0
        if word is not None:
            spelled *= starting[at + n]
            paired *= float(begins[read[at + n]])
        part = lm_scoring.PAIRS if begins[read[at]] > 0 else 0.0
        share = learnt["counts"].get(word, 0) / learnt["n_all"]
        total += np.log10(lm_scoring.MIX * share + (1 - lm_scoring.MIX) * ((1 - part) * spelled + part * paired))
        at += n
    return total


def test_lm_scores_are_those_of_the_slow_scorer(spark, docs, small_model, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(lm_scoring, "SCORE_IDS", 3000)
    monkeypatch.setattr(lm_scoring, "SCORE_BATCH", 4)
    monkeypatch.setattr(lm_scoring, "SOFTMAX_BATCH", 7)
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 50_000)  # the long text is a block of its own
    args = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    learnt, subwords = lm_scoring.prepared(docs, *args)[2], lm_scoring.Subwords(*args)
    counts = Counter()
    for i, t, *_ in AWKWARD:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(w.decode() for w in lm_scoring.words_of(t))
            counts[None] += 1
    learnt["counts"] = counts
    want = sorted((str(i), round(slow_score(learnt, subwords, t), 2)) for i, t, *_ in AWKWARD)
    got = sorted((str(r.doc_id), r.score) for r in lm_scoring.scored(docs, *args).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert all(abs(a - b) < 0.02 + 1e-4 * abs(b) for (_, a), (_, b) in zip(got, want, strict=True)), (got, want)


def test_lm_context_is_learnt_from_every_training_document(spark, small_model):
    """What many documents say of a word's context counts; word counts are the same."""
    import public_tokenizers

    args = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(i, "green river over the old stone bridge at night", "en", "a") for i in range(40)]
    held = [i for i in range(40, 70) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows += [(held[0], "green river over the old stone bridge at night", "en", "a"), (held[1], "night at bridge stone old the over river green", "en", "a")]
    got = {r.doc_id: r for r in lm_scoring.scored(documents(spark, rows), *args).collect()}
    seen, turned = got[held[0]], got[held[1]]
    assert seen.held_out and turned.held_out and abs(seen.base_score - turned.base_score) < 1e-9
    assert seen.score > turned.score + 2
    assert seen.score > np.log10((1 - lm_scoring.MIX) * lm_scoring.PAIRS) * 10  # each word, and the end, always follows the one before it


def test_every_training_text_gives_a_window():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 2, 40, 1500, 5000, 33, 1])
    heads = np.cumsum(sizes) - sizes
    stream = np.arange(sizes.sum() + 1)
    for each in (1, 10):
        found = lm_scoring.training_windows(stream, heads, sizes, each, rng)
        of = np.searchsorted(heads, found[:, 0], "right") - 1
        assert np.bincount(of).tolist() == [max(1 + n // 1024, min(n // 32, each)) for n in sizes]
        assert found.shape[1] == lm_scoring.CONTEXT + 1 and (np.diff(found, axis=1) >= 0).all()


@pytest.mark.parametrize("n", [1, 32, 33, 34, 5000])
def test_every_id_of_a_stream_is_foretold_once(n):
    stream = np.arange(n + 1)
    found = lm_scoring.whole_windows(stream)
    targets = found[:, 1:].reshape(-1)
    assert targets[:n].tolist() == stream[1:].tolist() and (targets[n:] == n).all() and len(targets) - n < lm_scoring.CONTEXT
    assert (found[:, 0] == stream[: n : lm_scoring.CONTEXT]).all()


def test_the_model_is_trained_on_whole_texts(spark, small_model, monkeypatch):
    """All ids of a long training text go through training, none of a held-out one."""
    import public_tokenizers

    args = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(held, "zebra " * 500, "en", "a"), (held + 1000, "river stone " * 3000, "en", "a")]
    assert zlib.crc32(str(held + 1000).encode()) % 7 != 2
    blocks, _, _ = lm_scoring.prepared(documents(spark, rows), *args)
    subwords = lm_scoring.Subwords(*args)
    want = subwords.encode(" river stone" * 3000)
    streams = [lm_scoring.stream_of(pickle.loads(r.data), subwords.size) for r in blocks.collect()]
    assert sorted(x for s in streams for x in lm_scoring.whole_windows(s)[:, 1:].reshape(-1).tolist() if x != subwords.size) == sorted(want)
    monkeypatch.setattr(lm_scoring, "trained", lambda m, some, *_: {k: v * 0 + len(some) for k, v in m.items()})
    uniform = np.full(lm_scoring.IDS, 1 / lm_scoring.IDS)
    model = lm_scoring.fit(blocks, 1 << 20, np.zeros(subwords.size + 1, np.int64), uniform)
    assert abs(model["far"].max() * lm_scoring.ROUNDS * lm_scoring.CONTEXT - len(want)) < lm_scoring.ROUNDS * lm_scoring.CONTEXT


def test_averaging_by_levels(spark):
    rng = np.random.default_rng(1)
    models, n = rng.random((40, 7)).astype("<f4"), rng.integers(1, 9, 40)
    rows = spark.createDataFrame([(i, int(k), m.tobytes()) for i, (m, k) in enumerate(zip(models, n, strict=True))], "part int, n long, model binary")
    assert np.abs(lm_scoring._averaged(rows, 40) - np.average(models, axis=0, weights=n)).max() < 1e-6
    m = lm_scoring.new_model()
    assert all((lm_scoring.unpacked(lm_scoring.packed(m))[k] == v).all() for k, v in m.items())


@given(st.lists(st.one_of(st.none(), st.text(st.characters(codec="utf-8"), max_size=20), st.sampled_from([" a\x0bB \t", "\x1c x\x85y\u00a0z", "", " "])), max_size=6))
@settings(max_examples=100, deadline=None)
def test_word_lists(texts):
    words, n = lm_scoring.word_lists(pa.array(texts, pa.string()))
    assert n.tolist() == [len(lm_scoring.words_of(t)) for t in texts]
    assert words.cast(pa.binary()).to_pylist() == [w for t in texts for w in lm_scoring.words_of(t)]


def test_pair_chances_sum_to_one():
    """Over all words of one subword: ids 2 and 3 start words, END is the end; nothing is spelled with more."""
    stream = np.array([0, 2, 3, 3, 2, 0, 3, 2, 2, 0])
    pairs = np.bincount(stream[:-1] * lm_scoring.IDS + stream[1:], minlength=lm_scoring.IDS**2).reshape(lm_scoring.IDS, -1)
    learnt = {"pairs": pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1), "begins": pairs.sum(axis=1) > 0}
    for before in (2, 3):
        def chance(*then, before=before):
            return lm_scoring.pair_chances(np.array([0, before, *then])[: len(then) + 1], np.array([before, *then]), np.ones(len(then) + 1), np.arange(len(then) + 1), learnt)[0]

        words = [chance(x, 0)[1] for x in (2, 3)]
        assert abs(sum(words) + chance(0)[1] - 1) < 1e-6


def test_windows_score_each_id_once():
    for n in (1, 31, 32, 33, 56, 57, 1000):
        found = lm_scoring.windows_of(n)
        assert [x for s, e, f in found for x in range(f, e)] == list(range(n))
        assert all(e - s <= lm_scoring.CONTEXT and (f - s >= lm_scoring.OVERLAP or s == 0) for s, e, f in found)


def test_chances_sum_to_one_and_tables_agree():
    m = lm_scoring.tables(lm_scoring.new_model(5))
    ids = np.random.default_rng(1).integers(0, 1024, (3, 20))
    slow = lm_scoring._forward(m, ids)["out"]
    padded = np.zeros((3, lm_scoring.STEP), np.int64)
    padded[:, :20] = ids
    fast = np.concatenate([h for _, h in lm_scoring.hidden_states(m, padded.reshape(-1), np.arange(3) * lm_scoring.STEP)]).reshape(3, lm_scoring.STEP, -1)[:, :20]
    assert np.abs(slow - fast).max() < 1e-4
    state = np.repeat(slow[0, -1:], 1024, axis=0)
    log, start = lm_scoring.log_chances(m, state, np.arange(1024), np.arange(1024))
    assert abs(np.exp(log).sum() - 1) < 1e-4
    assert abs(np.exp(log[: lm_scoring.STARTS * lm_scoring.MEMBERS]).sum() - np.exp(start[0])) < 1e-4
    later = ids.copy()
    later[:, 12:] = 5
    assert np.abs(lm_scoring._forward(m, later)["out"][:, :12] - slow[:, :12]).max() < 1e-6  # no id sees a later one


def test_members_of_all_classes_are_worked_out_together(monkeypatch):
    m = {k: v.astype(np.float64) for k, v in lm_scoring.new_model(2).items()}
    m["mem_b"] = np.random.default_rng(4).random(m["mem_b"].shape)
    ids = np.random.default_rng(3).integers(0, 300, (7, 33))
    seen, softmax = [], lm_scoring._softmax
    monkeypatch.setattr(lm_scoring, "_softmax", lambda x: seen.append(len(x)) or softmax(x))
    loss, g = lm_scoring._gradient(m, ids[:, :-1], ids[:, 1:])
    assert len(seen) == 2  # before, once for each class
    hidden, want = lm_scoring._forward(m, ids[:, :-1])["out"].reshape(-1, lm_scoring.WIDTH), ids[:, 1:].reshape(-1)
    slow, mem = 0.0, np.zeros_like(m["mem"])
    for h, w in zip(hidden, want, strict=True):
        c, e = divmod(int(w), lm_scoring.MEMBERS)
        of_class, of_member = np.exp(h @ m["cls"] + m["cls_b"]), np.exp(h @ m["mem"][c] + m["mem_b"][c])
        slow -= (np.log(of_class[c] / of_class.sum()) + np.log(of_member[e] / of_member.sum())) / len(want)
        mem[c] += np.outer(h, of_member / of_member.sum() - (np.arange(lm_scoring.MEMBERS) == e)) / len(want)
    assert abs(loss - slow) < 1e-6
    assert np.abs(g["mem"] - mem).max() < 1e-7


def test_what_depends_on_the_id_is_worked_out_once_for_each(monkeypatch):
    m, ids = lm_scoring.new_model(2), np.random.default_rng(3).integers(0, 50, (7, 33))
    rows, rms = [], lm_scoring._rms
    monkeypatch.setattr(lm_scoring, "_rms", lambda x: rows.append(x.size // lm_scoring.WIDTH) or rms(x))
    f = lm_scoring._forward(m, ids[:, :-1])
    assert rows == [len(np.unique(ids[:, :-1])), 7 * 32, 7 * 32]  # before, the first was 7 * 32, too
    y = rms(m["embed"][ids[:, :-1]])[0]
    assert np.abs(f["k"] - y @ m["k"]).max() < 1e-5 and np.abs(f["q"] - y @ m["q"] / lm_scoring.WIDTH**0.5).max() < 1e-5


def test_sums_by_number():
    rng = np.random.default_rng(5)
    of = np.concatenate([rng.integers(0, 90, 400), np.full(17, 7), np.full(300, 95), np.full(16, 97), [99]])
    rng.shuffle(of)
    rows = rng.random((len(of), 5))
    for numbers in (of, of[:1], np.full(40, 3), np.arange(40)):
        several, sums = lm_scoring._sums(rows[: len(numbers)], np.argsort(numbers, kind="stable"), np.bincount(numbers, minlength=100))
        assert sorted(several) == sorted(set(numbers.tolist()))
        assert all(np.abs(x - rows[: len(numbers)][numbers == i].sum(axis=0)).max() < 1e-9 for i, x in zip(several, sums, strict=True))


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "mallopt"), reason="another C library")
def test_training_keeps_its_memory_at_hand():
    """Batches do not take their arrays' pages from the system again; afterwards what is free goes back."""
    windows = np.random.default_rng(6).integers(0, 1024, (lm_scoring.BATCH * 10, 33))
    with holding_memory():
        lm_scoring.trained(lm_scoring.new_model(), windows, 0.0, 0.5)
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
        lm_scoring.trained(lm_scoring.new_model(), windows, 0.0, 0.5)
        assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 2000  # without, 16,000


def test_gradient():
    m = {k: v.astype(np.float64) for k, v in lm_scoring.new_model(1).items()}
    ids = np.random.default_rng(0).integers(0, 1024, (3, 11))
    _, g = lm_scoring._gradient(m, ids[:, :-1], ids[:, 1:])
    for k in m:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was, loss = m[k][at], []
        for d in (1e-4, -1e-4):
            m[k][at] = was + d
            loss.append(lm_scoring._gradient(m, ids[:, :-1], ids[:, 1:])[0])
        m[k][at] = was
        assert abs((loss[0] - loss[1]) / 2e-4 - g[k][at]) < 2e-3 * max(0.05, abs(g[k][at])) + 1e-5, k


# --- 4 -------------------------------------------------------------------------------------------


def test_language_id(spark, none):
    rows = [(i, (EN if i % 2 else DE)[i % 7 :] + f" {i}", "en" if i % 2 else "de", "a") for i in range(80)]
    rows += [(100, None, "en", "a"), (101, "12 34 !", "en", "a"), (102, "", None, None), (103, DE * 9000, None, "a"), (104, "字" * 50, "en", "a"), (104, EN, None, "a"), (None, EN, "en", "a")] + [(105, EN, "en", "a")] * 30
    got = defaultdict(list)
    for r in language_id.identified(documents(spark, rows)).collect():
        got[r.doc_id].append(r)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und")
    assert all(got[i][0].lang_pred == ("en" if i % 2 else "de") for i in range(80))
    assert [got[i][0].lang_pred for i in (100, 101, 102, 103)] == ["und", "und", "und", "de"]
    assert not any(r.rejected for i in range(80) for r in got[i])
    assert language_id.identified(none).count() == 0
    assert {r.lang_pred for r in language_id.identified(documents(spark, [(1, EN, None, None)])).collect()} == {"und"}
    model = language_id.train(documents(spark, rows))
    kept = language_id.recognised(documents(spark, rows), model)
    assert kept.columns == documents(spark, rows).columns and {r.doc_id for r in kept.collect()} >= set(range(80))
    assert not {100, 101, 102} & {r.doc_id for r in kept.collect()}


def test_all_languages_are_learned(spark, monkeypatch):
    """Also the 200th, and one of a single document; more of them than a model can hold are an error."""
    rng = np.random.default_rng(11)
    words = {f"l{k:03}": ["".join(chr(0x4E00 + 40 * k + int(c)) for c in rng.integers(0, 40, 3)) for _ in range(30)] for k in range(200)}
    rows = [(1000 * k + i, " ".join(rng.choice(words[lang], 25)), lang, "a") for k, lang in enumerate(words) for i in range(6 if k else 1)]
    got = {r.doc_id: r for r in language_id.identified(documents(spark, rows)).collect()}
    taught = {lang for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    assert len(taught) >= 199 and {r.lang_pred for r in got.values()} == taught
    assert np.mean([got[i].lang_pred == lang for i, _, lang, _ in rows if lang in taught]) > 0.95
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 100)
    with pytest.raises(ValueError, match="values of lang"):
        language_id.identified(documents(spark, rows))


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_k_means_is_the_slow_one(n):
    rng = np.random.default_rng(n)
    vectors = np.abs(rng.normal(size=(n, 12))).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    chosen = [int(np.random.default_rng(5).integers(n))]
    while len(chosen) < min(3, n):
        chosen.append(min(range(n), key=lambda i: max(float(vectors[i] @ vectors[c]) for c in chosen)))
    centres = [vectors[c].astype(float) for c in chosen]
    for _ in range(12):
        of = [max(range(len(centres)), key=lambda c: float(v @ centres[c])) for v in vectors]
        for c in range(len(centres)):
            mine = [v.astype(float) for v, o in zip(vectors, of, strict=True) if o == c]
            if mine:
                centres[c] = sum(mine) / np.linalg.norm(sum(mine))
    assert np.abs(language_id._k_means(vectors, 3, 5) - np.stack(centres)).max() < 1e-5


def test_slices_count_like_the_whole(monkeypatch):
    letters = language_id._letter_table()
    for text in ((EN + DE) * 3, "  .. a", "ΟΔΟΣ σας 12 x", "😀 𝒳𝒴 z.", "a" * 40, ". " * 30 + "q"):
        whole = language_id._counts(text, letters)
        for n in (1, 2, 3, 7, 100):
            monkeypatch.setattr(language_id, "SLICE", n)
            assert (language_id._counts(text, letters) == whole).all()
        monkeypatch.undo()


def slow_grams(text):
    """N-gram hashes by Python numbers, one at a time."""
    low, out = 0xFFFFFFFF, Counter()
    runs = re.sub(r"[^\W\d_]+|.", lambda m: m[0] if m[0].isalpha() else "\0", text.lower(), flags=re.S)
    marks = [0 if c == "\0" else ord(c) for c in re.sub("\0+", "\0", f"\0{runs}\0")]
    for i, c in enumerate(marks):
        found = []
        if c:
            found.append(c * 0x9E3779B1)
        if i >= 1:
            p = marks[i - 1] * 0x9E3779B1 & low
            found.append((((p ^ p >> 15) * 0x85EBCA77 & low) + c) * 0x27D4EB2F)
        if i >= 2:
            p = marks[i - 2] * 0x9E3779B1 & low
            q = ((p ^ p >> 15) * 0x85EBCA77 & low) + marks[i - 1] & low
            found.append((((q ^ q >> 13) * 0xC2B2AE3D & low) + c) * 0x165667B1)
        for h in found:
            h &= low
            out[((h ^ h >> 16) * 0x2C1B3C6D & low) >> 20] += 1
    return out if any(marks) else None


def test_language_id_is_that_of_the_slow_version(spark):
    """Weights, cosines and rejection of every row, from n-grams counted in plain Python."""
    rng = np.random.default_rng(7)  # no two of the rows share a cell of the sample
    rows = [(i, " ".join(map(str, rng.choice((EN if i % 3 else DE).split(), 12))), "en" if i % 3 else "de", "a") for i in range(60)]
    rows += [(200, "zzz qqq xxx jjj", None, "a"), (201, "字" * 30, None, "a"), (202, EN[:40] + DE[:40], None, "a"), (203, "7 8", "en", "a"), (None, EN, "de", "a")]
    table = documents(spark, rows)
    model = language_id.train(table.filter(language_id.in_training()))
    counts = [slow_grams(t) for _, t, _, _ in rows]
    training = [i is None or zlib.crc32(str(i).encode()) % 4 != 2 for i, *_ in rows]
    known = [c for c, (_, _, lang, _), yes in zip(counts, rows, training, strict=True) if yes and lang and c]
    idf = {d: np.log((1 + len(known)) / (1 + sum(d in c for c in known))) + 0.1 for d in range(language_id.DIMS)}
    assert all(abs(model["idf"][d] - w) < 1e-5 for d, w in idf.items())

    def unit(c):
        v = np.zeros(language_id.DIMS)
        for d, n in c.items():
            v[d] = np.log1p(n) * idf[d]
        return v / np.linalg.norm(v)

    own = {lang: [unit(c) for c, (_, _, x, _), yes in zip(counts, rows, training, strict=True) if yes and x == lang and c] for lang in ("de", "en")}
    centres = [(model["langs"][o], c.astype(float)) for o, c in zip(model["owner"], model["centres"], strict=True)]
    for lang, least in zip(model["langs"], model["least"], strict=True):
        near = [max(v @ c for x, c in centres if x == lang) for v in own[lang]]
        assert abs(np.quantile(near, 0.01) - least) < 1e-4
    got = sorted(((str(r.doc_id), r.lang_pred, round(r.score, 3), r.rejected) for r in language_id.identified(table).collect()))
    want = []
    for (i, *_), c in zip(rows, counts, strict=True):
        score, lang = max(((unit(c) @ v, x) for x, v in centres), default=(0.0, "und")) if c else (0.0, "und")
        want.append((str(i), lang, score, not c or score < language_id.REJECT_SHARE * model["least"][model["langs"].index(lang)]))
    want.sort()
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert all(abs(g[2] - w[2]) < 2e-3 for g, w in zip(got, want, strict=True))
    assert any(w[3] for w in want) and not all(w[3] for w in want)


# --- 5 -------------------------------------------------------------------------------------------


def shared_out(budget, children):
    """{name: given} by filling up children of (weight, cap) until nothing moves."""
    given, open_ = dict.fromkeys(children, 0.0), {k for k, (w, _) in children.items() if w > 0}
    left = budget
    while open_ and left > 1e-9:
        total = sum(children[k][0] for k in open_)
        full = {k for k in open_ if children[k][1] - given[k] <= left * children[k][0] / total + 1e-12}
        if not full:
            for k in open_:
                given[k] += left * children[k][0] / total
            break
        for k in full:
            left -= children[k][1] - given[k]
            given[k] = children[k][1]
        open_ -= full
    return given


@given(st.integers(0, 3000), st.lists(st.tuples(st.integers(1, 9), st.integers(0, 900)), min_size=1, max_size=7))
@settings(max_examples=15, deadline=None)
def test_sharing_out(spark, budget, children):
    rows = [(float(budget), f"c{i}", w, c) for i, (w, c) in enumerate(children)]
    df = spark.createDataFrame(rows, "budget double, child string, weight long, cap long")
    got = {r.child: r.given for r in mixing._shared_out(df, [], "child").collect()}
    want = shared_out(budget, {f"c{i}": x for i, x in enumerate(children)})
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


@pytest.mark.parametrize("range_rows", [0, 100_000])
def test_mixing(spark, docs, none, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)  # 0: down to the key's last digits
    rng = np.random.default_rng(3)
    rows = AWKWARD + [(1000 + i, "w " * int(rng.integers(1, 60)), str(rng.choice(["en", "fr", "de"])), f"s{rng.integers(4)}") for i in range(300)]
    table = documents(spark, rows)
    got = mixing.mix_report(table).collect()
    tokens = {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t, _, _ in rows}
    leaves, taken = defaultdict(list), defaultdict(list)
    for i, t, lang, src in rows:
        leaves[lang or "(none)", src or "(none)"].append(i)
    budgets = {}
    for r in got:
        assert r.n_tokens == tokens[r.doc_id]
        taken[r.lang, r.source, r.epoch].append(r.doc_id)
        budgets[r.lang, r.source] = r.leaf_budget
    for leaf, ids in leaves.items():
        supply = sum(tokens[i] for i in ids)
        if leaf not in budgets:
            continue
        full = int(budgets[leaf] // supply) if supply else 1
        for epoch in range(full):
            assert Counter(taken[*leaf, epoch]) == Counter(ids)
        before, expected = 0, []
        key = {i: hashlib.md5(f"{'null' if i is None else i}-42-{full}".encode()).hexdigest() for i in ids}
        for i in sorted(set(ids), key=lambda i: (key[i], i)):
            if supply and before < budgets[leaf] - full * supply:
                expected += [i] * ids.count(i)
            before += tokens[i] * ids.count(i)
        assert Counter(taken[*leaf, full]) == Counter(expected), leaf
    total = sum(tokens[i] for i, *_ in rows)
    assert sum(budgets.values()) <= 0.5 * total + 1e-6
    assert mixing.mixed(none).count() == 0
    assert set(table.columns) <= set(mixing.mixed(table).columns)
    assert mixing.mixed(docs.withColumn("epoch", F.lit("e"))).columns.count("epoch") == 1


def test_whole_rows_with_names_used_inside(spark, docs):
    names = ["_id", "_no_id", "_text_sha", "row", "_domain", "_full", "_cut_key", "_kept", "epoch", "leaf_budget", "doc_id_"]
    wide = docs.withColumns({n: F.lit("own") for n in names})
    for stage in (exact_dedup.one_of_each, jaccard_join.one_of_each, mixing.taken):
        out, plain = stage(wide), stage(docs)
        assert out.columns == wide.columns
        assert out.filter(" or ".join(f"`{n}` != 'own'" for n in names)).count() == 0
        assert sorted(out.select(docs.columns).collect(), key=str) == sorted(plain.collect(), key=str)


# --- 6 -------------------------------------------------------------------------------------------


def test_ann(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    x[:40] = x[0]  # many copies
    rows = [(i, [float(v) for v in x[i]], "c", 0) for i in range(3000)]
    rows += [(4000, None, "c", 0), (4020, [0.0] * 16, "c", 0), (4040, [float("nan")] * 16, "c", 0), (4060, [None] + [1.0] * 15, "c", 0), (4080, [], "c", 0), (4100, [1.0, 2.0], "c", 0), (None, [1.0] * 16, "c", 0), (2980, [float(v) for v in x[2980]], "c", 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string, dim int")
    got = defaultdict(list)
    usable = ann.usable(df)
    for r in ann.nearest(usable, usable.filter("vec_id % 20 = 0"), block=700, query_block=60).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))  # the two-component query has no candidate
    ids, hits = np.append(np.arange(3000), 2980), 0
    data = np.concatenate([x, x[2980:2981]]).astype(np.float64)
    for q, found in got.items():
        score = data @ data[q]
        best = np.lexsort((ids, -np.where(ids == q, -np.inf, score)))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(v != q for _, v, _ in found)
        assert all(abs(s - x[v].astype(np.float64) @ x[q].astype(np.float64)) < 1e-9 for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len(set(ids[best]) & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    few = ann.usable(df.filter("vec_id < 5"))
    assert ann.nearest(few, few.filter("vec_id = 0")).count() == 4
    assert ann.nearest(few, few.filter("vec_id = 77")).count() == 0


def test_recall_in_a_large_block():
    """With the share of a block that is asked for at scale, which no floor raises."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 32))
    for x in (rng.standard_normal((16_000, 64)), np.repeat(centres, 400, axis=0) + 0.6 * rng.standard_normal((16_000, 32))):
        index, queries = ann.BlockIndex(x), x[::400]
        least = int(ann.ENOUGH * len(x))
        assert least > 16 * 20
        index.ask(queries)
        hits = 0
        for number, q in enumerate(queries):
            score = x @ q
            best = np.argsort(-score, kind="stable")[:20]
            hits += np.isin(best, index.candidates(number, least)).sum()
        assert hits / (20 * len(queries)) >= 0.9


# --- 9 -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def words():
    return wordpieces.Words(tokenizer_path("word_bpe_49k.json"))


@given(st.text(st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_word_ids_are_the_tokenizers(words, text):
    assert np.frombuffer(words.encode(text), "<u4").tolist() == words.slow.encode(text, add_special_tokens=False).ids


@given(st.lists(st.sampled_from(["don't", "it's", "l'été", "naïve,", "x1y2", "(a)", "...", "ÀÉ", "straße", "İstanbul", "we've--gone", "3.14", "thntblere", "<|endoftext|>"]), max_size=12))
@settings(max_examples=100, deadline=None)
def test_plain_words(words, parts):
    test_word_ids_are_the_tokenizers.hypothesis.inner_test(words, " \n".join(parts))


def test_slices_end_at_white_space(words, monkeypatch):
    text = (EN + DE) * 5
    whole = words.encode(text)
    monkeypatch.setattr(wordpieces, "SLICE", 50)
    assert words.encode(text) == whole


@given(st.lists(st.integers(1, 100), max_size=200))
@settings(max_examples=100, deadline=None)
def test_best_two_fit(lengths):
    size = np.array(lengths, np.int64)
    bins, places = packing.best_two_fit(size, 100)
    used = defaultdict(list)
    for n, b, p in zip(lengths, bins, places, strict=True):
        used[b].append((p, n))
    for items in used.values():
        at = 0
        for p, n in sorted(items):
            assert p == at
            at += n
        assert at <= 100
    assert len(used) <= max(1.25 * sum(lengths) / 100 + 1, sum(n > 50 for n in lengths) + sum(lengths) / 100 + 1)


def slow_best_two_fit(lengths, capacity):
    """Bins of item numbers: fill greedily with the longest that fits, then try every pair of waiting items in the place of the smallest."""
    waiting, bins = list(range(len(lengths))), []
    while waiting:
        held, gap = [], capacity
        while fits := [i for i in waiting if lengths[i] <= gap]:
            best = max(fits, key=lambda i: (lengths[i], -i))
            held.append(best)
            waiting.remove(best)
            gap -= lengths[best]
        if gap and len(held) > 1:
            small = min(held, key=lambda i: (lengths[i], i))
            room = gap + lengths[small]
            sums = [lengths[i] + lengths[j] for i in waiting for j in waiting if i < j and lengths[i] + lengths[j] <= room]
            if sums and max(sums) > lengths[small]:
                bins.append((held, small, max(sums), room))
                return bins, waiting  # the first exchange: both ways may take other items of the same lengths from here
        bins.append((held, None, None, None))
    return bins, waiting


@given(st.lists(st.integers(1, 100), max_size=40))
@settings(max_examples=150, deadline=None)
def test_best_two_fit_is_the_slow_one_up_to_its_first_exchange(lengths):
    bins, _ = packing.best_two_fit(np.array(lengths, np.int64), 100)
    for number, (held, small, pair, _) in enumerate(slow_best_two_fit(lengths, 100)[0]):
        mine = sorted(lengths[i] for i in np.flatnonzero(bins == number))
        if small is None:
            assert mine == sorted(lengths[i] for i in held)
        else:
            assert sum(mine) == sum(lengths[i] for i in held) - lengths[small] + pair and len(mine) == len(held) + 1


def slowest_best_two_fit(lengths, capacity):
    """Bins of item numbers, all exchanges: of items of one length the first waits in front, and one that was given back before it."""
    waiting, bins = {}, []
    for i in range(len(lengths)):
        waiting.setdefault(lengths[i], []).append(i)
    waiting = {n: items[::-1] for n, items in waiting.items()}
    while any(waiting.values()):
        held, gap = [], capacity
        while fits := [n for n, items in waiting.items() if items and n <= gap]:
            held.append((max(fits), waiting[max(fits)].pop()))
            gap -= held[-1][0]
        if gap and len(held) > 1:
            small = min(held)
            pairs = [(a + b, -a, a, b) for a in waiting for b in waiting if a <= b and len(waiting[a]) > (a == b) and waiting[b] and a + b <= gap + small[0]]
            if pairs and max(pairs)[0] > small[0]:
                held.remove(small)
                held += [(n, waiting[n].pop()) for n in max(pairs)[2:]]
                waiting[small[0]].append(small[1])
        bins.append([i for _, i in held])
    return bins


@given(st.lists(st.one_of(st.integers(1, 100), st.integers(20, 45)), max_size=60))
@settings(max_examples=150, deadline=None)
def test_best_two_fit_is_the_slow_one_to_the_end(lengths):
    bins, places = packing.best_two_fit(np.array(lengths, np.int64), 100)
    for number, held in enumerate(slowest_best_two_fit(lengths, 100)):
        assert [i for i in sorted(np.flatnonzero(bins == number), key=lambda i: places[i])] == held
        assert [places[i] for i in held] == [sum(lengths[j] for j in held[:k]) for k in range(len(held))]


def test_two_better_than_the_smallest():
    bins, _ = packing.best_two_fit(np.array([60, 30, 25, 15]), 100)
    assert bins[0] == bins[2] == bins[3] != bins[1]  # 60 + 30 leaves 10; 25 + 15 take the place of 30


def test_packing(spark, docs, none, words):
    rows = packing.packed(packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), capacity=64), capacity=64).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(by_doc[i]) == sorted(p for j, t, *_ in AWKWARD if j == i for p in cut(words.encode(t))) for i, *_ in AWKWARD)
    for items in by_sequence.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack_documents(none, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_texts_come_to_the_tokenizer_in_bounded_batches(spark):
    def told(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": [0], "piece": [0], "start": [b.nbytes], "length": [1], "ids_crc32": [b.num_rows]}, schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32"))]))

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    long = spark.range(40).coalesce(1).select(F.expr(f"repeat('x', {1 << 20})").alias("text"))
    rows = packing.packed(long.mapInArrow(told, packing.PIECES)).collect()
    assert sum(r.ids_crc32 for r in rows) == 40
    assert max(r.start for r in rows) < 8 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def cut(ids):
    ids += b"\0\0\0\0"
    return [(k, k * 64, len(ids[k * 256 : k * 256 + 256]) // 4, zlib.crc32(ids[k * 256 : k * 256 + 256])) for k in range(-(-len(ids) // 256))]


# --- 10 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<script>x<p>y</script>", ""), ("<p>a<br>b</p>c", "a b c"), ("<article>x<b>y</b> z</article>w", "xy z"),
        ("<nav>m</nav><main><h1>T &amp; U</h1><p>one\n two</p><aside>s</aside><form>f</form></main><footer>f</footer>", "T & U one two"),
        ("<div id=cookie-notice>c</div><p class='ad'>x<p>body<div class='comments'><p>no</div>", "body"), ("<body><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("<div class='no-sidebar'><p>kept</p></div><!-- <p>gone --><p hidden>h</p>", "kept"), ("<article>a</article><article class='comment'>c</article>", "a"), ("a<b c", "a<b c"), ("<p>&#233;&nbsp;x</p>", "é x"),
        ('<article><div class="side-effects">one</div><div id="related-work">two</div><p class="notice-period">three</p></article>', "one two three"),
        ('<article>a<div class="ad-slot-2">b</div><div class="commentList">c</div><div class="cookie_banner">d</div></article>', "a"),
        ('<article>a<img src="data:' + "A" * 100_000 + '"><img alt="a > b" src="y">c</article>', "ac"), ("<div>" * 600 + "<nav>menu</nav><article>text</article>side" + "</div>" * 600, "text"),
        ("<b>" * 3000 + "<i><article>text</article>" + "</b>" * 3000 + "<nav>menu</nav>", "text"), ("<article>a<b><section>b</b>c</section>d</article>", "a bc d"),
        ("<article>a" + "".join(f'<div class="{c}">no</div>' for c in ("comments-section", "post-comments", "user-comments", "comment-body", "google-ads", "adsbygoogle", "cookie-policy-bar", "newsletter-signup-form", "sidebar-primary")) + "</article>", "a"),
        ("<article>" + "".join(f'<div class="{c}">{c}</div>' for c in ("cookie-recipe", "no-sidebar", "with-ads", "share-price", "commentary")) + "</article>", "cookie-recipe no-sidebar with-ads share-price commentary"),
        ('<p>a<a title="x > y" href=z>b</a></p><!-- c', "ab"), ('<p title="open>a</p><p>b', "a b"), ("<![CDATA[x]]>a<?php b ?>c<", "ac<"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("unit", ["<a ", "<a '", "<a '>\"", "<div>", "<ul><li>", "<", "<a<a", "<a \"'>'\"", "<!--", "<script>", "</p>", "<a x=1 ", "<a '>\"<b \">'", "<b></i>", "<p hidden><b>", "<li><b>", "<b><div></b>"])
def test_reading_takes_linear_time(unit):
    began = time.process_time()
    for end in ("", ">", "'>", '">'):
        html_extract.main_text(unit * (300_000 // len(unit)) + end)
    assert time.process_time() - began < 15


SITE = "<html><body><div>Site name</div><ul>{}</ul>{}<p>{}</p></body></html>"


def test_wrapper_inference():
    made = [SITE.format("".join(f"<li>{x}</li>" for x in items), extra, body) for items, extra, body in ((["a", "b"], "", "one"), (["c", "d", "e"], "<b>new</b>", "two"), (["f"], "", "three"))]
    wrapper = html_extract.infer(made)
    for p in made:
        assert html_extract._takes(wrapper, html_extract.stream(p), 0) == len(html_extract.stream(p))
        tokens = html_extract.stream(p)
        assert len(html_extract.read(html_extract.marked(wrapper, set()), tokens)) == sum(t[0] == '"' for t in tokens)  # every text is taken
    assert any(isinstance(x, list) and x[0] == "+" for x in wrapper) and any(isinstance(x, list) and x[0] == "?" for x in wrapper)
    assert html_extract.literals(wrapper) == {'"-Site name'}
    assert html_extract.main_text(made[1]) == "Site name c d e new two"
    assert html_extract.main_text(made[1], html_extract.marked(wrapper, {'"-Site name'})) == "c d e new two"


def test_the_wrapper_decides_what_is_kept():
    """Also on a page with an article of its own: what a wrapper's items say goes, up to what none of them takes."""
    page = "<html><body><nav>menu</nav><article><h1>{0}</h1><p>text {0}</p></article></body></html>"
    wrapper = html_extract.marked(html_extract.infer([page.format(1), page.format(2)]), set())

    def turned(items, what):
        return [[x[0], what] if not isinstance(x, str) and not html_extract._is_group(x) else x for x in items]

    other = page.format(3).replace("</article>", "<pre>more</pre></article>")
    assert html_extract.main_text(other, wrapper) == "3 text 3 more"
    assert html_extract.main_text(other, turned(wrapper, html_extract.DROP)) == "more"
    assert html_extract.main_text(other, turned(wrapper, html_extract.KEEP)) == "menu 3 text 3 more"
    # A page without an article keeps what stands in no region, whatever region its host's other pages have.
    assert html_extract.main_text("<html><body><nav>menu</nav><p>plain</p></body></html>", wrapper) == "plain"


ARTICLE = "<html><body><nav>menu {0}</nav><article><h1>Title {0}</h1><p>{1}</p><p>Leave your comment below</p></article></body></html>"


def test_an_inferred_wrapper_takes_template_out_of_articles(spark):
    """A line that all of a host's articles have goes; what copies share stays, and so does a line of few articles or of most of one."""
    body = lambda i: " ".join(f"word{i}x{k}" for k in range(40))
    made = [(i, f"http://all.com/{i}", ARTICLE.format(i, body(i))) for i in range(12)] + [(100 + i, f"http://seven.com/{i}", ARTICLE.format(i, body(i))) for i in range(7)]
    made += [(200 + i, f"http://copies.com/{i}", ARTICLE.format(i, body("same"))) for i in range(12)]
    made += [(300 + i, f"http://some.com/{i}", ARTICLE.format(i, body(i)) if i < 10 else ARTICLE.format(i, body(i)).replace("Leave your comment below", f"line {i}")) for i in range(40)]
    made += [(400 + i, f"http://short.com/{i}", ARTICLE.format(i, f"few {i}")) for i in range(12)]
    got = {r.page_id: r.text for r in html_extract.extracted(pages(spark, made)).collect()}
    for i, _, page in made:
        whole = html_extract.main_text(page)
        assert got[i] == (whole.removesuffix(" Leave your comment below") if i < 100 else whole) and whole.startswith("Title")


def test_extraction(spark):
    page = "<html><body><div>Site name</div><p>text {}</p></body></html>"
    rows = [(i, f"http://h.com/{i}", page.format(i)) for i in range(30)] + [(90, None, page.format(90)), (91, "http://one.com/", page.format(91)), (91, "http://one.com/", None)]
    rows += [(200 + i, "http://copies.com/", page.format("copy")) for i in range(20)]  # one page, however often, is no sample
    # Two pages of twenty share a text that is no template; the sample may have them both.
    rows += [(300 + i, f"http://few.com/{i}", f"<html><body><div>{'shared' if i < 2 else f'own {i}'}</div><p>text {i}</p></body></html>") for i in range(20)]
    got = Counter((r.page_id, r.text, r.n_chars) for r in html_extract.extracted(pages(spark, rows)).collect())
    want = Counter((i, f"text {i}", len(f"text {i}")) for i in range(30)) + Counter([(90, "Site name text 90", 17), (91, "Site name text 91", 17), (91, "", 0)])
    want += Counter((200 + i, "Site name text copy", 19) for i in range(20)) + Counter((300 + i, t := f"{'shared' if i < 2 else f'own {i}'} text {i}", len(t)) for i in range(20))
    assert got == want
    assert html_extract.extracted(pages(spark, [])).count() == 0


def test_a_literal_of_the_sample_is_template_only_if_most_pages_have_it(spark):
    page = "<html><body><div>{}</div><p>text {}</p></body></html>"
    made = {i: page.format("shared", i) for i in range(12)}
    hashes = {r.i: r.h for r in spark.createDataFrame(list(made.items()), "i long, html string").select("i", F.xxhash64("html", F.lit(3)).alias("h")).collect()}
    sampled = sorted(made, key=hashes.get)[:2]
    few = [(i, f"http://h.com/{i}", made[i]) for i in sampled]
    assert {r.page_id: r.text for r in html_extract.extracted(pages(spark, few)).collect()} == {i: f"text {i}" for i in sampled}
    more = few + [(100 + i, f"http://h.com/{i}", page.format(f"own {i}", i)) for i in range(8)]
    assert {r.text for r in html_extract.extracted(pages(spark, more)).collect()} == {f"shared text {i}" for i in sampled} | {f"own {i} text {i}" for i in range(8)}
