"""The manifest against a whole tree built at once."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD, documents

from tracequarry.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proofs(leaves):
    """Of each leaf of one tree: the siblings' texts (left, right) level by level; and the root."""
    level, ways, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, here in enumerate(at):
            first = here // 3 * 3
            ways[i].append(("".join(level[first:here]), "".join(level[here + 1 : first + 3])))
            at[i] = here // 3
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return ways, level[0]


def slow_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((r[0] is not None, r[0] or 0, told(r), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {name: (leaves := sorted(by_source[name], key=lambda x: x[:3]), *proofs([x[2] for x in leaves])) for name in names}
    tops, root = proofs([trees[name][2] for name in names])
    out = []
    for name, top in zip(names, tops, strict=True):
        leaves, ways, subroot = trees[name]
        for (_, _, leaf, r), way in zip(leaves, ways, strict=True):
            hurt = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            h = told((*r[:4], r[4].replace("\n", ""))) if hurt else leaf
            for left, right in way + top:
                h = sha(left + h + right)
            out.append((r[0], leaf, subroot, root, sha("".join(x + y for x, y in way + top)), h, h == root))
    return Counter(out)


@pytest.mark.parametrize(("part_rows", "fan"), [(1, 2), (2, 3), (5, 16), (None, 16)])
def test_manifest_of_awkward_rows(spark, part_rows, fan):
    docs = documents(spark, AWKWARD).withColumns({c: F.lit("clash") for c in ("key", "tree", "digest", "part", "at", "salt", "level")})
    got = Counter(tuple(r) for r in merkle.manifest(docs, part_rows, fan).collect())
    want = slow_manifest([(i, s, lang, len(t) if t else None, t) for i, t, lang, s in AWKWARD])
    assert got == want
    assert {r[6] for r in got} == {True, False}  # some texts have line ends to lose


def test_uneven_sources_over_many_parts(spark):
    rng = random.Random(5)
    rows = [(i, f"src{0 if rng.random() < 0.5 else rng.randrange(40)}", "en", i, f"text\n{i}" * (i % 3)) for i in range(400)]
    rows += [(7, "hot", "en", 1, "again and again")] * 150 + [(None, None, None, None, None)] * 20 + [(900 + i, f"żródło {i}", None, 0, "") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert Counter(tuple(r) for r in merkle.manifest(docs, 23, 2).collect()) == slow_manifest(rows)


def test_no_rows(spark):
    assert merkle.manifest(documents(spark, [])).collect() == []


def test_a_fragment_keeps_its_ends_only():
    tree = merkle.Tree(1000)
    tree.levels[0] = {i: bytes([i % 256] * 32) for i in range(100, 900)}
    opened, made = tree.resolve()
    assert all(sum(1 for x in opened if x[0] == level) <= 2 * (merkle.ARITY - 1) for level in range(8)) and len(made) > 350


def test_any_grouping_of_merges_gives_the_same_forest():
    rng = random.Random(3)
    for n in (1, 2, 3, 4, 26, 27, 28, 100):
        whole = merkle.Tree(n)
        whole.levels[0] = {i: hashlib.sha256(b"%d" % i).digest() for i in range(n)}
        leaves = dict(whole.levels[0])
        whole.resolve()
        root = whole.path(0, n // 2)
        cuts = sorted(rng.sample(range(n + 1), min(n, 7)))
        pieces = [[(0, i) for i in range(a, b)] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        fragments = [{(0, i): leaves[i] for _, i in p} for p in pieces]
        while len(fragments) > 1:  # neighbours or not, in any order
            a, b = (fragments.pop(rng.randrange(len(fragments))) for _ in range(2))
            tree = merkle.Tree(n)
            for (level, i), d in (a | b).items():
                tree.levels[level][i] = d
            opened, _ = tree.resolve()
            top = {(level, i) for level, here in tree.levels.items() for i in here if tree.width(level) == 1}
            fragments.append({k: tree.levels[k[0]][k[1]] for k in opened | top})
        if n > 1:
            assert list(fragments[0].values()) == [merkle.folded(leaves[n // 2], *root)]


def test_proofs_lead_to_the_root(spark):
    docs = documents(spark, AWKWARD)
    made = merkle.Manifest(docs, 3, 2)
    rows = slow_manifest([(i, s, lang, len(t) if t else None, t) for i, t, lang, s in AWKWARD])
    (root,) = {r[3] for r in rows}
    assert made.root() == root
    told = made.proofs().withColumn("found", merkle.root_by(F.col("leaf"), F.col("lefts"), F.col("rights"))).collect()
    assert Counter(r.leaf for r in told) == Counter(r[1] for r in rows.elements()) and {r.found for r in told} == {root}
    assert Counter(sha("".join(x + y for x, y in zip(r.lefts, r.rights, strict=True))) for r in told) == Counter(r[4] for r in rows.elements())
    by_source = Counter(s for _, _, _, s in AWKWARD)
    assert {(r.source, r.n) for r in made.sources().collect()} == set(by_source.items()) and {r.subroot for r in made.sources().collect()} == {r[2] for r in rows}
    assert merkle.Manifest(documents(spark, []), 3, 2).root() is None


def test_every_row_is_folded_by_its_own_proof():
    leaf, beside = hashlib.sha256(b"leaf").digest(), sha("beside")
    root = hashlib.sha256((leaf.hex() + beside).encode()).digest()
    leaves = pa.table({"part": [0], "at": [0], "tree": ["sa"], "key": [1], "digest": [leaf], "tampered": pa.array([None], pa.binary())})
    for right, verified in ((beside, True), (sha("wrong"), False)):  # not tampered with: the proof alone decides
        side = pa.Table.from_pylist([{"tree": "sa", "first_at": 0, "start": 0, "n": 1, "digest": leaf, "lefts": [""], "rights": [right], "level": None, "root": root}])
        (got,) = merkle._proved(leaves, side).to_pylist()
        assert got["root"] == root.hex() and got["folded_root"] == sha(leaf.hex() + right) and got["verified"] == verified


def test_what_changed_between_two_manifests(spark):
    rows = [(i, f"text {i}", "en", f"src{i % 5}") for i in range(60)] + [(7, "text 7", "en", "src2")] * 2
    after = [r for r in rows if r[0] != 11] + [(100, "new", "en", "other"), (7, "text 7", "en", "src2")]
    after = [(i, "edited" if i == 23 else t, lang, src) for i, t, lang, src in after]
    old, new = (merkle.Manifest(documents(spark, r), 7, 3) for r in (rows, after))
    got = sorted((r.source, r.doc_id, r.change) for r in new.changes(old).collect())
    assert got == [("other", 100, "added"), ("src1", 11, "removed"), ("src2", 7, "added"), ("src3", 23, "added"), ("src3", 23, "removed")]
    assert old.changes(old).count() == 0
