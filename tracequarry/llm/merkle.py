"""A Merkle manifest of documents, by an associative monoid of sparse forests.

Every row is a leaf of its source's tree; the trees' roots are the leaves of one more tree. Rows are dealt out by ranges of
(source, id), so a part holds a run of consecutive leaves of each of its sources and, by the parts' counts, knows their indexes and
the size of each tree. A part's fragment is a sparse forest: the nodes whose run of siblings is not complete yet, keyed by tree,
level and index. Merging two fragments unites them and resolves every run that is complete now; as the size of a tree tells how many
siblings a run has, any grouping of merges gives the same forest. Fragments are reduced as a tree, FAN at a time, in rounds that are
written to the shared folder: a fragment keeps at most ARITY - 1 nodes at either end of each level, and only of the two sources that
go on beyond it, so no task ever holds a tree. Nodes made on the way are kept as rows; a part reads the few that its own proofs
need, by key, and works out its rows' proofs.

Defined results: a null is written `-`, an empty text `0:`, so they differ; very long texts are hashed whole; null sources are a tree
of their own, before all others; null ids come first in their source and are not tampered with; rows that repeat an id are leaves of their own, in the
order of their digests; equal rows have equal leaves and take neighbouring places, in any order; an empty table gives no row; other columns are ignored, whatever
their names.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, pieces_of, staged

ARITY = 3
#: Leaves of a part; fewer where that would leave cores without work.
PART_ROWS, LEAST_ROWS = 1 << 17, 1 << 12
#: Fragments that a task of the reduction merges.
FAN = 16
#: ARITY to the power of each level, as far as a tree can reach.
POWERS = [ARITY**level for level in range(40)]

NODE = "part int, tree string, n long, level int, idx long, digest binary, open boolean, made boolean"


def _told(*values: Column) -> Column:
    """sha256 of values, each as its UTF-8 length and itself."""
    text = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256))


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, tree, digest and, where tampering changes it, the tampered digest; the only step that reads texts."""
    doc_id, source, text = (F.col(f"`{c}`") for c in ("doc_id", "source", "text"))
    middle = (source, F.col("lang"), F.col("n_chars"))
    bare = F.replace(text, F.lit("\n"), F.lit(""))
    tampered = F.when((crc_of_id() % 2 == 0) & text.contains("\n"), _told(doc_id, *middle, bare))
    return docs.select(doc_id.alias("key"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("tree"), _told(doc_id, *middle, text).alias("digest"), tampered.alias("tampered"))


def _parent(run: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in run).encode()).digest()


class Tree:
    """Some nodes of one tree of n leaves."""

    def __init__(self, n: int):
        self.n, self.levels, self.above = n, defaultdict(dict), {}

    def width(self, level: int) -> int:
        return -(-self.n // ARITY**level)

    def run(self, level: int, index: int) -> range:
        """The indexes of a node's siblings and itself."""
        first = index // ARITY * ARITY
        return range(first, min(first + ARITY, self.width(level)))

    def resolve(self) -> tuple[set, set]:
        """Makes every node whose children are all here, level by level. The keys of nodes that are still open, and of those made."""
        opened, made, level = set(), set(), 0
        while self.width(level) > 1:
            here = self.levels[level]
            for first in {i // ARITY for i in here}:
                run = self.run(level, first * ARITY)
                if all(i in here for i in run):
                    self.levels[level + 1][first] = _parent(here[i] for i in run)
                    made.add((level + 1, first))
                else:
                    opened.update((level, i) for i in run if i in here)
            level += 1
        return opened, made

    def path(self, level: int, index: int) -> tuple[list[str], list[str]]:
        """The siblings to the left and to the right, as hex text, of a node and of those above it."""
        if self.width(level) == 1:
            return [], []
        up = (level + 1, index // ARITY)
        if up not in self.above:
            self.above[up] = self.path(*up)
        here, run = self.levels[level], self.run(level, index)
        left, right = ("".join(here[i].hex() for i in part) for part in (range(run.start, index), range(index + 1, run.stop)))
        return [left, *self.above[up][0]], [right, *self.above[up][1]]


def folded(digest: bytes, lefts: list[str], rights: list[str]) -> bytes:
    for left, right in zip(lefts, rights, strict=True):
        digest = hashlib.sha256(f"{left}{digest.hex()}{right}".encode()).digest()
    return digest


def _rows(part: int, trees: dict[str, Tree], whole: bool) -> pa.Table:
    """What a fragment hands on: its open nodes, and those made on the way, or, of a part, the roots alone."""
    out = []
    for name, tree in trees.items():
        opened, made = tree.resolve()
        if not whole:
            height = next(level for level in range(len(POWERS)) if POWERS[level] >= tree.n)
            made = {(height, 0)} if 0 in tree.levels[height] else set()
        out += [(part, name, tree.n, level, i, tree.levels[level][i], (level, i) in opened, (level, i) in made) for level, i in opened | made]
    columns = list(zip(*out, strict=True)) or [[]] * 8
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in NODE.split(", ")])


def _grown(leaves: pa.Table, side: pa.Table) -> tuple[dict[str, Tree], dict[str, dict], list[int]]:
    """A part's trees with its leaves and the nodes that it was sent, its spans, and the index of each of its leaves."""
    sent = side.to_pylist()
    spans = {r["tree"]: r for r in sent if r["level"] is None}
    trees = {name: Tree(r["n"]) for name, r in spans.items()}
    places = []
    for at, name, digest in zip(*(leaves.column(c).to_pylist() for c in ("at", "tree", "digest")), strict=True):
        places.append(spans[name]["start"] + at - spans[name]["first_at"])
        trees[name].levels[0][places[-1]] = digest
    for r in sent:
        if r["level"] is not None:
            trees[r["tree"]].levels[r["level"]][r["idx"]] = r["digest"]
    return trees, spans, places


def _fragment(leaves: pa.Table, side: pa.Table) -> pa.Table:
    trees, _, _ = _grown(leaves, side)
    return _rows(leaves.column("part")[0].as_py(), trees, False)


def _merged(nodes: pa.Table) -> pa.Table:
    trees: dict[str, Tree] = {}
    for name, n, level, i, digest in zip(*(nodes.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digest")), strict=True):
        trees.setdefault(name, Tree(n)).levels[level][i] = digest
    return _rows(nodes.column("part")[0].as_py(), trees, True)


def _paths(leaves: pa.Table, side: pa.Table) -> pa.Table:
    """tree, lefts and rights of each leaf of the last tree; a leaf's key is the tree it stands for."""
    trees, _, places = _grown(leaves, side)
    for tree in trees.values():
        tree.resolve()
    found = [trees[name].path(0, i) for name, i in zip(leaves.column("tree").to_pylist(), places, strict=True)]
    texts = pa.list_(pa.string())
    return pa.table([leaves.column("key"), pa.array([f[0] for f in found], texts), pa.array([f[1] for f in found], texts)], names=["tree", "lefts", "rights"])


PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(leaves: pa.Table, side: pa.Table) -> pa.Table:
    trees, spans, places = _grown(leaves, side)
    for tree in trees.values():
        tree.resolve()
    out = []
    for key, name, leaf, tampered, i in zip(*(leaves.column(c).to_pylist() for c in ("key", "tree", "digest", "tampered")), places, strict=True):
        lefts, rights = (own + top for own, top in zip(trees[name].path(0, i), (spans[name]["lefts"], spans[name]["rights"]), strict=True))
        proof = hashlib.sha256("".join(x + y for x, y in zip(lefts, rights, strict=True)).encode()).hexdigest()
        root = spans[name]["root"]
        again = folded(leaf if tampered is None else tampered, lefts, rights)  # of every row, so a wrong sibling shows
        out.append((key, leaf.hex(), spans[name]["digest"].hex(), root.hex(), proof, again.hex(), again == root))
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PROVED.split(", ")])


class Forest:
    """Trees over leaves (tree, key, digest, ...), reduced to their roots; every step is written to the shared folder.

    leaves: a written table. A tree's leaves ascend by key, then by digest.
    """

    def __init__(self, leaves: DataFrame, part_rows: int | None = None, fan: int = FAN):
        spark, rows = leaves.sparkSession, leaves.count()
        parts = pieces_of(spark, rows, part_rows) if part_rows else max(pieces_of(spark, rows, PART_ROWS), min(pieces_of(spark, rows, LEAST_ROWS), spark.sparkContext.defaultParallelism))
        # Rows of the written table are numbered, so that equal rows can be told apart and their range can be cut.
        order = ["tree", "key", "digest", "salt"]
        ranged = leaves.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
        inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        self.dealt = staged(ranged.withColumns({"part": F.spark_partition_id(), "at": inside}), "merkle-leaves")
        ahead = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = self.dealt.groupBy("part", "tree").agg(F.min("at").alias("first_at"), F.count("*").alias("count"))
        # One row for each part and tree of its; a hot tree has as many as there are parts.
        self.spans = staged(counts.withColumns({"start": F.coalesce(F.sum("count").over(ahead), F.lit(0)), "n": F.sum("count").over(Window.partitionBy("tree"))}), "merkle-spans")
        self.known = self._reduced(fan)

    def _cogrouped(self, leaves: DataFrame, side: DataFrame, f, schema: str) -> DataFrame:
        return leaves.groupBy("part").cogroup(side.groupBy("part")).applyInArrow(f, schema)

    def _reduced(self, fan: int) -> DataFrame:
        """All nodes that were open in a part, or made by a merge."""
        side = self.spans.withColumn("level", F.lit(None).cast("int"))
        fragments = staged(self._cogrouped(self.dealt.select("part", "at", "tree", "digest"), side, _fragment, NODE), "merkle-fragments")
        known, width = fragments, (self.spans.agg(F.max("part")).first()[0] or 0) + 1
        while width > 1:
            near = fragments.filter("open").withColumn("part", (F.col("part") / fan).cast("int"))
            fragments, width = staged(near.groupBy("part").applyInArrow(_merged, NODE), "merkle-merged"), -(-width // fan)
            known = known.union(fragments.filter("made"))
        return known

    def roots(self) -> DataFrame:
        power = F.element_at(F.array(*[F.lit(p) for p in POWERS]), F.col("level") + 1)
        return self.known.filter((F.col("idx") == 0) & (power >= F.col("n"))).select("tree", "digest")

    def _needed(self) -> DataFrame:
        """Nodes beyond a part that are siblings of its first or last leaf's ancestors: at most 2 * ARITY for each level and source."""
        cut = self.spans.filter("count < n").withColumn("_l", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(p).alias("power")) for i, p in enumerate(POWERS)])))
        cut = cut.select("part", "tree", "start", "count", "n", "_l.level", "_l.power").filter("power < n")
        ends = cut.withColumn("run", F.expr(f"explode(array_distinct(array(start div power div {ARITY}, (start + count - 1) div power div {ARITY})))"))
        nodes = ends.withColumn("idx", F.expr(f"explode(sequence(run * {ARITY}, least(run * {ARITY} + {ARITY}, (n + power - 1) div power) - 1))"))
        return nodes.select("part", "tree", "level", "idx").join(self.known.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])

    def walked(self, spans: DataFrame, f, schema: str) -> DataFrame:
        """f over each part's leaves with its spans, as given, and the nodes it needs."""
        side = spans.withColumn("level", F.lit(None).cast("int")).unionByName(self._needed(), allowMissingColumns=True)
        return self._cogrouped(self.dealt, side, f, schema)


PROOF = "doc_id long, source string, leaf string, lefts array<string>, rights array<string>"


def _told_proofs(leaves: pa.Table, side: pa.Table) -> pa.Table:
    trees, spans, places = _grown(leaves, side)
    for tree in trees.values():
        tree.resolve()
    out = []
    for key, name, leaf, i in zip(*(leaves.column(c).to_pylist() for c in ("key", "tree", "digest")), places, strict=True):
        lefts, rights = (own + top for own, top in zip(trees[name].path(0, i), (spans[name]["lefts"], spans[name]["rights"]), strict=True))
        out.append((key, name[1:] if name else None, leaf.hex(), lefts, rights))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PROOF.split(", ")])


class Manifest:
    """The trees of some documents, written to the shared folder: their roots, and a proof of each document."""

    def __init__(self, docs: DataFrame, part_rows: int | None = None, fan: int = FAN):
        self.forest = Forest(staged(leaves_of(docs), "merkle-read"), part_rows, fan)
        self.subroots = staged(self.forest.roots(), "merkle-subroots")
        self.top = Forest(self.subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), part_rows, fan)
        self.paths = staged(self.top.walked(self.top.spans, _paths, "tree string, lefts array<string>, rights array<string>"), "merkle-paths")

    def _spans(self) -> DataFrame:
        root = self.top.roots().select(F.col("digest").alias("root"))  # one row
        return self.forest.spans.join(self.subroots, "tree").join(self.paths, "tree").crossJoin(F.broadcast(root))

    def root(self) -> str | None:
        """The root as hex text; None without documents."""
        found = self.top.roots().first()
        return None if found is None else bytes(found.digest).hex()

    def sources(self) -> DataFrame:
        """source, n, subroot."""
        n = self.forest.spans.groupBy("tree").agg(F.max("n").alias("n"))
        return self.subroots.join(n, "tree").select(_source(F.col("tree")).alias("source"), "n", F.lower(F.hex("digest")).alias("subroot"))

    def proofs(self) -> DataFrame:
        """doc_id, source, leaf, lefts, rights: what is written to either side of a leaf and of each node above it, level by level to the root."""
        return self.forest.walked(self._spans(), _told_proofs, PROOF)

    def proved(self) -> DataFrame:
        return self.forest.walked(self._spans(), _proved, PROVED)

    def changes(self, before: "Manifest") -> DataFrame:
        """source, doc_id, leaf, change (`added` or `removed`) of leaves that only one of two manifests has; a changed document has both.

        Sources whose subroots are equal have equal leaves and are not looked at. A leaf that repeats counts as often as it comes.
        """
        mine, theirs = (m.subroots.select("tree", F.col("digest").alias(f"_{n}")) for n, m in enumerate((self, before)))
        moved = mine.join(theirs, "tree", "full").filter(~F.col("_0").eqNullSafe(F.col("_1"))).select("tree")
        leaves = [m.forest.dealt.select("tree", "key", "digest", F.lit(sign).alias("sign")).join(moved, "tree", "left_semi") for sign, m in ((1, self), (-1, before))]
        net = leaves[0].union(leaves[1]).groupBy("tree", "key", "digest").agg(F.sum("sign").alias("n")).filter("n != 0")
        each = net.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.abs("n"))))
        return each.select(_source(F.col("tree")).alias("source"), F.col("key").alias("doc_id"), F.lower(F.hex("digest")).alias("leaf"), F.when(F.col("n") > 0, "added").otherwise("removed").alias("change"))


def _source(tree: Column) -> Column:
    return F.when(tree != "", F.substring(tree, 2, 1 << 30))


def root_by(leaf: Column, lefts: Column, rights: Column) -> Column:
    """The root that a leaf's proof leads to, by Spark's own functions: what anyone can check who has the proof and the root."""
    steps = F.zip_with(lefts, rights, lambda left, right: F.struct(left.alias("l"), right.alias("r")))
    return F.aggregate(steps, leaf, lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]).cast("binary"), 256))


def manifest(docs: DataFrame, part_rows: int | None = None, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each document."""
    return Manifest(docs, part_rows, fan).proved()
