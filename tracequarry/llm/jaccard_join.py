"""N-gram Jaccard join by chosen paths.

A text is the set of its hashed five-word shingles. In every run, sets are split recursively: a set goes on
to the children named by a few sampled tokens of its own (each of its T
min-wise tokens is sampled with chance 1 / (LEAST * T)), so two similar sets
are expected to share at least one child at every level. Small buckets are
compared pairwise; runs repeat until a pair at the threshold is found with
chance RECALL.

The buckets only propose. Inside each, sets whose min-wise tokens agree well
enough are tied by a spanning forest, never by all pairs; the forest's components
over all buckets are candidate classes, which hold every pair found. Then each candidate
class is compared exactly: its members, in blocks, meet block by block in tasks of
bounded memory, which count each member's links and tie linked members by a
spanning forest. So counts are whole for every pair inside a candidate class,
also for pairs that no bucket held, and no list of pairs is ever written.

Sets that are equal are one class member from the start, with a number of copies. Small buckets with the same
members, which near copies meet in run after run, are compared once. A
bucket that is still large at the last level is compared in blocks of rows as well:
every block with every other, so no pair is dropped.

Only the texts of candidate classes move: the documents' side of that join is filtered by a Bloom filter of the
candidates' ids where the documents are read.

Words are runs of characters other than ASCII white space, A-Z in lower case.

Defined results: a text of one to four words is one shingle of all its words; a null
text, or one without a word, has no shingles and no links and is a class of its own;
copies link to each other; all shingles of a text count, however long it is; rows that repeat an id stay rows of their own, each with
the same class; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filtering_joins, give_back, small_batches, staged
from .components import components

WORDS, LEAST = 5, 0.8
#: Min-wise tokens of a set, and the agreement below which a bucket's pair is not proposed.
T, PROPOSE = 64, 0.55
RECALL = 0.999
SMALL, DEPTH = 96, 3
#: Members of a block of a bucket that is still large at the last level.
PROPOSE_BLOCK = 256
#: Members and bytes of text of a block of the exact comparison (more only where one text alone has more), and token
#: columns compared at once.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 8 << 20, 4096
SEED = 5
NULL_ID = -(1 << 63)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def runs_for(recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs that find a pair at the threshold with chance `recall`, if splitting ends at `depth`.

    All runs draw from the same T min-wise tokens. A pair at the threshold shares a Binomial(T, LEAST) number of
    them, and at each level shares the children named by those of the shared that are drawn.
    """
    shared = np.arange(T + 1)
    weight = np.array([comb(T, a) * LEAST**a * (1 - LEAST) ** (T - a) for a in range(T + 1)])
    lost = np.zeros(T + 1)
    for _ in range(depth):
        lost = (1 - (1 - lost) / (LEAST * T)) ** shared
    runs = 1
    while (weight * lost**runs).sum() > 1 - recall:
        runs += 1
    return runs


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, worked out once for each; bounded."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes know ASCII case and white space only
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    n = min(WORDS, len(h))
    out = h[: len(h) - n + 1]
    for i in range(1, n):
        out = _mix(out) + h[i : len(h) - n + 1 + i]
    return np.unique(_mix(out))


def set_name(tokens: np.ndarray) -> str:
    """The same for equal sets."""
    import xxhash

    return xxhash.xxh3_128_hexdigest(tokens.tobytes())


def min_tokens(tokens: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The least token, by T seeded orders, as 32 bits of its hash."""
    keys = np.random.default_rng(seed).integers(1, 1 << 63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full(T, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(tokens), 1 << 12):  # bounded memory for any text
        part = tokens[at : at + (1 << 12)]
        out = np.minimum(out, ((keys[:, None] * part) >> np.uint64(32)).astype(np.uint32).min(axis=1))
    return out


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes()
    for batch in batches:
        found = [shingles(text, hashes) for text in batch["text"]]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"],
            "n_shingles": [len(f) for f in found],
            "n_bytes": [len(t) if t else 0 for t in batch["text"]],
            "name": [set_name(f) if len(f) else None for f in found],
            "tokens": [min_tokens(f).tobytes() if len(f) else None for f in found],
        })
    give_back()


def sets_of(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, n_bytes, name, tokens) of (doc_id, text); n_bytes is the length of the text, name is the same for equal sets, null without shingles."""
    return docs.mapInPandas(_sets, "doc_id long, n_shingles int, n_bytes long, name string, tokens binary")


def _children(batches: Iterator[pd.DataFrame], runs: int, level: int) -> Iterator[pd.DataFrame]:
    """The buckets that each row goes on to: by its sampled tokens, in each run; a path is of one run from the first level on."""
    chance = int((1 << 32) / (LEAST * T))
    slot = np.arange(T, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for batch in batches:
        if not len(batch):
            continue
        tokens = np.frombuffer(b"".join(batch["tokens"]), np.uint32).reshape(-1, T).astype(np.uint64)
        path = batch["path"].to_numpy(np.int64).view(np.uint64)
        row, at = [], []
        for run in range(runs if level == 0 else 1):
            salted = path + np.uint64((run * 0x9E3779B97F4A7C15 + SEED + 1) % (1 << 64))
            # By the set's own tokens, so that unlike sets of a bucket, or of the whole corpus, draw apart.
            drawn = _mix(_mix(_mix(salted)[:, None] + slot) + tokens) >> np.uint64(32)
            i, j = np.nonzero(drawn < chance)
            row.append(i)
            at.append(_mix(_mix(_mix(salted[i]) + j.astype(np.uint64)) + tokens[i, j]).view(np.int64))
        yield pd.DataFrame({"path": np.concatenate(at), "node": batch["node"].to_numpy()[np.concatenate(row)]})
    give_back()


BUCKET = "path long, node long"


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a square, or of a rows-by-columns, boolean matrix given as a square."""
    n, seen, edges = len(linked), np.zeros(len(linked), bool), []
    for start in range(n):
        if seen[start]:
            continue
        seen[start], front = True, [start]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            edges += [(at, int(x)) for x in new]
            front += new.tolist()
    return edges


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal min-wise tokens of each row of a with each of b."""
    out = np.zeros((len(a), len(b)), np.uint8)
    for t in range(T):
        out += a[:, t, None] == b[None, :, t]
    return out / np.float32(T)


def _small_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning edges of each small bucket; rows come in the order of their buckets.

    Row i meets row i + 1, then i + 2, and so on while any pair shares a bucket.
    """
    held = None
    for batch in _with_end(batches):
        last = batch is None
        rows = held if last else batch if held is None else pd.concat([held, batch], ignore_index=True)
        held = None
        if rows is None or not len(rows):
            continue
        path = rows["path"].to_numpy()
        if not last:  # the last bucket may go on in the next batch
            cut = int(np.flatnonzero(path != path[-1]).max(initial=-1)) + 1
            held = rows.iloc[cut:]
            rows, path = rows.iloc[:cut], path[:cut]
        node, tokens = rows["node"].to_numpy(), np.frombuffer(b"".join(rows["tokens"]), np.uint32).reshape(-1, T)
        root = list(range(len(rows)))

        def find(x: int, root=root) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        edges = []
        for d in range(1, len(rows)):
            i = np.flatnonzero(path[:-d] == path[d:])
            if not len(i):
                break
            i = i[(tokens[i] == tokens[i + d]).sum(axis=1) >= PROPOSE * T]
            for x in i.tolist():
                a, b = find(x), find(x + d)
                if a != b:
                    root[b] = a
                    edges.append((node[x], node[x + d]))
        if edges:
            yield pd.DataFrame(edges, columns=["u", "v"])
    give_back()


def _with_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _large_bucket(key, part: pd.DataFrame) -> pd.DataFrame:
    """Spanning edges of two blocks of a large bucket, or of one with itself."""
    tokens = np.frombuffer(b"".join(part["tokens"]), np.uint32).reshape(-1, T)
    edges = _forest(_agreement(tokens, tokens) >= PROPOSE)
    nodes = part["node"].to_numpy()
    return pd.DataFrame({"u": nodes[[a for a, _ in edges]], "v": nodes[[b for _, b in edges]]}, dtype=np.int64)


def _in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows of groups cut into a number of blocks, once for every pair of blocks that their own block belongs to, in `part`.

    A group's members are dealt into blocks by a hash.
    """
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("_blocks")).cast("int")
    return (
        rows.withColumn("_blocks", blocks.cast("int"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("part", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")))
        .drop("other", "_blocks")
    )


def _buckets(split: DataFrame) -> DataFrame:
    """(path, size) of the buckets to be looked at: large ones, and of small ones with the same members one.

    Members are told apart by the sum of two hashes of 64 bits.
    """
    sizes = split.groupBy("path").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(SEED))).alias("y")).filter("size > 1")
    sizes = staged(sizes, "jaccard-sizes")
    small = sizes.filter(F.col("size") <= SMALL).groupBy("size", "x", "y").agg(F.min("path").alias("path"))
    return staged(small.select("path", "size").union(sizes.filter(F.col("size") > SMALL).select("path", "size")), "jaccard-chosen")


def candidate_edges(nodes: DataFrame, recall: float = RECALL) -> DataFrame:
    """(u, v) spanning edges of what the buckets of all runs propose; nodes: (node, tokens), written."""
    runs, found, spark = runs_for(recall, DEPTH), None, nodes.sparkSession
    rows = nodes.select(F.lit(0).cast("long").alias("path"), "node", "tokens")
    for level in range(DEPTH):
        split = staged(rows.mapInPandas(lambda it, level=level: _children(it, runs, level), BUCKET), "jaccard-paths")
        with filtering_joins(spark):
            # Nearly all paths of unlike sets end here, before any token is moved.
            kept = staged(split.join(_buckets(split).filter("size > 1"), "path"), "jaccard-kept").filter("size > 1")
            told = staged(kept.join(nodes, "node"), "jaccard-buckets")
        small = told.filter(F.col("size") <= SMALL).repartition("path").sortWithinPartitions("path", "node")
        edges = small.select("path", "node", "tokens").mapInPandas(_small_buckets, "u long, v long")
        large = told.filter(F.col("size") > SMALL)
        none_large = large.isEmpty()
        if level == DEPTH - 1 and not none_large:
            parts = _in_blocks(large, F.ceil(F.col("size") / PROPOSE_BLOCK)).select("path", "part", "node", "tokens")
            edges = edges.union(parts.groupBy("path", "part").applyInPandas(_large_bucket, "u long, v long"))
        edges = staged(edges.distinct(), "jaccard-proposed")
        found = edges if found is None else found.union(edges)
        if none_large:
            break
        rows = large.select("path", "node", "tokens")
    return found.distinct()


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b.

    Only tokens that both sides hold count, as columns of 0-1 matrices, COLUMNS at a time.
    """
    tokens_a, tokens_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(tokens_a, tokens_b)
    out = np.zeros((len(a), len(b)), np.float32)

    def spread(tokens: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(shared, tokens)
        hit = at < len(shared)
        hit[hit] = shared[at[hit]] == tokens[hit]
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]

    (row_a, col_a), (row_b, col_b) = spread(tokens_a, a), spread(tokens_b, b)
    for at in range(0, len(shared), COLUMNS):
        n = min(COLUMNS, len(shared) - at)
        x, y = np.zeros((len(a), n), np.float32), np.zeros((len(b), n), np.float32)
        for matrix, row, col in ((x, row_a, col_a), (y, row_b, col_b)):
            here = (col >= at) & (col < at + n)
            matrix[row[here], col[here] - at] = 1
        out += x @ y.T
    return out


def _linked(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    common = _common(a, b).astype(np.int64)
    union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - common
    return common * 5 >= union * 4  # Jaccard of 0.8 or more, exactly


def _compare(key, part: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of a candidate class, or inside one: (node, links, tie) with a spanning edge in tie."""
    hashes = WordHashes()
    part = part.sort_values("node", kind="stable")
    sets = [shingles(t, hashes) for t in part["text"]]
    # Where an id repeats, other texts than the set's own have come along.
    fine = np.array([len(s) > 0 and set_name(s) == n for s, n in zip(sets, part["name"], strict=True)], bool)
    fine &= ~part["node"].where(fine).duplicated().to_numpy()
    part, sets = part[fine], [s for s, f in zip(sets, fine, strict=True) if f]
    first, last = (int(x) for x in key[1].split("-"))
    nodes, copies, own = part["node"].to_numpy(), part["copies"].to_numpy(), part["own"].to_numpy()
    if first == last:
        linked = _linked(sets, sets)
        np.fill_diagonal(linked, False)
        links, edges = linked @ copies, _forest(linked)
    else:
        i, j = np.flatnonzero(own == first), np.flatnonzero(own == last)
        links, edges = np.zeros(len(part), np.int64), []
        if len(i) and len(j):
            part_linked = _linked([sets[x] for x in i], [sets[x] for x in j])
            links[i], links[j] = part_linked @ copies[j], part_linked.T @ copies[i]
            linked = np.zeros((len(part), len(part)), bool)
            linked[np.ix_(i, j)], linked[np.ix_(j, i)] = part_linked, part_linked.T
            edges = _forest(linked)
    tie = nodes.copy()
    for a, b in edges:
        tie[b] = nodes[a]  # a forest's edge list names each child once
    return pd.DataFrame({"node": nodes, "links": links, "tie": tie}).astype(np.int64)


def join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies, n_shingles of every row; class_id is the least doc_id of the class.

    n_links counts the other rows whose set is similar, copies included; n_copies the rows
    with an equal set, itself included. A null id takes part under the least long.
    """
    named = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    with small_batches(named.sparkSession):
        rows = staged(sets_of(named), "jaccard-sets")
    groups = (
        rows.filter("name is not null")
        .groupBy("name")
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n_bytes").alias("bytes"), F.any_value("tokens").alias("tokens"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    groups = staged(groups, "jaccard-groups")  # the numbers are fixed from here on
    candidates = components(candidate_edges(groups.select("node", "tokens"), recall))
    sized = candidates.join(groups.drop("tokens"), "node")
    size = sized.groupBy("root").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
    members = staged(sized.drop("bytes").join(size, "root"), "jaccard-members")
    # One text of each equal set, by its least id.
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES))
    told = members.filter("size > 1").join(named.withColumnRenamed("doc_id", "least"), "least")
    parts = _in_blocks(told, blocks).select("root", "part", "own", "node", "name", "copies", "text")
    with filtering_joins(named.sparkSession):
        found = staged(parts.groupBy("root", "part").applyInPandas(_compare, "node long, links long, tie long"), "jaccard-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.select(F.col("node").alias("u"), F.col("tie").alias("v")))
    linked = groups.drop("tokens", "bytes").join(links, "node", "left").join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = staged(linked, "jaccard-linked")
    first = linked.groupBy("root").agg(F.min("least").alias("class_id"))
    by_name = staged(linked.join(first, "root").select("name", "copies", F.coalesce("links", F.lit(0)).alias("links"), "class_id"), "jaccard-classes")
    # Both sides are read from files, so Spark deals out both and can split the part of a set with very many copies.
    return rows.select("doc_id", "name", "n_shingles").join(by_name, "name", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        "n_shingles",
    )


def one_of_each(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of docs that stay: of each class the one with the least id, and of rows that repeat an id all."""
    kept = join(docs, recall).filter("doc_id = class_id").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == kept["_kept"], "left_semi")
