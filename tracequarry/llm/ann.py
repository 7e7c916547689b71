"""Nearest neighbours by collision counting over single-projection sorted arrays.

The index has M_PROJECTIONS random projections; each keeps the values of a block
of vectors sorted, with every vector's rank. A query finds windows centred on
its own projections by binary search, and a vector collides where its rank lies in the window.
Virtual rehashing widens all windows by the same factor until enough vectors
have collided in SHARE of the projections; all of those are verified by exact
inner products in double precision. No candidate beyond the threshold is dropped.

Largest inner product becomes nearest point by one more coordinate that makes
all vectors of a block equally long; it is 0 for queries.

Vectors are indexed in blocks of about BLOCK rows, dealt by a hash. The stated
queries, in blocks of their own, meet every index block once; each pair of blocks
is a task's work, bounded in memory, and returns `k` rows a query.

Defined results: vectors that are null, empty, all zero or have a null or
non-finite component, and rows with a null id, take no part; vectors of other
lengths are never compared; a query's own id is no candidate, in repeated rows
neither, and asks once with the least of its vectors of a length; repeated rows of a candidate are candidates each; ties go to the
smaller id; no query gives an empty result; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces_of, staged

M_PROJECTIONS = 96
SHARE = 0.6
#: Windows widen until this share of a block, and 16 k vectors at least, has passed the threshold.
ENOUGH = 0.2
FIRST, FACTOR = 0.8, 1.2
BLOCK, QUERY_BLOCK = 16384, 512
#: Query blocks that a task meets an index block with.
GROUP = 32
#: Block indexes that a task keeps at once, each of about 25 MB.
HELD = 4
SEED = 11


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & fine & F.exists(v, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vec"), F.size(v).alias("dim")
    )


def _packed(rows: DataFrame, n_blocks: int, name: str) -> DataFrame:
    """One row for each block and length: ids and vectors as bytes."""

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        vectors = np.array(part["vec"].tolist(), np.float64)
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "vecs": [vectors.tobytes()]})

    # Row numbers of the written rows are hashed, so that repeated ids spread too.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int"))
    packed = dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, ids binary, vecs binary")
    return packed.select("dim", F.col("block").alias(f"{name}_block"), F.col("ids").alias(f"{name}_ids"), F.col("vecs").alias(f"{name}_vecs"))


class BlockIndex:
    """The sorted projections of one block."""

    def __init__(self, vectors: np.ndarray, m: int = M_PROJECTIONS, seed: int = SEED):
        n, dim = vectors.shape
        self.vectors, self.step = vectors, 0
        scaled = vectors / np.abs(vectors).max()  # so that squares of very large components stay finite
        norm2 = (scaled * scaled).sum(axis=1)
        self.longest = float(np.sqrt(norm2.max()))
        self.axes = np.random.default_rng(seed).standard_normal((dim + 1, m))
        spread = np.sqrt(np.maximum(0, self.longest**2 - norm2))
        values = (scaled @ self.axes[:-1] + spread[:, None] * self.axes[-1]).T
        order = np.argsort(values, axis=1)
        self.order = order.astype(np.int32)
        self.sorted = np.take_along_axis(values, order, axis=1)
        self.rank = np.empty((m, n), np.uint16 if n < 1 << 16 else np.uint32)
        np.put_along_axis(self.rank, order, np.arange(n, dtype=self.rank.dtype)[None, :].repeat(m, 0), axis=1)

    def ask(self, queries: np.ndarray) -> None:
        """The queries that candidates() is asked for by number from now on."""
        scaled = queries / np.abs(queries).max(axis=1, keepdims=True)
        self.centres = (scaled * (self.longest / np.linalg.norm(scaled, axis=1, keepdims=True))) @ self.axes[:-1]
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def candidates(self, query: int, least: int) -> np.ndarray:
        """Positions of at least `least` vectors (all, if there are fewer) that pass the collision threshold."""
        m, n = self.rank.shape
        if least >= n:
            return np.arange(n)
        enough = int(np.ceil(SHARE * m - 1e-9))
        # Widths are FIRST * FACTOR ** step. The least that is enough is sought from the last query's on, down or up: one whole
        # count there, and then only what a window newly covers, or covers no more.
        bounds = self._window(query)
        hits = self._counted(*bounds)
        found = np.flatnonzero(hits >= enough)
        way = -1 if len(found) >= least else 1
        while (way < 0 and self.step > 0) or len(found) < least:
            self.step += way
            after = self._window(query)
            inner, outer = (bounds, after) if way > 0 else (after, bounds)
            hits = hits + way * self._between(inner, outer)
            now = np.flatnonzero(hits >= enough)
            if way < 0 and len(now) < least:
                self.step += 1
                break
            bounds, found = after, now
        return found

    def _window(self, query: int) -> tuple[np.ndarray, np.ndarray]:
        """The first rank in each projection's window, and the first beyond it, at the present width; worked out for all queries at once."""
        if self.step not in self.bounds:
            width = FIRST * self.longest * FACTOR**self.step
            of = [(np.searchsorted(v, c - width, "left"), np.searchsorted(v, c + width, "right")) for v, c in zip(self.sorted, self.centres.T, strict=True)]
            self.bounds[self.step] = tuple(np.stack(x, axis=1) for x in zip(*of, strict=True))
        low, high = self.bounds[self.step]
        return low[query], high[query]

    def _counted(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many windows each position is."""
        inside = (self.rank - low.astype(self.rank.dtype)[:, None]) < (high - low).astype(self.rank.dtype)[:, None]  # below low wraps round
        # A window over all of 2 ** 16 ranks would wrap as well; blocks have fewer.
        return np.add.reduce(inside.view(np.uint8), axis=0, dtype=np.int16)

    def _between(self, inner: tuple[np.ndarray, np.ndarray], outer: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """In how many windows each position is only by the outer bounds."""
        rings = [o[a:b] for o, low, out_low, high, out_high in zip(self.order, inner[0], outer[0], inner[1], outer[1], strict=True) for a, b in ((out_low, low), (high, out_high))]
        return np.bincount(np.concatenate(rings), minlength=self.rank.shape[1]).astype(np.int16)


def _best(index: BlockIndex, ids: np.ndarray, at: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best of the vectors at some positions: those that may be among them are told by one product, then scored one by one."""
    if len(at) > k:
        with np.errstate(over="ignore", invalid="ignore"):
            quick = index.vectors[at] @ query
            slack = 1e-9 * float(np.abs(quick).max())
            near = quick >= np.partition(quick, -k)[-k] - slack
        if np.isfinite(slack):
            at = at[near]
    score = (index.vectors[at] * query).sum(axis=1)
    best = np.lexsort((ids[at], -score))[:k]
    return ids[at][best], score[best]


def _search(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    held: dict[tuple, BlockIndex] = {}  # a task has few blocks, and meets each with many query blocks
    for batch in batches:
        for row in batch.itertuples(index=False):
            ids = np.frombuffer(row.x_ids, np.int64)
            if (row.x_block, row.dim) not in held:
                if len(held) >= HELD:
                    del held[next(iter(held))]
                held[row.x_block, row.dim] = BlockIndex(np.frombuffer(row.x_vecs, np.float64).reshape(len(ids), row.dim))
            index = held[row.x_block, row.dim]
            query_ids = np.frombuffer(row.q_ids, np.int64)
            queries = np.frombuffer(row.q_vecs, np.float64).reshape(len(query_ids), row.dim)
            least = max(16 * k, int(ENOUGH * len(ids)))
            index.ask(queries)
            out = []
            for number, (query_id, query) in enumerate(zip(query_ids, queries, strict=True)):
                at = index.candidates(number, least)
                near, score = _best(index, ids, at[ids[at] != query_id], query, k)
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": near, "score": score}))
            if out:
                yield pd.concat(out)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of vectors to each row of queries.

    vectors, queries: as usable() gives them.
    """
    data = staged(vectors, "ann-vectors")
    asked = staged(queries.groupBy("vec_id", "dim").agg(F.min("vec").alias("vec")), "ann-queries")
    spark = data.sparkSession
    n_blocks = pieces_of(spark, data.count(), block)
    q_blocks = pieces_of(spark, asked.count(), query_block)
    # Work is dealt out by index block and group of query blocks. A group is so large that index and queries are moved about equally
    # often, or smaller where that would leave tasks without work.
    groups = max(-(-q_blocks // GROUP), min(q_blocks, -(-2 * spark.sparkContext.defaultParallelism // n_blocks)))
    parts = min(4 * n_blocks * groups, 20_000)
    of = F.pmod(F.col("q_block"), F.lit(groups)).alias("g")
    spread = _packed(asked, q_blocks, "q").select("*", of, F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("x_block"))
    index = _packed(data, n_blocks, "x").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = spread.repartition(parts, "x_block", "g").join(index.repartition(parts, "x_block", "g").hint("shuffle_hash"), ["x_block", "g", "dim"])
    near = pairs.mapInPandas(lambda it: _search(it, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def divisible_queries(vectors: DataFrame, by: int = 20) -> DataFrame:
    """The stated query set: every usable row whose id is divisible by `by`, against all rows."""
    rows = usable(vectors)
    return nearest(rows, rows.filter(F.col("vec_id") % by == 0))
