"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots that never changes with the number
of shards. Bytes are summed by slot, and a slot-to-shard map says where each
slot lives. The map is stored, with versions: a run takes the latest one and, if the shards' bytes are no longer
nearly equal, edits it by moving or swapping single slots and adds the next version, so only the rows of the edited slots move.

An id alone chooses the slot of its rows, whatever else the table holds, unless its rows have more bytes than a slot has on average: those of such an id, of which there are
fewer than slots, are spread over all slots by their places in the written table.

Defined results: a null text has size 8 and checksum 0; a null id hashes like
any other value; rows that repeat stay separate rows; texts of any length are measured whole; an empty
table gives an empty result and the initial map; columns of the input other
than id and text are ignored, whatever their names. Rows of a slot have their places in the order in which they were written.
"""

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, staged

N_SLOTS = 8192
#: Parts of a slot whose rows are numbered apart, as one id may have very many rows.
CHUNKS = 256
MAP_SCHEMA = "version int, vslot int, shard int, bytes long, rows long"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, chunk) of every row; the text itself goes no further."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.pmod(F.spark_partition_id(), F.lit(CHUNKS)).alias("chunk"),
    )


def hot_ids(rows: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Ids whose rows have more bytes than a slot has on average: fewer than n_slots."""
    whole = rows.agg(F.sum("size").alias("_whole"))
    by_id = rows.groupBy("doc_id").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_n")).filter("_n > 1")
    return by_id.join(F.broadcast(whole), F.col("_bytes") * n_slots > F.col("_whole")).select(F.col("doc_id").alias("_hot_id"), F.lit(True).alias("_hot"))  # one row of whole


def with_slots(rows: DataFrame, n_slots: int = N_SLOTS, id_col: str = "doc_id", hot: DataFrame | None = None) -> DataFrame:
    """rows with vslot. hot: ids whose rows are spread, as hot_ids() finds them."""
    key = F.xxhash64(F.col(id_col))
    if hot is not None:
        rows = rows.withColumn("_place", F.monotonically_increasing_id()).join(F.broadcast(hot), F.col(id_col).eqNullSafe(F.col("_hot_id")), "left")
        key = F.when(F.col("_hot"), F.xxhash64(F.col(id_col), F.col("_place"))).otherwise(key)
    return rows.withColumn("vslot", F.pmod(key, F.lit(n_slots)).cast("int")).drop("_place", "_hot_id", "_hot")


def slot_weights(rows: DataFrame, n_slots: int = N_SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of each slot: at most n_slots figures, whatever the input."""
    size, count = np.zeros(n_slots, np.int64), np.zeros(n_slots, np.int64)
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
        size[r.vslot], count[r.vslot] = r.b, r.n
    return size, count


def initial_map(n_slots: int, n_shards: int) -> np.ndarray:
    return np.arange(n_slots) % n_shards


def rebalanced(shard: np.ndarray, size: np.ndarray, n_shards: int) -> np.ndarray:
    """An edited copy of the map whose shards have nearly equal bytes.

    The fullest shard gives a slot to another, or swaps one for a smaller one,
    so as to close half the gap as nearly as can be; the search ends when no
    move or swap of the fullest shard helps. Each edit lessens the sum of the shards' squares, so there is an end.
    """
    shard = shard.copy()
    total = np.bincount(shard, weights=size, minlength=n_shards).astype(np.int64)
    members = [list(np.flatnonzero(shard == s)) for s in range(n_shards)]
    while True:
        order = np.argsort(total, kind="stable")
        high, best = int(order[-1]), None
        for low in map(int, order[:-1]):
            gap = int(total[high] - total[low])
            if gap <= 1:
                break
            mine = np.array([m for m in members[high] if size[m] > 0], np.int64)
            if not len(mine):
                break
            theirs = np.array(members[low], np.int64)
            theirs = theirs[np.argsort(size[theirs], kind="stable")]
            offered = np.concatenate([[0], size[theirs]])
            at = np.searchsorted(offered, size[mine] - gap / 2)
            for j in (np.clip(at, 0, len(offered) - 1), np.clip(at - 1, 0, len(offered) - 1)):
                change = size[mine] - offered[j]
                off = np.where((change > 0) & (change < gap), np.abs(2 * change - gap), 2 * gap)
                i = int(off.argmin())
                if off[i] < gap and (best is None or off[i] < best[0]):
                    best = (int(off[i]), low, int(mine[i]), None if j[i] == 0 else int(theirs[j[i] - 1]))
            if best:
                break
        if not best:
            return shard
        _, low, out, back = best
        for slot, a, b in ((out, high, low), (back, low, high)):
            if slot is not None:
                members[a].remove(slot)
                members[b].append(slot)
                shard[slot] = b
                total[a] -= size[slot]
                total[b] += size[slot]


def grown(shard: np.ndarray, size: np.ndarray, n_shards: int) -> np.ndarray:
    """The map for one more shard: slots move only into it, from the fullest shards, until it has its share."""
    shard = shard.copy()
    total = np.bincount(shard, weights=size, minlength=n_shards + 1).astype(np.int64)
    share = int(size.sum()) // (n_shards + 1)
    for slot in np.argsort(-size, kind="stable"):
        if total[shard[slot]] > share and total[n_shards] + size[slot] <= share:
            total[shard[slot]] -= size[slot]
            total[n_shards] += size[slot]
            shard[slot] = n_shards
    return shard


def save_map(spark: SparkSession, path: str, version: int, shard: np.ndarray, size: np.ndarray, count: np.ndarray) -> None:
    """Adds a version to the stored map. A version that is there already, as another run may have added it, is an error; one that was not written whole has no mark of its end and is written anew."""
    rows = [(version, int(i), int(s), int(b), int(n)) for i, (s, b, n) in enumerate(zip(shard, size, count, strict=True))]
    found = latest_map(spark, path, len(shard))
    if found is not None and found[0] >= version:
        raise ValueError(f"{path} has version {found[0]} already; take it up and edit that one")
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")


def latest_map(spark: SparkSession, path: str, n_slots: int) -> tuple[int, np.ndarray] | None:
    """(version, shard of each slot) of the last version that was written whole; None if there is none."""
    try:
        stored = spark.read.schema(MAP_SCHEMA).parquet(path)
        whole = stored.groupBy("version").agg(F.count("*").alias("n")).filter(F.col("n") == n_slots).agg(F.max("version").alias("v")).first().v
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if whole is None:
        return None
    out = np.zeros(n_slots, np.int64)
    for r in load_map(spark, path, whole).collect():
        out[r.vslot] = r.shard
    return whole, out


def placed(rows: DataFrame, shard: np.ndarray, count: np.ndarray) -> DataFrame:
    """Shard and place in it of every row; count: rows of each slot.

    A slot's first place is the number of rows in earlier slots of its shard, from the map alone; a chunk's first place in its
    slot follows from the chunks' counts, and places inside a chunk come from a window over it. So no task numbers
    more than one slot's chunk, whatever ids repeat.
    """
    starts = np.zeros(len(shard), np.int64)
    for s in np.unique(shard):
        of = np.flatnonzero(shard == s)
        starts[of] = np.cumsum(count[of]) - count[of]
    slots = rows.sparkSession.createDataFrame([(i, int(s), int(x)) for i, (s, x) in enumerate(zip(shard, starts, strict=True))], "vslot int, shard int, start long")
    before = Window.partitionBy("vslot").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("vslot", "chunk").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("vslot", "chunk").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(inside).cast("long") - 1)
        .join(chunks.drop("n"), ["vslot", "chunk"])
        .join(F.broadcast(slots), "vslot")  # n_slots rows
        .withColumn("slot", F.col("start") + F.col("ahead") + F.col("place"))
    )


def shard_documents(spark: SparkSession, docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, name: str = "documents") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version of every row.

    name: of the stored map, in the shared folder; each number of shards has a map of its own.
    """
    sizes = staged(measured(docs), "sizes")
    rows = staged(with_slots(sizes, n_slots, hot=staged(hot_ids(sizes, n_slots), "hot-ids")), "slots")
    size, count = slot_weights(rows, n_slots)
    path = f"{shared_dir(spark)}/tracequarry/shardmap-{name}-{n_shards}-{n_slots}"
    stored = latest_map(spark, path, n_slots)
    version, shard = stored or (1, initial_map(n_slots, n_shards))
    if stored is None:
        save_map(spark, path, 1, shard, size, count)
    edited = rebalanced(shard, size, n_shards)
    if (edited != shard).any():
        version, shard = version + 1, edited
        save_map(spark, path, version, shard, size, count)
    return placed(rows, shard, count).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"),
    )


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, n_slots: int = N_SLOTS, id_col: str = "doc_id", hot: DataFrame | None = None) -> None:
    """Writes whole rows to one folder for each shard; large shards have several files. hot: ids whose rows are spread over slots, as hot_ids() finds them."""
    (
        with_slots(docs.withColumnRenamed("vslot", "_own_vslot"), n_slots, id_col, hot)
        .withColumnRenamed("vslot", "_vslot").withColumnRenamed("_own_vslot", "vslot")
        .join(F.broadcast(slot_map.select(F.col("vslot").alias("_vslot"), F.col("shard").alias("_shard"))), "_vslot")
        .drop("_vslot")
        .hint("rebalance", "_shard")
        .write.partitionBy("_shard")
        .parquet(path)
    )
