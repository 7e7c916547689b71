"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

A document is its token ids and an end id. Documents longer than a sequence are
cut into full pieces and a last one. Pieces are dealt at random into blocks of about BLOCK
rows, and each block is packed by one task: a sequence is filled greedily with
the longest piece that fits, then its smallest piece is exchanged for the two unpacked ones
that fill the larger gap best, if they fill it more tightly. Only lengths and
checksums are shuffled. Texts come to the tokenizer in batches of BATCH_BYTES, and a task gives back what it no longer needs. A block leaves one loosely filled sequence at most, so blocks cost
next to nothing against packing all together.

Defined results: a null or empty text is the end id alone; repeated rows are
separate documents; ties go to the piece that comes first by (doc_id,
piece, checksum); other columns are ignored, whatever their names; an empty table gives
an empty result.
"""

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, pieces_of, small_batches, staged, text_slices
from .wordpieces import Words, per_worker

CAPACITY, END_ID = 2048, 0
BLOCK = 32768
#: Text that Spark hands to a worker at once; only one text alone has more.
BATCH_BYTES = "4m"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    step, last = 4 * capacity, np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_worker(("words", tokenizer), lambda: Words(tokenizer))
        for batch in batches:
            for slice_, texts in text_slices(batch):
                out = []
                for doc_id, text in zip(slice_.column("doc_id").to_pylist(), texts, strict=True):
                    ids = words.encode(text) + last
                    for i, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        out.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each item; every length is from 1 to capacity."""
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        waiting.setdefault(int(lengths[i]), []).append(i)
    sizes = sorted(waiting)

    def take(size: int) -> int:
        item = waiting[size].pop()
        if not waiting[size]:
            del waiting[size]
            del sizes[bisect_left(sizes, size)]
        return item

    def put_back(size: int, item: int) -> None:
        if size not in waiting:
            waiting[size] = []
            sizes.insert(bisect_left(sizes, size), size)
        waiting[size].append(item)

    number = 0
    while sizes:
        held, gap = [], capacity
        while sizes and sizes[0] <= gap:
            size = sizes[bisect_right(sizes, gap) - 1]
            held.append((size, take(size)))
            gap -= size
        if gap and sizes and len(held) > 1:
            small = min(held)
            room = gap + small[0]
            best, pair = small[0], None
            low, high = 0, bisect_right(sizes, room) - 1
            while low <= high:
                total = sizes[low] + sizes[high]
                if total > room:
                    high -= 1
                elif low == high and len(waiting[sizes[low]]) < 2:
                    break
                else:
                    if total > best:
                        best, pair = total, (sizes[low], sizes[high])
                        if total == room:
                            break
                    low += 1
            if pair:
                held.remove(small)
                held += [(size, take(size)) for size in pair]
                put_back(*small)
        at = 0
        for size, item in held:
            bins[item], places[item] = number, at
            at += size
        number += 1
    return bins, places


def packed(found: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """found's columns, sequence_id and offset for every piece."""
    with small_batches(found.sparkSession, size=BATCH_BYTES):
        rows = staged(found, "pieces")
    n_blocks = pieces_of(rows.sparkSession, rows.count(), block)

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        bins, places = best_two_fit(part["length"].to_numpy(), capacity)
        return part.drop(columns="_block").assign(sequence_id=(int(key[0]) << 32) + bins, offset=places)

    # Row numbers of the written pieces are hashed, so that repeated rows spread too.
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)))
    return dealt.groupBy("_block").applyInPandas(pack, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    return packed(pieces(docs, tokenizer))
