"""Reading tables and cutting lineage in the folder that the cluster shares."""

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, `[\x20\x09-\x0D]`.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on a local master; elsewhere an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all of the cluster shares")
        found = tempfile.mkdtemp(prefix="tracequarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracequarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_slices(batch: pa.RecordBatch, column: str = "text", rows: int = 500) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch of whole texts in slices, each with its texts as Python strings, so that few of these are there at once."""
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part, part.column(column).to_pylist()


def give_back() -> None:
    """Memory of this Python worker that is free goes back to the system: workers outlive their tasks, several of them on an executor, and would hold it while others work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


#: What a Python worker may keep of the memory that it frees, in holding_memory(); and what it may later.
HELD_BYTES, HELD_AFTER = 128 << 20, 8 << 20


@contextmanager
def holding_memory() -> Iterator[None]:
    """Inside, this Python worker keeps what its arrays free for the next ones, up to HELD_BYTES; afterwards it gives back what is free.

    Else arrays that are made anew for each batch go back to the system after each, and come again page by page.
    """
    set_to = getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)  # not in every C library
    trim, pad, mapped = -1, -2, -3  # glibc's M_TRIM_THRESHOLD, M_TOP_PAD, M_MMAP_THRESHOLD
    for what, size in ((trim, HELD_BYTES), (pad, HELD_BYTES // 8), (mapped, HELD_BYTES // 4)):
        set_to(what, size)
    try:
        yield
    finally:
        for what, size in ((trim, HELD_AFTER), (pad, HELD_AFTER // 64), (mapped, HELD_AFTER // 2)):
            set_to(what, size)
        give_back()


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id written as text, the contracts' fold of a document."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def pieces_of(spark: SparkSession, rows: int, each: int, least: int = 1) -> int:
    """How many parts of about `each` rows a number of rows makes."""
    return max(least, -(-rows // each))


#: The table whose keys filter the other side of a join is read in one go for that, up to this size; beyond it the join goes unfiltered.
FILTER_TABLE = "1g"


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def filtering_joins(spark: SparkSession):
    """Inside, Spark filters a join's large side by a Bloom filter of the small side's keys before it is shuffled.

    The filter is Spark's own and of bounded size (8 MB at most): only rows without a partner go, so the result is the same.
    The small side has to have a filter of its own. Joins must be written inside.
    """
    base = "spark.sql.optimizer.runtime.bloomFilter."
    return _settings(spark, {base + "enabled": "true", base + "applicationSideScanSizeThreshold": "0", base + "creationSideThreshold": FILTER_TABLE})


def small_batches(spark: SparkSession, rows: int = 2000, size: str | None = None):
    """Inside, Python workers get whole texts in batches of so many rows, and of about so many bytes, at most; what reads them must be written inside."""
    base = "spark.sql.execution.arrow."
    return _settings(spark, {base + "maxRecordsPerBatch": str(rows)} | ({base + "maxBytesPerBatch": size} if size else {}))
