"""Exact dedup by an extendible-hash index on shared files.

Segments of the index (key, bytes, id, length) are written once to the shared folder. Copies meet first as narrow rows:
each task combines its own entries of one key, digest and length, so a text that a third of all rows share is one entry
for each task. The directory starts with one bucket and doubles while a bucket holds too many entries: a bucket is a
prefix of the key's bits, and its local depth is the least at which it fits; only overfull buckets are looked at again
with more bits, so the depth has no end but the key's. Entries find their bucket in the directory and are dealt out by
it: a task owns the key ranges of its buckets and chains the entries of one key. Only texts whose key occurs more than
once are moved, to be grouped by their bytes; all others are known to stand alone. Everything is DataFrame functions.

Defined results: a null text counts as empty, and all empty texts are copies;
of equal texts the longest original in code points stays, then the smallest
id; texts of any length are hashed and compared whole; a null id is kept only if no other row of equal length has an id; rows that
repeat an id each get a row; other columns are ignored; an empty table gives
an empty result.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, filtering_joins, staged

#: Bits that overfull buckets are given at once, and entries that a bucket may hold.
BITS = 8
BUCKET_ROWS = 4096
KEY_BITS = 64
#: Above any id's distance from it; below the step that a code point makes.
_ID_BASE, _STEP = 10**19, 10**20


def stripped(text: Column) -> Column:
    """Text without any ASCII white space. Byte-wise replacing is the cheapest form."""
    out = F.coalesce(text, F.lit(""))
    for c in WHITE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def key_of(norm: Column) -> Column:
    return F.xxhash64(norm)


def segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index's entries, written to shared files: doc_id, key, bytes and their digest, and the rank that decides who stays."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        stripped(F.col(text_col)).alias("norm"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
    )
    rank = F.expr(f"cast(n_points as decimal(12,0)) * {_STEP}BD + coalesce({_ID_BASE}BD - cast(doc_id as decimal(20,0)), 0BD)")
    rows = rows.withColumn("key", key_of(F.col("norm"))).withColumn("text_sha256", F.sha2(F.col("norm").cast("binary"), 256))
    return staged(rows.withColumn("n_bytes", F.octet_length("norm")).withColumn("rank", rank.cast("decimal(38,0)")).drop("n_points"), "dedup-index")


def _prefix(key: Column, depth: Column) -> Column:
    """The first bits of a key; none at depth 0, where a shift by all bits would keep them."""
    return F.when(depth > 0, F.call_function("shiftrightunsigned", key, F.lit(KEY_BITS) - depth)).otherwise(F.lit(0).cast("long"))


def directory(entries: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(depth, bucket, n) of every used bucket; bucket: the first `depth` bits of its keys.

    A bucket's local depth is the least at which it has at most bucket_rows entries. One key that alone has more is a bucket of all its bits.
    """
    whole = entries.agg(F.count("*").alias("n")).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("bucket"), "n").filter("n > 0")
    found, full, depth = staged(whole, "dedup-directory"), None, 0
    full, found = found.filter(F.col("n") > bucket_rows), found.filter(F.col("n") <= bucket_rows)
    while depth < KEY_BITS and not full.isEmpty():
        # Overfull buckets double: their entries are counted by BITS more bits, and of these as few are used as will do.
        inside = entries.withColumn("bucket", _prefix(F.col("key"), F.lit(depth))).join(full.select("bucket"), "bucket", "left_semi")
        cells = inside.groupBy(_prefix(F.col("key"), F.lit(depth + BITS)).alias("cell")).agg(F.count("*").alias("n"))
        cells = staged(cells, "dedup-cells")
        by_depth = cells.select("cell", "n", F.explode(F.sequence(F.lit(depth + 1), F.lit(depth + BITS))).alias("depth"))
        by_depth = by_depth.withColumn("bucket", F.call_function("shiftrightunsigned", F.col("cell"), F.lit(depth + BITS) - F.col("depth")))
        sums = by_depth.groupBy("depth", "bucket").agg(F.sum("n").alias("n"), F.min("cell").alias("cell"))
        fits = sums.filter((F.col("n") <= bucket_rows) | (F.col("depth") == depth + BITS))
        # A bucket that fits is used unless a shorter one of its bits does.
        shorter = by_depth.drop("n").join(fits.select("depth", "bucket"), ["depth", "bucket"]).groupBy("cell").agg(F.min("depth").alias("least"))
        level = staged(fits.join(shorter, "cell").filter("depth = least").select("depth", "bucket", "n"), "dedup-directory")
        depth += BITS
        full = level.filter(F.col("n") > bucket_rows) if depth < KEY_BITS else level.limit(0)
        found = found.union(level.filter(F.col("n") <= bucket_rows) if depth < KEY_BITS else level)
    return staged(found, "dedup-directory")


def owned(entries: DataFrame, buckets: DataFrame) -> DataFrame:
    """entries with their bucket, its depth, and `chain`, the number of entries of their key; dealt out by bucket."""
    depths = [r.depth for r in buckets.select("depth").distinct().collect()]  # KEY_BITS at most
    placed = entries.withColumn("depth", F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")))
    placed = placed.withColumn("bucket", _prefix(F.col("key"), F.col("depth"))).join(buckets.select("depth", "bucket"), ["depth", "bucket"])
    return placed.repartition("depth", "bucket").withColumn("chain", F.count("*").over(Window.partitionBy("depth", "bucket", "key")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    index = segments(docs, id_col, text_col)
    entries = staged(index.groupBy("key", "text_sha256", "n_bytes").agg(F.count("*").alias("copies")), "dedup-entries")
    chains = staged(owned(entries, directory(entries.select("key"), bucket_rows)), "dedup-chains")
    met = chains.filter("copies > 1 or chain > 1").select("key", "depth", "bucket").distinct()
    met = staged(met, "dedup-met").filter("depth >= 0")
    with filtering_joins(index.sparkSession):
        # Written as it comes out of the join, so that Spark can split the part of a text with very many copies; its
        # copies then meet in each task before the shuffle by bytes.
        texts = staged(index.select("key", "text_sha256", "norm", "rank").join(met, "key"), "dedup-texts")
    groups = texts.groupBy("bucket", "depth", "key", "text_sha256", "norm").agg(F.count("*").alias("group_size"), F.max("rank").alias("best"))
    groups = groups.filter("group_size > 1").select(
        "key", "text_sha256", "group_size",
        F.expr(f"if(best % {_STEP}BD > 0, cast({_ID_BASE}BD - best % {_STEP}BD as bigint), null)").alias("keep_id"),
    )
    groups = staged(groups, "dedup-groups").withColumn("found", F.lit(True))
    # Both sides are read from files, so Spark can split the part of a text with very many copies.
    told = index.select("doc_id", "key", "text_sha256").join(groups, ["key", "text_sha256"], "left")
    return told.select(
        "doc_id", F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("found").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat an id and a text, one."""
    kept = dedup(docs).filter("kept").select(*_row_keys(F.col("text_sha256"))).distinct()
    sha = F.sha2(stripped(F.col("text")).cast("binary"), 256)
    keyed = docs.select(F.struct("*").alias("row"), *_row_keys(sha))  # inside the struct no name can clash
    names = ["_id", "_no_id", "_text_sha"]
    # The join deals rows out by these names, so dropping repeats needs no shuffle of its own.
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).select("row.*")


def _row_keys(sha: Column) -> list[Column]:
    return [F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"), F.col("doc_id").isNull().alias("_no_id"), sha.alias("_text_sha")]
