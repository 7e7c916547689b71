"""A catalogue's lint: what is registered against what schema texts create, what files lie there, and what the session knows."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions.compat import plain_path

_CREATE = r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(VIEW|TABLE)\s+(?:IF\s+NOT\s+EXISTS\s+)?([A-Za-z_][\w.]*)"
#: A name after FROM or JOIN that is not a function's, and names that a statement gives to its own parts.
_READ = r"(?i)\b(?:FROM|JOIN)\s+([A-Za-z_][\w.]*)(?![\w.]*\s*\()"
_OWN = r"(?i)\b([A-Za-z_]\w*)\s+AS\s*(?:MATERIALIZED\s*)?\("


def _plain(sql: Column) -> Column:
    """SQL without comments and quoted texts, whose words are no names."""
    return F.regexp_replace(sql, r"'[^']*'|--[^\n]*|/\*[\s\S]*?\*/", " ")


def schema_objects(spark: SparkSession, path: str) -> DataFrame:
    """name, kind (view or table), file and reads (the names that it is made from) of every object that SQL files under path create."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.sql", recursiveFileLookup=True).select(_plain(F.col("value")).alias("sql"), plain_path(F.col("_metadata.file_path")).alias("file"))
    statements = files.select("file", F.explode(F.split("sql", ";")).alias("sql")).filter(F.col("sql").rlike(_CREATE))
    names = lambda p: F.transform(F.regexp_extract_all("sql", F.lit(p), F.lit(1)), F.lower)
    reads = F.array_sort(F.array_distinct(F.array_except(names(_READ), names(_OWN))))
    return statements.select(F.lower(F.regexp_extract("sql", _CREATE, 2)).alias("name"), F.lower(F.regexp_extract("sql", _CREATE, 1)).alias("kind"), "file", reads.alias("reads"))


def data_files(spark: SparkSession, root: str) -> DataFrame:
    """name (the path below root) of every Parquet file, from the listing alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(root)
    return files.select(F.regexp_replace(plain_path(F.col("path")), "^" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("name"))


def session_objects(spark: SparkSession) -> DataFrame:
    """name of every table and view that the session has."""
    return spark.createDataFrame([(x.name.lower(),) for x in spark.catalog.listTables()], "name string")


def lint(registry: DataFrame, objects: DataFrame, files: DataFrame, session: DataFrame | None = None) -> DataFrame:
    """name, problem: everything in which the catalogue, the schema texts, the files and the session do not agree; no row if they do.

    registry: name, kind, where kind is view, table, parquet or external (read from elsewhere, and not looked for).
    """
    known = registry.select(F.when(F.col("kind") == "parquet", F.col("name")).otherwise(F.lower("name")).alias("name"), "kind").distinct()
    made, listed = known.filter(F.col("kind").isin("view", "table")), known.filter("kind = 'parquet'")
    created = objects.select("name", F.col("kind").alias("_kind")).distinct()
    reads = objects.select(F.col("name").alias("_by"), F.explode("reads").alias("name")).join(created.select("name").distinct(), "name", "left_anti").join(known.select("name").distinct(), "name", "left_anti")
    twice = objects.groupBy("name").agg(F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_set("file")), ", ").alias("_files")).filter("_n > 1")

    def told(df: DataFrame, problem: Column) -> DataFrame:
        return df.select("name", problem.alias("problem"))

    found = [
        told(created.join(known, "name", "left_anti"), F.lit("created but not registered")),
        told(made.join(created, "name", "left_anti"), F.lit("registered but not created")),
        told(made.join(created, "name").filter("kind <> _kind"), F.concat(F.lit("registered as "), F.col("kind"), F.lit(" but created as "), F.col("_kind"))),
        told(files.join(listed, "name", "left_anti"), F.lit("file not registered")),
        told(listed.join(files, "name", "left_anti"), F.lit("registered file is not there")),
        told(reads, F.concat(F.lit("read by "), F.col("_by"), F.lit(" but made by nothing"))),
        told(twice, F.concat(F.lit("created more than once, in "), F.col("_files"))),
        told(known.groupBy("name").agg(F.count("*").alias("_n")).filter("_n > 1"), F.lit("registered as several kinds")),
    ]
    if session is not None:
        found.append(told(created.select("name").distinct().join(session, "name", "left_anti"), F.lit("created but unknown to the session")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
