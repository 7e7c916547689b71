"""Shards whose schemas drift: footers are read once, files of one schema are one scan, and all scans are widened to one schema."""

import json
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.functions.compat import plain_path

#: Whole numbers and fractions by how much they hold.
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Under this key Spark writes a file's schema into its footer.
_SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def _footer(path: str) -> str | None:
    """A file's schema as Spark writes it; None where the file's store or one of its types is known to Spark alone."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem
    from pyspark.sql.pandas.types import from_arrow_schema

    try:
        store, name = FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    except (pa.ArrowInvalid, ValueError):
        return None
    meta = pq.read_metadata(name, filesystem=store)
    told = (meta.metadata or {}).get(_SPARK_SCHEMA)
    try:
        schema = T.StructType.fromJson(json.loads(told)) if told else from_arrow_schema(meta.schema.to_arrow_schema(), prefer_timestamp_ntz=True)
    except PySparkException:
        return None
    return _bare(schema).json()


def _bare(kind: T.DataType) -> T.DataType:
    """A type without what does not tell files apart: nullability and comments. Columns that hold nothing but nulls go, as no reader can ask for them."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _bare(f.dataType)) for f in kind.fields if not isinstance(f.dataType, T.NullType)])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_bare(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(_bare(kind.keyType), _bare(kind.valueType))
    return kind


def schema_groups(spark: SparkSession, paths: Sequence[str]) -> list[tuple[T.StructType, list[str]]]:
    """(schema, files) of all Parquet files under paths, in the order of their first files. Footers are read by tasks; the driver sees names and schemas."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(paths)).select("path")

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "schema": [_footer(p) for p in batch["path"]]})

    groups: dict[str, list[str]] = {}
    unknown: list[str] = []
    for r in files.mapInPandas(footers, "path string, schema string").groupBy("schema").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect():
        if r.schema is None:
            unknown = r.paths
        else:
            groups[r.schema] = r.paths
    with ThreadPoolExecutor(16) as pool:  # what tasks could not open
        for path, schema in zip(unknown, pool.map(lambda p: _bare(spark.read.parquet(p).schema).json(), unknown), strict=True):
            groups.setdefault(schema, []).append(path)
    return sorted(((T.StructType.fromJson(json.loads(s)), sorted(p)) for s, p in groups.items()), key=lambda g: g[1][0])


def common_type(a: T.DataType, b: T.DataType, at: str = "") -> T.DataType:
    """The least type that holds both; an error where there is none.

    Whole numbers widen, with fractions they become doubles; dates become timestamps; any plain type and text become text; structs have the fields of
    both, whose names are the same whatever their case.
    """
    if a == b:
        return a
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        fields = {f.name.lower(): f for f in a.fields}
        for f in b.fields:
            mine = fields.get(f.name.lower())
            fields[f.name.lower()] = f if mine is None else T.StructField(mine.name, common_type(mine.dataType, f.dataType, f"{at}.{f.name}".lstrip(".")))
        return T.StructType(list(fields.values()))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType, at))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType, at), common_type(a.valueType, b.valueType, at))
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return max(a, b, key=lambda t: _WHOLE.index(type(t)))
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        both = [_as_decimal(t) for t in (a, b)]
        if None in both:
            return T.DoubleType()
        scale, whole = max(t.scale for t in both), max(t.precision - t.scale for t in both)
        return T.DecimalType(scale + whole, scale) if scale + whole <= 38 else T.DoubleType()
    dates = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, dates) and isinstance(b, dates):
        return max(a, b, key=lambda t: dates.index(type(t)))
    nested = (T.StructType, T.ArrayType, T.MapType)
    if isinstance(a, T.StringType) != isinstance(b, T.StringType) and not isinstance(a, nested) and not isinstance(b, nested):
        return T.StringType()
    raise ValueError(f"column {at}: {a.simpleString()} and {b.simpleString()} have no common type")


def _as_decimal(kind: T.DataType) -> T.DecimalType | None:
    if isinstance(kind, T.DecimalType):
        return kind
    return T.DecimalType((3, 5, 10, 20)[_WHOLE.index(type(kind))], 0) if isinstance(kind, _WHOLE) else None


def fitted(value: Column, a: T.DataType, b: T.DataType) -> Column:
    """A value of type a as one of the wider type b; fields that a lacks are null."""
    if a == b:
        return value
    if isinstance(a, T.StructType):
        mine = {f.name.lower(): f for f in a.fields}
        fields = [
            (fitted(value.getField(mine[f.name.lower()].name), mine[f.name.lower()].dataType, f.dataType) if f.name.lower() in mine else F.lit(None).cast(f.dataType)).alias(f.name) for f in b.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(a, T.ArrayType):
        return F.transform(value, lambda x: fitted(x, a.elementType, b.elementType))
    if isinstance(a, T.MapType):
        pairs = F.transform(F.map_entries(value), lambda e: F.struct(fitted(e["key"], a.keyType, b.keyType), fitted(e["value"], a.valueType, b.valueType)))
        return F.map_from_entries(pairs)
    return value.cast(b)


def drift_report(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """column, type, n_files, widened of every column and nested field under paths: in how many files it has which type, and the type that a reader of all of them gets.

    A field whose counts do not add up to the number of files is missing in the others. One for which there is no common type has none, so that it can be found.
    """
    told: dict[tuple[str, str], int] = {}
    kinds: dict[str, list[T.DataType]] = {}
    for schema, files in schema_groups(spark, paths):
        for name, kind in _fields(schema):
            told[name, kind.simpleString()] = told.get((name, kind.simpleString()), 0) + len(files)
            kinds.setdefault(name, []).append(kind)
    rows = [(name, kind, n, _common_or_none(kinds[name])) for (name, kind), n in told.items()]
    return spark.createDataFrame(rows, "column string, type string, n_files long, widened string")


def _fields(kind: T.DataType, at: str = "") -> Iterator[tuple[str, T.DataType]]:
    """Names, by their path and in lower case, and types of all fields; an array's elements are at its name and `[]`, a map's keys and values at `{}`."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            name = f"{at}.{f.name.lower()}".lstrip(".")
            if not isinstance(f.dataType, T.StructType):
                yield name, f.dataType
            yield from _fields(f.dataType, name)
    elif isinstance(kind, T.ArrayType):
        yield from _fields(kind.elementType, f"{at}[]")
    elif isinstance(kind, T.MapType):
        yield from _fields(kind.keyType, f"{at}{{}}")
        yield from _fields(kind.valueType, f"{at}{{}}")


def _common_or_none(kinds: list[T.DataType]) -> str | None:
    try:
        return reduce(common_type, kinds).simpleString()
    except ValueError:
        return None


def read_drifting(spark: SparkSession, paths: Sequence[str], source_file: bool = False) -> DataFrame:
    """All Parquet files under paths as one table: one scan for each schema, columns in the order in which they first come, missing ones null.

    Scans read the columns that are asked for only. source_file adds `_source_file`. No file gives an error, as there is no schema.
    """
    groups = schema_groups(spark, paths)
    if not groups:
        raise ValueError(f"no Parquet file under {', '.join(paths)}")
    whole = reduce(common_type, [schema for schema, _ in groups])
    frames = []
    for schema, files in groups:
        mine = {f.name.lower(): f for f in schema.fields}
        columns = [
            (fitted(F.col(f"`{mine[f.name.lower()].name}`"), mine[f.name.lower()].dataType, f.dataType) if f.name.lower() in mine else F.lit(None).cast(f.dataType)).alias(f.name) for f in whole.fields
        ]
        more = [plain_path(F.col("_metadata.file_path")).alias("_source_file")] if source_file else []
        frames.append(spark.read.schema(schema).parquet(*files).select(*columns, *more))
    return reduce(DataFrame.union, frames)
