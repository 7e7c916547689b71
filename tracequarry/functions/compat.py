"""Expressions whose results follow the reference engine's rules rather than Spark's."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ref_round(x: Column, digits: int = 0) -> Column:
    """Round by scaling: Spark's own round goes through decimals and differs on binary ties."""
    scale = F.lit(float(10**digits))
    return F.round(x.cast("double") * scale, 0) / scale


def text_to_int(text: Column) -> Column:
    """A number written as text, halves away from zero; null if it is none."""
    value = F.round(text.try_cast("double"), 0)
    return F.when(F.abs(value) <= 2147483647, value.cast("int"))


def number_to_int(x: Column) -> Column:
    """A number to the nearest integer, halves to even."""
    value = F.bround(x.cast("double"), 0)
    return F.when(F.abs(value) <= 2147483647, value.cast("int"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double, null where whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(condition: Column, digits: int = 2) -> Column:
    """Aggregate: share of rows for which condition holds, in percent."""
    return ref_round(F.sum(F.when(condition, 1).otherwise(0)) * 100.0 / F.count("*"), digits)


def rate(flag: Column, digits: int = 3) -> Column:
    """Aggregate: mean of a flag over the rows that have it."""
    return ref_round(F.avg(flag.cast("int")), digits)


def last_order(*names: str) -> list[Column]:
    """Ascending, nulls last, as the reference engine sorts."""
    return [F.col(n).asc_nulls_last() for n in names]


def plain_path(path: Column) -> Column:
    """A file path without scheme and escapes, from _metadata.file_path."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")
