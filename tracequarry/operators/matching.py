"""Every match of a pattern in a text, where it is, and whether another pattern is near it."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pieces(text: Column, pattern: str, kind: int) -> Column:
    """For each match: the length and line ends of the text between it and the match before, and itself. The pattern must not match an empty text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.regexp_count(p, F.lit("\n")).alias("lines")))
    # There is one gap more than matches, after the last.
    zipped = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g["n"].alias("gap"), g["lines"].alias("gap_lines"), m.alias("match")))
    return F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), z["gap"].alias("gap"), z["gap_lines"].alias("gap_lines"), z["match"].alias("match")))


def _placed(df: DataFrame, keys: list[str], text: str, patterns: list[str]) -> DataFrame:
    """keys, _row, kind, at, n, match, line of every match of each pattern: lengths of what lies before are summed up, in one pass over each text."""
    t = F.coalesce(F.col(text), F.lit(""))
    every = F.concat(*[_pieces(t, p, kind) for kind, p in enumerate(patterns)])
    rows = df.select(*keys, F.monotonically_increasing_id().alias("_row"), every.alias("_all")).select(*keys, "_row", F.explode("_all").alias("_m")).select(*keys, "_row", "_m.*")
    # Rows of a text go together once; texts themselves stay where they are.
    rows = rows.repartition("_row")
    before = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    n, lines = F.length("match"), F.regexp_count("match", F.lit("\n"))
    return rows.select(
        *keys, "_row", "kind", (F.sum(F.col("gap") + n).over(before) - n + 1).alias("at"), n.cast("long").alias("n"), "match",
        (F.sum(F.col("gap_lines") + lines).over(before) - lines + 1).alias("line"),
    )


def match_positions(df: DataFrame, keys: list[str], text: str, pattern: str) -> DataFrame:
    """keys, at, n, match, line of every match: the place of its first character and its line, both from 1, and its length."""
    return _placed(df, keys, text, [pattern]).drop("_row", "kind")


def matches_near(df: DataFrame, keys: list[str], text: str, pattern: str, other: str, width: int = 600) -> DataFrame:
    """Every match of pattern, with `near`: whether a match of other lies wholly within `width` characters before its start and after it.

    Matches of both are merged in the order of their places; those of a text meet in a sliding range, never pair by pair.
    """
    rows = _placed(df, keys, text, [pattern, other])
    around = Window.partitionBy("_row").orderBy("at").rangeBetween(-width, width)
    first_end = F.min(F.when(F.col("kind") == 1, F.col("at") + F.col("n"))).over(around)
    near = F.coalesce(first_end <= F.col("at") + width, F.lit(False))
    return rows.withColumn("near", near).filter("kind = 0").drop("_row", "kind")


def with_line_text(matches: DataFrame, df: DataFrame, keys: list[str], text: str, most: int = 110) -> DataFrame:
    """matches with `context`, the first characters of the trimmed line of each. Keys must tell texts apart."""
    lines = df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_at", "_text"))
    # Lines are cut short before they move.
    told = lines.select(*keys, (F.col("_at") + 1).cast("long").alias("line"), F.substring(F.trim("_text"), 1, most).alias("context"))
    wanted = matches.select(*keys, "line").distinct()
    return matches.join(told.join(wanted, [*keys, "line"], "left_semi"), [*keys, "line"])


def hits_by_unit(matches: DataFrame, unit: str, order: list[str], told: list[str], first: int = 4) -> DataFrame:
    """unit, n_hits, hard (a match with nothing near it), and, for the first few matches in order, what is told of each.

    Counts combine before they move, and no unit's matches are brought together.
    """
    groups = matches.groupBy(unit).agg(F.count("*").alias("n_hits"), F.bool_or(~F.col("near")).alias("hard"))
    place = F.row_number().over(Window.partitionBy(unit).orderBy(*order))
    each = matches.select(unit, F.concat_ws(":", *[F.col(c).cast("string") for c in told]).alias("_told"), place.alias("_place")).filter(F.col("_place") <= first)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_place", "_told"))), lambda x: x["_told"])
    return groups.join(each.groupBy(unit).agg(F.concat_ws(",", listed).alias("first_hits")), unit)
