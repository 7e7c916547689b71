"""Comparing patches by what they change, not by how they are written."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space within a line, in runs.
_BLANK = r"[ \t\f\r]+"


def hunks(patch: Column) -> Column:
    """path, removed, added of each hunk of a unified diff.

    Lines are trimmed and their white space is made one; blank lines, context, line numbers and file heads go, and so do hunks that change nothing then.
    """
    files = F.slice(F.split(F.concat(F.lit("\n"), F.regexp_replace(patch, "\r\n", "\n")), r"\ndiff --git "), F.lit(2), F.lit(1 << 30))

    def of_file(file: Column) -> Column:
        path = F.regexp_extract(file, r"^\S+ b/(\S+)", 1)
        parts = F.slice(F.split(file, r"\n@@[^\n]*"), F.lit(2), F.lit(1 << 30))
        return F.transform(parts, lambda part: F.struct(path.alias("path"), _changed(part, "-").alias("removed"), _changed(part, "+").alias("added")))

    return F.filter(F.flatten(F.transform(files, of_file)), lambda h: (F.size(h["removed"]) > 0) | (F.size(h["added"]) > 0))


def _changed(part: Column, sign: str) -> Column:
    lines = F.filter(F.split(part, "\n"), lambda x: x.startswith(sign))
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.substring(x, 2, 1 << 30), _BLANK, " ")))
    return F.filter(bare, lambda x: x != "")


def canonical(patch: Column) -> Column:
    """A digest that patches share if they have the same hunks in any order; null for a null patch, and one digest for all that change nothing."""
    told = F.transform(hunks(patch), lambda h: F.sha2(F.concat_ws("\n", h["path"], F.concat_ws("\n-", F.array(F.lit("")), h["removed"]), F.concat_ws("\n+", F.array(F.lit("")), h["added"])), 256))
    return F.when(patch.isNotNull(), F.sha2(F.array_join(F.array_sort(told), ","), 256))


def differs(patch: Column, gold: Column) -> Column:
    """Whether two patches change different things; null if one is missing."""
    return canonical(patch) != canonical(gold)
