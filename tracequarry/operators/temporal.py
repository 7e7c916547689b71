"""Joins in time: intervals that overlap, and the latest row of another table. Keys are cut into time cells, so a hot key is spread over tasks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A level's cells are so many times longer than those of the level before.
STEP = 4


def micros(x: Column | str) -> Column:
    """A time as a whole number; numbers stay as they are."""
    c = F.col(x) if isinstance(x, str) else x
    return F.unix_micros(c.cast("timestamp"))


def _spanned(df: DataFrame, ends: tuple[Column, Column], cell: int) -> DataFrame:
    """df with its interval and the level whose cells are at least as long; intervals that are empty or lack an end go."""
    rows = df.withColumns({"_s": ends[0].cast("long"), "_e": ends[1].cast("long")}).filter("_s < _e")
    own = F.ceil(F.log(F.greatest((F.col("_e") - F.col("_s")) / F.lit(cell), F.lit(1.0))) / F.log(F.lit(float(STEP))))
    return rows.withColumn("_own", own.cast("int"))


def _celled(rows: DataFrame, levels: Column, cell: int) -> DataFrame:
    """A row for each cell that an interval touches at each of the given levels: two or three at most, as no level is below its own."""
    at = rows.withColumn("_level", F.explode(levels))
    size = F.lit(cell) * F.pow(F.lit(STEP), F.col("_level")).cast("long")
    ends = at.withColumns({"_lo": F.floor(F.col("_s") / size), "_hi": F.floor((F.col("_e") - 1) / size)})
    return ends.withColumn("_cell", F.explode(F.sequence("_lo", "_hi")))


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], a_ends: tuple[Column, Column], b_ends: tuple[Column, Column], cell: int) -> DataFrame:
    """Pairs of rows of equal keys whose half-open intervals overlap; the tables' other columns must have names of their own.

    Ends are whole numbers (for times, `micros`), cell a length in their unit. An interval lies in the cells of the first level that are as long as itself, and is looked for from all higher ones, so
    a long one does not take many cells. A pair meets at the higher of its two levels, in the first cell that both touch, so it is found once.
    A key's rows are dealt out by key, level and cell; only rows whose cells are the same are ever compared, and two that are both looking are not.
    """
    clash = (set(a.columns) & set(b.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    left, right = _spanned(a, a_ends, cell), _spanned(b, b_ends, cell)
    top = max(x.agg(F.coalesce(F.max("_own"), F.lit(0))).first()[0] for x in (left, right))
    home = lambda rows: _celled(rows, F.array("_own"), cell)
    looking = lambda rows: _celled(rows.filter(F.col("_own") < top), F.sequence(F.col("_own") + 1, F.lit(top)), cell)
    plain = lambda rows, side, other: rows.select(*keys, *[c for c in other.columns if c not in keys], *[F.col(c).alias(f"_{side}{c}") for c in ("_s", "_e", "_lo")], "_level", "_cell")

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        pairs = x.join(y, [*keys, "_level", "_cell"])
        return pairs.filter((F.col("_a_s") < F.col("_b_e")) & (F.col("_b_s") < F.col("_a_e")) & (F.col("_cell") == F.greatest("_a_lo", "_b_lo")))

    # The higher level is a's, or both are at one; or it is b's.
    found = met(plain(home(left), "a", a), plain(home(right).unionByName(looking(right)), "b", b)).unionByName(met(plain(looking(left), "a", a), plain(home(right), "b", b)))
    return found.select(*keys, *[c for c in a.columns if c not in keys], *[c for c in b.columns if c not in keys])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: Column, right_at: Column, cell: int, tie: list[str] | None = None) -> DataFrame:
    """left with the columns of the latest row of right, of the same keys, at or before each row's time; null where there is none, where a key or the time is null.

    Of rows of right at one time the last by `tie` is taken. Within a cell of time, rows of both tables are put in one order; what came before the cell is known by the
    last row of each earlier cell, of which a key has as many as its time has cells, however many rows it has. The tables' other columns must have names of their own.
    """
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    mine, theirs = ([c for c in x.columns if c not in keys] for x in (left, right))
    order = F.struct(*[F.col(c) for c in tie or theirs])
    l_rows = left.select(*keys, left_at.cast("long").alias("_at"), F.lit(1).alias("_kind"), F.struct(F.lit(1), *mine).alias("_l"))
    r_rows = right.filter(right_at.isNotNull()).select(*keys, right_at.cast("long").alias("_at"), F.lit(0).alias("_kind"), F.struct(F.lit(1), *theirs).alias("_r"), order.alias("_tie"))
    rows = l_rows.unionByName(r_rows, allowMissingColumns=True).withColumn("_cell", F.floor(F.col("_at") / cell))
    latest = F.max_by("_r", F.when(F.col("_kind") == 0, F.struct("_at", "_tie")))
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = rows.groupBy(*keys, "_cell").agg(latest.alias("_last"))
    carried = cells.select(*keys, "_cell", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    upto = Window.partitionBy(*keys, "_cell").orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_here", F.last("_r", ignorenulls=True).over(upto)).filter("_kind = 1")
    same = [placed[c].eqNullSafe(carried[c]) for c in (*keys, "_cell")]
    known = F.reduce(F.array(*[F.col(k).isNotNull() for k in keys], F.col("_at").isNotNull()), F.lit(True), lambda x, y: x & y)
    out = placed.join(carried, same, "left").select(*[placed[k].alias(k) for k in keys], placed["_at"], "_l", F.coalesce("_here", "_carried").alias("_r"))
    return out.withColumn("_r", F.when(known, F.col("_r"))).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in mine], *[F.col(f"_r.{c}").alias(c) for c in theirs])
