"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves' rows of a tree domain - language - source. A token
budget goes down the tree by integer weights. A child cannot take more than its
tokens times the most epochs allowed; what it cannot take goes to its siblings
by their weights, and only what a whole family cannot take goes to its parent's
siblings. Each leaf then takes documents in a seeded order, a new order for each epoch, while
the tokens before a document are under its budget: full epochs, then a prefix.

The prefix's end is found without ordering a leaf in one place: tokens are summed
over 4096 ranges of the order's key, then over 4096 ranges inside the one in which a leaf's budget ends, and so on until a
range has few rows; only that is put in order. A leaf that holds a third of all rows is spread over all tasks.

Tokens here are runs of characters other than ASCII white space.

Defined results: a null text has no tokens, and one of any length is counted whole; null languages and sources are the
child `(none)`; names without a weight of their own have DEFAULT_WEIGHT; a weight of 0 gives
nothing; a leaf without tokens is taken once; rows that repeat an id have one place in
the order and are taken together; a null id is ordered as the text `null`;
columns of other names pass unchanged; an empty table gives an empty result.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Parts of a whole; what is not named has DEFAULT_WEIGHT.
WEIGHTS: Mapping[str, Mapping[str, int]] = {
    "domain": {"d0": 500, "d1": 300, "d2": 200},
    "lang": {"en": 400, "fr": 250, "de": 200, "es": 150},
    "source": {},
}
DEFAULT_WEIGHT = 100
BUDGET_SHARE, EPOCHS, SEED, DOMAINS = 0.5, 2, 42, 3
LEVELS = ("domain", "lang", "source")
#: Hex digits of the order's key that name a range, 16 ** 3 ranges for each leaf; rows that a range may have to be put in order.
RANGE_DIGITS, RANGE_ROWS = 3, 100_000


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def leaf_columns(n_domains: int = DOMAINS) -> dict[str, Column]:
    """A row's place in the tree. Domains group sources by checksum; a catalogue of sources would take its place."""
    source = F.coalesce("source", F.lit("(none)"))
    return {
        "_domain": F.concat(F.lit("d"), F.conv(F.substring(F.md5(source.cast("binary")), 1, 6), 16, 10).cast("long") % n_domains),
        "_lang": F.coalesce("lang", F.lit("(none)")),
        "_source": source,
    }


def order_key(epoch: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(str(seed)), epoch.cast("string")).cast("binary"))


def _weight(level: str, weights) -> Column:
    out = F.lit(DEFAULT_WEIGHT).cast("long")
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(f"_{level}") == name, F.lit(w).cast("long")).otherwise(out)
    return out


def _shared_out(nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """nodes with `given`: the parent's `budget` shared out by `weight`, none above its `cap`.

    In the order of cap / weight, children are full up to the first whose fair
    share of what is left is less than its cap; that share's level holds for the rest.
    """
    order = Window.partitionBy(*parent).orderBy("ratio", child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    family = Window.partitionBy(*parent)
    return (
        nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight")).otherwise(F.lit(float("inf"))))
        .withColumn("taken", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.when(F.col("left_weight") > 0, (F.col("budget") - F.col("taken")) / F.col("left_weight")).otherwise(F.lit(0.0)))
        .withColumn("first", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", child, "level"))).over(family)["level"])
        .withColumn("given", F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("first") * F.col("weight"))))
        .drop("ratio", "taken", "left_weight", "level", "first")
    )


def leaf_budgets(rows: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(_domain, _lang, _source, tokens, leaf_budget, full, rest) of every leaf; rows: its columns and n_tokens."""
    cols = [f"_{x}" for x in LEVELS]
    leaves = rows.groupBy(*cols).agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * epochs)
    leaves = staged(leaves, "mix-leaves")
    given = leaves.agg((F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(share)).alias("budget"))
    for depth in range(1, 4):
        nodes = leaves.groupBy(*cols[:depth]).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(LEVELS[depth - 1], weights))
        nodes = nodes.join(F.broadcast(given)) if depth == 1 else nodes.join(given, cols[: depth - 1])  # the root is one row
        given = _shared_out(nodes, cols[: depth - 1], cols[depth - 1]).select(*cols[:depth], F.col("given").alias("budget"), "tokens")
        given = given if depth == 3 else given.drop("tokens")
    return staged(
        given.withColumn("full", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)).cast("int"))
        .withColumn("rest", F.when(F.col("tokens") > 0, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(F.lit(0.0)))
        .withColumnRenamed("budget", "leaf_budget"),
        "mix-budgets",
    )


def cuts(rows: DataFrame, budgets: DataFrame, seed: int = SEED) -> DataFrame:
    """budgets with (cut_key, cut_id): the last document of each leaf's last, partial epoch; null if it takes none."""
    cols = [f"_{x}" for x in LEVELS]
    part = budgets.filter("rest > 0").select(*cols, "full", "rest").withColumns({"start": F.lit(0).cast("long"), "prefix": F.lit("")})
    for digits in range(RANGE_DIGITS, 32, RANGE_DIGITS):  # a key has 32 digits
        # part: in which range of each leaf, named by its first digits, the budget ends, and the tokens before it.
        inside = rows.join(part, cols).withColumn("key", order_key(F.col("full"), seed)).filter(F.col("key").startswith(F.col("prefix")))
        sums = inside.groupBy(*cols, "full", "rest", "start", F.substring("key", 1, digits).alias("range")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"))
        before = Window.partitionBy(*cols).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ends = sums.withColumn("begin", F.col("start") + F.coalesce(F.sum("n").over(before), F.lit(0))).filter("begin < rest")
        ends = ends.groupBy(*cols, "full", "rest").agg(F.max(F.struct("range", "begin", "rows")).alias("end"))
        part = staged(ends.select(*cols, "full", "rest", F.col("end.begin").alias("start"), F.col("end.range").alias("prefix"), F.col("end.rows").alias("rows")), "mix-ranges")
        if part.filter(F.col("rows") > RANGE_ROWS).isEmpty():
            break
        part = part.drop("rows")
    near = (
        rows.join(part.drop("rows"), cols)
        .withColumn("key", order_key(F.col("full"), seed))
        .filter(F.col("key").startswith(F.col("prefix")))
        .groupBy(*cols, "key", "doc_id")
        .agg(F.sum("n_tokens").alias("n"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    )
    inside = Window.partitionBy(*cols).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        near.withColumn("sum", F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .filter("sum < rest")
        .groupBy(*cols)
        .agg(F.max(F.struct("key", "doc_id")).alias("cut"))
        .select(*cols, F.col("cut.key").alias("cut_key"), F.col("cut.doc_id").alias("cut_id"))
    )
    return staged(budgets.join(last, cols, "left"), "mix-cuts")


def _offered(docs: DataFrame, weights, share: float, epochs: int, seed: int) -> DataFrame:
    """`row`, the whole row of docs, once for each epoch that takes it, beside its leaf, epoch and leaf_budget."""
    cols = [f"_{x}" for x in LEVELS]
    leaf = [c.alias(name) for name, c in leaf_columns().items()]
    # Other columns stay inside the struct, so their names can't clash with those used here.
    placed = docs.select(F.struct("*").alias("row"), "doc_id", "text", *leaf)
    rows = staged(placed.select("doc_id", *cols, token_count(F.col("text")).alias("n_tokens")), "mix-rows")
    plan = cuts(rows, leaf_budgets(rows, weights, share, epochs), seed)
    plan = plan.select(*cols, "leaf_budget", F.col("full").alias("_full"), F.col("cut_key").alias("_cut_key"), F.col("cut_id").alias("_cut_id"))
    offered = placed.drop("text").join(plan, cols).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_full"))))
    key = order_key(F.col("epoch"), seed)
    fits = (key < F.col("_cut_key")) | ((key == F.col("_cut_key")) & (F.coalesce("doc_id", F.lit(-(1 << 63))) <= F.coalesce("_cut_id", F.lit(-(1 << 63)))))
    return offered.filter((F.col("epoch") < F.col("_full")) | fits).select("row", *cols, "epoch", "leaf_budget")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs' rows that the mix takes, once for each epoch, with _domain, _lang, _source, epoch and leaf_budget.

    These take the place of columns of docs that have their names; `taken` has docs' own columns alone.
    """
    added = [*(f"_{x}" for x in LEVELS), "epoch", "leaf_budget"]
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return _offered(docs, weights, share, epochs, seed).select(*own, *added)


def taken(docs: DataFrame, weights=WEIGHTS, share: float = BUDGET_SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """docs' rows that the mix takes, once for each epoch, with docs' own columns."""
    return _offered(docs, weights, share, epochs, seed).select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens, leaf_budget of every row the mix takes."""
    return mixed(docs.select("doc_id", "text", "lang", "source")).select(
        "doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"), "epoch",
        token_count(F.col("text")).alias("n_tokens"), "leaf_budget",
    )
