"""Features of one trajectory, by higher-order functions over field arrays of its messages.

Field arrays (`messages.role`) let the Parquet scan read the named fields only;
a lambda over the whole message struct would read them all.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions.compat import text_to_int
from tracequarry.operators.trials import outcome
from tracequarry.sources.corpus import shard_columns

EDIT = r"sed -i|cat >|\btee\b|str_replace_editor|\bedit\b|apply_patch"
TEST = r"pytest|go test|cargo test|npm test|jest|phpunit|mvn test"
SUBMIT = r"(?i)\b(?:submit|finish|done)"
#: What a tool's answer says when a call went wrong; our own, as no definition of the count is known.
ERROR = r"(?m)^Traceback \(most recent call last\)|(?i)\b(?:error|exception|fatal|panic):|command not found|no such file or directory|exit(?:ed with)? (?:code|status) [1-9]"


def chars_where(roles: Column, texts: Column, role: str) -> Column:
    """Characters of the texts whose role is the given one."""
    sizes = F.zip_with(roles, texts, lambda r, t: F.when(r == role, F.length(t)).otherwise(0))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def longest_repeat(values: Column) -> Column:
    """Length of the longest run of equal consecutive elements, in one pass."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(a["last"].eqNullSafe(x) & (a["run"] > 0), a["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(F.transform(values, lambda x: x.cast("string")), start, step, lambda a: a["best"])


def count_like(values: Column, pattern: str) -> Column:
    return F.size(F.filter(values, lambda v: v.rlike(pattern)))


def touched_paths(patch: Column) -> Column:
    """The files that a diff touches."""
    found = F.concat(F.regexp_extract_all(patch, F.lit(r"(?m)^diff --git a/\S+ b/(\S+)"), F.lit(1)), F.regexp_extract_all(patch, F.lit(r"(?m)^\+\+\+ b/(\S+)"), F.lit(1)))
    return F.array_distinct(found)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; null if both are empty or one is null."""
    return F.size(F.array_intersect(a, b)).cast("double") / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def added_lines(patch: Column) -> Column:
    return F.size(F.filter(F.split(patch, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++")))


def proxy_features(trials: DataFrame) -> DataFrame:
    """One row of structural features for each trial, without exploding its messages.

    Trials that know their shard, by `_source_file`, get its harness, teacher and source as well.
    """
    role = F.col("messages.role")
    if "_source_file" in trials.columns:
        shard = shard_columns(F.col("_source_file"))
        trials = trials.withColumns({"harness": shard["harness"], "teacher": shard["teacher_model"], "source": shard["source_dataset"], "category": F.col("metadata.category")})
    told = F.filter(F.col("messages.tool_calls"), lambda c: c.isNotNull())
    calls = F.flatten(F.transform(told, lambda c: F.transform(c, lambda x: x["function"]["arguments"])))
    arguments = F.filter(F.coalesce(calls, F.array().cast("array<string>")), lambda x: x.isNotNull())
    last = F.try_element_at(F.filter(F.zip_with(role, F.col("messages.content"), lambda r, c: F.when(r == "assistant", F.coalesce(c, F.lit("")))), lambda x: x.isNotNull()), F.lit(-1))
    out = trials.withColumn("_args", arguments).withColumns({
        "n_messages": F.coalesce(F.array_size(role), F.lit(0)),
        "n_assistant_turns": F.coalesce(F.size(F.filter(role, lambda r: r == "assistant")), F.lit(0)),
        "n_tool_calls": F.size("_args"),
        "assistant_chars": F.coalesce(chars_where(role, F.col("messages.content"), "assistant"), F.lit(0)),
        "reasoning_chars": F.coalesce(chars_where(role, F.col("messages.reasoning_content"), "assistant"), F.lit(0)),
        "tool_obs_chars": F.coalesce(chars_where(role, F.col("messages.content"), "tool"), F.lit(0)),
        "n_distinct_tool_commands": F.size(F.array_distinct("_args")),
        "repeat_call_rate": F.when(F.size("_args") > 0, 1 - F.size(F.array_distinct("_args")).cast("double") / F.size("_args")).otherwise(0.0),
        "max_consecutive_identical_calls": longest_repeat(F.col("_args")),
        "n_edit_calls": count_like(F.col("_args"), EDIT),
        "n_test_calls": count_like(F.col("_args"), TEST),
        "model_patch_files": text_to_int(F.col("metadata.model_patch.num_modified_files")),
        "model_patch_lines": text_to_int(F.col("metadata.model_patch.num_modified_lines")),
        "gold_patch_files": text_to_int(F.col("metadata.reference_patch.num_modified_files")),
        "gold_patch_lines": text_to_int(F.col("metadata.reference_patch.num_modified_lines")),
        "patch_file_jaccard": jaccard(touched_paths(F.col("metadata.model_patch.patch")), touched_paths(F.col("metadata.reference_patch.patch"))),
        "ends_with_submit": F.coalesce(last.rlike(SUBMIT), F.lit(False)),
    })
    return out.drop("_args", "messages", "tools")


def turn_sample(trials: DataFrame, n: int, seed: int = 42, key: str = "trajectory_id") -> DataFrame:
    """The turns of n trials, the first in a seeded order, with their outcome and running counts of edits, tests, tool calls and tool errors.

    Trials are picked by their keys alone; only the picked ones' messages are read further.
    """
    picked = trials.select(key).orderBy(F.md5(F.concat_ws("-", F.col(key), F.lit(str(seed))).cast("binary")), key).limit(n)
    fields = ("role", "content", "tool_calls")
    zipped = F.arrays_zip(*[F.col(f"messages.{f}").alias(f) for f in fields])
    rows = trials.join(picked, key, "left_semi").select(key, "resolved", F.posexplode(zipped).alias("pos", "m"))
    text = F.concat_ws("\n", F.col("m.content"), F.transform(F.coalesce("m.tool_calls", F.array()), lambda c: c["function"]["arguments"]))
    calls = F.when(F.col("m.role") == "assistant", F.coalesce(F.size("m.tool_calls"), F.lit(0))).otherwise(0)
    acts = F.col("role") == "assistant"
    rows = rows.select(
        key, "resolved", (F.col("pos") + 1).alias("turn_idx"), F.col("m.role").alias("role"), F.coalesce(F.length("m.content"), F.lit(0)).alias("content_len"),
        (calls > 0).alias("has_tool_call"), outcome(F.col("resolved")).alias("outcome_label"), text.rlike(EDIT).alias("_edit"), text.rlike(TEST).alias("_test"), calls.alias("_calls"),
        ((F.col("m.role") == "tool") & F.coalesce(F.col("m.content").rlike(ERROR), F.lit(False))).alias("is_tool_error"),
    )
    upto = Window.partitionBy(key).orderBy("turn_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"is_edit_command": acts & F.col("_edit"), "is_test_command": acts & F.col("_test")})
    return rows.withColumns({
        "pct_through": F.col("turn_idx").cast("double") / F.count("*").over(Window.partitionBy(key)),
        "cum_edits": F.sum(F.col("is_edit_command").cast("int")).over(upto), "cum_tests": F.sum(F.col("is_test_command").cast("int")).over(upto), "cum_tool_calls": F.sum("_calls").over(upto), "cum_tool_errors": F.sum(F.col("is_tool_error").cast("int")).over(upto),
    }).drop("_edit", "_test", "_calls")
