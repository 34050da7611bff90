"""Repeating replies: exact and near repeats, repeated openings and endings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.editdistance import first_closer_than
from threadloom.functions.text import (
    common_prefix_length,
    common_suffix_length,
    first_end_marker,
    strip_whitespace,
    trim_all,
)
from threadloom.operators.ordered import BLOCK, last_value, look_back, materialize, running, with_blocks
from threadloom.operators.transcript import memory_before

NO_REPLY = "<noinput>"


def degenerate_reply(reply: Column, marker: Column, strict: bool = False) -> Column:
    """A reply that is just the end marker, or a single run of letters and digits.

    ``strict`` flags a reply without any letter or digit instead.
    """
    hollow = ~reply.rlike("[a-zA-Z0-9]") if strict else ~reply.rlike("[^a-zA-Z0-9]")
    return (reply == marker) | hollow


def near_duplicate_reply(
    df: DataFrame,
    key: str,
    pos: str,
    reply: str,
    line: str,
    budget: int = 500,
    block_rows: int = 100_000,
    out: str = "near_line",
) -> DataFrame:
    """Add the first line of the memory that a reply nearly repeats.

    The memory is the last ``budget`` characters of the transcript before the reply,
    cut mid-line, split into lines; a line with a note under it counts as two.

    Near means: without white space, a weighted distance below a third of the
    reply's length.  Length gap and plain distance settle nearly all pairs
    inside Spark; only what they leave open goes to Python, in Arrow batches.
    Null when no line is near.
    """

    memory = memory_before(df.withColumn("_said", F.coalesce(line, F.lit(""))), key, pos, "_said", budget, block_rows, "_memory")
    seen = memory.withColumn("_seen", F.split("_memory", "\n")).drop("_said", "_memory")
    bare = strip_whitespace(F.col(reply))
    limit = F.call_function("div", F.length(reply), F.lit(3)).cast("int")
    measured = seen.withColumn("_bare", bare).withColumn("_limit", limit)

    def pair(text: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), text.alias("line"), strip_whitespace(text).alias("bare"))

    def plain(p: Column) -> Column:
        # Bounded distance: -1 when it is at least the limit, 0 for an empty side.
        return (
            F.when((p["bare"] == "") | (F.col("_bare") == ""), 0)
            .when(F.abs(F.length(p["bare"]) - F.length("_bare")) >= F.col("_limit"), -1)
            .otherwise(F.call_function("levenshtein", F.col("_bare"), p["bare"], F.col("_limit") - 1))
        )

    def scored(p: Column) -> Column:
        return F.struct(p["line"].alias("line"), p["bare"].alias("bare"), plain(p).alias("d"))

    pairs = F.transform(F.filter(F.transform("_seen", pair), lambda p: p["line"] != ""), scored)
    open_or_near = F.when(F.col("_limit") > 0, F.filter(pairs, lambda p: p["d"] >= 0)).otherwise(
        F.slice(pairs, F.lit(1), F.lit(0))
    )
    # At most twice the plain distance: a pair that is near on that account is near
    # for sure, and nothing after it can come first.
    candidates = measured.withColumn("_pairs", open_or_near).drop("_seen")
    sure = F.array_position(F.transform("_pairs", lambda p: p["d"] * 2 < F.col("_limit")), True)
    reach = candidates.withColumn("_sure", sure)
    doubtful = F.when(F.col("_sure") > 0, F.slice("_pairs", F.lit(1), F.col("_sure") - 1)).otherwise(
        F.col("_pairs")
    )
    asked = F.transform(doubtful, lambda p: p["bare"])
    # Python gets the texts of rows with a doubtful pair; of all others, nulls.
    is_open = F.size(asked) > 0
    found = reach.withColumn(
        "_at", first_closer_than(F.when(is_open, F.col("_bare")), F.when(is_open, asked), F.col("_limit"))
    )
    at = F.coalesce(F.col("_at"), F.when(F.col("_sure") > 0, F.col("_sure").cast("int") - 1))
    hit = F.when(at.isNotNull(), F.get("_pairs", at)["line"])
    return found.withColumn(out, hit).drop("_bare", "_limit", "_pairs", "_sure", "_at")


def exact_repeat(
    df: DataFrame, key: str, pos: str, reply: str, block_rows: int = 100_000, out: str = "is_repeat"
) -> DataFrame:
    """Whether a reply equals the one before it."""

    def same(window):
        return F.col(reply) == F.lag(reply, 1, NO_REPLY).over(window)

    return look_back(df, key, pos, {out: same}, 1, block_rows)


def repeat_policy(
    df: DataFrame, key: str, pos: str, repeat: str, block_rows: int = 100_000, out: str = "policy"
) -> DataFrame:
    """Label repeats retry, retry, give_up, and so on in turn; null for other rows.

    Only a give_up starts the count again, so the label follows from the running
    number of repeats.
    """
    counted = running(df, key, pos, F.col(repeat).cast("bigint"), "_n", "sum", block_rows)
    label = F.when((F.col("_n") - 1) % 3 < 2, "retry").otherwise("give_up")
    return counted.withColumn(out, F.when(F.col(repeat), label)).drop("_n")


def trim_repeated_prefix(reply: Column, previous: Column) -> Column:
    """Characters that ``with_trimmed_affixes`` may cut off the start."""
    shorter = F.least(F.length(reply), F.length(previous))
    cut = F.least(common_prefix_length(reply, previous), shorter - 1)
    return F.when(shorter > 0, F.greatest(cut, F.lit(0))).otherwise(0)


def with_trimmed_affixes(
    df: DataFrame, reply: str, previous: str, out: str = "trimmed"
) -> DataFrame:
    """Add prefix_cut, suffix_cut and the trimmed reply.

    A cut at the end is taken from the whole reply, so where it applies it takes
    the place of the cut at the start.
    """
    text, last = F.col(reply), F.col(previous)
    n, m = F.length(text), F.length(last)
    shorter = F.least(n, m)
    common = df.withColumn("_lcp", common_prefix_length(text, last)).withColumn(
        "_lcs", common_suffix_length(text, last)
    )

    def cut(length: str) -> Column:
        return F.greatest(F.least(F.col(length), shorter - 1), F.lit(0))

    cuts = common.withColumn("prefix_cut", cut("_lcp")).withColumn("suffix_cut", cut("_lcs"))
    checked = F.when(F.col("_lcp") > 0, F.col("prefix_cut") + 1).otherwise(1)
    by_suffix = (n - F.col("suffix_cut")) > (m - checked)
    trimmed = (
        F.when(shorter < 1, text)
        .when(by_suffix, F.left(text, n - F.col("suffix_cut")))
        .otherwise(F.substring(text, F.col("prefix_cut") + 1, n))
    )
    return cuts.withColumn(out, trimmed).drop("_lcp", "_lcs")


def with_previous_reply(
    df: DataFrame, key: str, pos: str, reply: str, block_rows: int = 100_000, out: str = "previous"
) -> DataFrame:
    """Add the reply of the row before."""

    def before(window):
        return F.lag(reply, 1, NO_REPLY).over(window)

    return look_back(df, key, pos, {out: before}, 1, block_rows)


def judge_replies(
    df: DataFrame,
    key: str,
    pos: str,
    reply: str,
    line: str,
    bot_name: str,
    budget: int = 500,
    block_rows: int = 100_000,
    raw: str | None = None,
) -> DataFrame:
    """Decide on every reply: send, retry, give_up, or wipe_and_retry.

    A reply is measured against the last one that was sent.  A near duplicate is
    not sent, a blank one leaves nothing to repeat; both are passed over, however
    many come in a row.  An exact repeat goes before a near one.
    """
    near = materialize(near_duplicate_reply(df, key, pos, reply, line, budget, block_rows))
    near = with_blocks(near, pos, block_rows)
    is_sent = F.col("near_line").isNull() & (F.length(trim_all(F.col(reply))) > 0)
    sent = F.when(is_sent, F.col(reply))
    known = last_value(near, key, pos, sent, "_last", block_rows, before=True)
    known = known.withColumn("previous", F.coalesce("_last", F.lit(NO_REPLY))).drop("_last")
    known = known.withColumn("is_repeat", F.col(reply) == F.col("previous"))
    labelled = repeat_policy(known, key, pos, "is_repeat", block_rows, "_label")
    marker = first_end_marker(F.col(raw or reply), bot_name)
    policy = (
        F.when(F.col("is_repeat"), F.col("_label"))
        .when(F.col("near_line").isNotNull(), "wipe_and_retry")
        .otherwise("send")
    )
    return (
        labelled.withColumn("policy", policy)
        .withColumn("is_degenerate", degenerate_reply(F.col(reply), marker))
        .drop("_label", BLOCK)
    )


def counters(df: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """Count, per key, the rows that meet each condition."""
    return df.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
