"""Transcripts of conversations: whole, by lines and by characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.ordered import BLOCK, block_of, block_window, drop_halo, look_back, number_rows, with_halo


def build_transcript(
    df: DataFrame, key: str, pos: str, line: str, segment_rows: int = 1_000, out: str = "transcript"
) -> DataFrame:
    """Lines of a conversation in order, joined by line feeds.

    A row holds one segment of up to ``segment_rows`` lines (by position), so a
    conversation of any length is whole and no task holds all of it; segments in
    order make the transcript.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(line).alias("line"))))
    grouped = df.groupBy(key, block_of(pos, segment_rows).alias("segment"))
    return grouped.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(out),
    )


def last_n_lines(
    df: DataFrame, key: str, pos: str, line: str, n: int = 9, block_rows: int = 100_000, out: str = "recent"
) -> DataFrame:
    """Add the last n lines up to each message as an array."""

    def recent(window):
        return F.collect_list(line).over(window.rowsBetween(-(n - 1), Window.currentRow))

    return look_back(df, key, pos, {out: recent}, n - 1, block_rows)


def recent_text(lines: Column) -> Column:
    """Context lines as text; the transcript ends in a line feed, and so does this."""
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def without_edges(
    df: DataFrame, key: str, pos: str, line: str, first: int = 0, last: int = 0, segment_rows: int = 1_000, out: str = "transcript"
) -> DataFrame:
    """Segments of the transcript without the first and last lines of the conversation.

    Lines are numbered per conversation, whatever the gaps in ``pos``; a segment of
    which nothing is left has a null text.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_total"))
    numbered = number_rows(df.select(key, pos, line), key, [pos], block_of(pos, segment_rows), "_no").join(counts, key)
    inside = (F.col("_no") >= first) & (F.col("_no") < F.col("_total") - last)
    kept = F.array_sort(F.collect_list(F.when(inside, F.struct(F.col("_no").alias("pos"), F.col(line).alias("line")))))
    text = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    return numbered.groupBy(key, block_of(pos, segment_rows).alias("segment")).agg(F.when(F.count_if(inside) > 0, text).alias(out))


def with_tail(segments: DataFrame, key: str, text: str, budget: int = 500, out: str = "tail") -> DataFrame:
    """Add, on the last segment of each conversation, the last ``budget`` characters of all of it.

    Only lengths and endings of the segments meet; the texts stay where they are.
    """
    ends = segments.select(
        key, "segment", F.length(text).alias("_n"), F.right(F.concat(text, F.lit("\n")), F.lit(budget)).alias("_end")
    )
    later = Window.partitionBy(key).orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    needed = ends.withColumn("_after", F.coalesce(F.sum(F.col("_n") + 1).over(later), F.lit(0))).where(F.col("_after") < budget)
    pieces = F.array_sort(F.collect_list(F.struct("segment", "_end")))
    tails = needed.groupBy(key).agg(
        F.max("segment").alias("segment"),
        F.right(F.array_join(F.transform(pieces, lambda x: x["_end"]), ""), F.lit(budget)).alias(out),
    )
    return segments.join(tails, [key, "segment"], "left")


def _within_budget(
    df: DataFrame, key: str, pos: str, line: str, budget: int, block_rows: int, halo: int = 0
) -> DataFrame:
    """Collect, per message, the lines of which any character is among the last ``budget``.

    Every line takes at least its line feed, so ``budget`` rows of halo suffice.
    A running length turns "the last n characters" into a range frame, which
    holds just the lines needed, however long the conversation is.
    """
    rows = with_halo(df, pos, max(budget, halo), block_rows)
    window = block_window(key, pos)
    so_far = F.sum(F.length(line) + 1).over(window.rowsBetween(Window.unboundedPreceding, 0))
    measured = rows.withColumn("_end", so_far.cast("bigint"))
    reach = Window.partitionBy(key, BLOCK).orderBy("_end").rangeBetween(-(budget - 1), 0)
    return measured.withColumn("_lines", F.collect_list(line).over(reach))


def _with_carry(rows: DataFrame, key: str, pos: str, running: str, reach: int, merge, out: str) -> DataFrame:
    """Add what the blocks before a row's own end with.

    ``running`` is a value of each row within its block; the last one of a block stands for
    the block.  ``merge`` makes one value of those of up to ``reach`` blocks before, in
    order, whatever positions or blocks are missing in between.  Only the blocks' last values
    are shuffled by conversation, and conversations of one block have none to join.
    """
    ends = rows.groupBy(key, BLOCK).agg(F.max_by(running, pos).alias("_end"))
    earlier = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(-reach, -1)
    carry = ends.withColumn("_before", F.collect_list("_end").over(earlier)).where(F.size("_before") > 0)
    return rows.join(carry.select(key, BLOCK, merge(F.col("_before")).alias(out)), [key, BLOCK], "left")


def _last(lines: Column, n: int) -> Column:
    return F.slice(lines, F.greatest(F.size(lines) - n, F.lit(0)) + 1, F.lit(n))


def last_text_lines(
    df: DataFrame, key: str, pos: str, text: str, n: int = 9, block_rows: int = 100_000, out: str = "recent"
) -> DataFrame:
    """Add the last n lines of the transcript up to each message, as an array.

    A message may have several lines (a note tells of its picture), and positions may have
    gaps.  A null text is an empty line.
    """
    own = _last(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), n)
    rows = df.withColumn(BLOCK, block_of(pos, block_rows)).withColumn("_own", own)
    window = block_window(key, pos).rowsBetween(-(n - 1), 0)
    here = rows.withColumn("_here", _last(F.flatten(F.collect_list("_own").over(window)), n))
    carried = _with_carry(here, key, pos, "_here", n, lambda b: _last(F.flatten(b), n), "_carry")
    both = F.when(F.col("_carry").isNull(), F.col("_here")).otherwise(_last(F.concat("_carry", "_here"), n))
    return carried.withColumn(out, both).drop("_own", "_here", "_carry", BLOCK)


def memory_text(
    df: DataFrame, key: str, pos: str, text: str, budget: int = 500, block_rows: int = 100_000, out: str = "memory"
) -> DataFrame:
    """Add the last ``budget`` characters of the transcript up to and with each message.

    As ``char_budget_suffix``, for positions with gaps too.  A null text is an empty line.
    """
    line = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumn(BLOCK, block_of(pos, block_rows)).withColumn("_line", F.right(line, F.lit(budget)))
    so_far = F.sum(F.length("_line") + 1).over(block_window(key, pos).rowsBetween(Window.unboundedPreceding, 0))
    reach = Window.partitionBy(key, BLOCK).orderBy("_reach").rangeBetween(-(budget - 1), 0)
    ends = lambda parts: F.right(F.concat(F.array_join(parts, "\n"), F.lit("\n")), F.lit(budget))
    here = rows.withColumn("_reach", so_far.cast("bigint")).withColumn("_here", ends(F.collect_list("_line").over(reach)))
    merge = lambda b: F.right(F.array_join(b, ""), F.lit(budget))
    carried = _with_carry(here, key, pos, "_here", budget, merge, "_carry")
    both = F.right(F.concat(F.coalesce("_carry", F.lit("")), F.col("_here")), F.lit(budget))
    return carried.withColumn(out, both).drop("_line", "_reach", "_here", "_carry", BLOCK)


def char_budget_suffix(
    df: DataFrame, key: str, pos: str, line: str, budget: int = 500, block_rows: int = 100_000,
    out: str = "tail",
) -> DataFrame:
    """Add the last ``budget`` characters of the transcript so far, cut mid-line."""
    lines = _within_budget(df, key, pos, line, budget, block_rows)
    text = F.right(F.concat(F.array_join("_lines", "\n"), F.lit("\n")), F.lit(budget))
    return drop_halo(lines.withColumn(out, text).drop("_lines", "_end"))


def memory_before(
    df: DataFrame, key: str, pos: str, line: str, budget: int = 500, block_rows: int = 100_000,
    out: str = "memory",
) -> DataFrame:
    """Add the last ``budget`` characters of the transcript before each message, cut mid-line."""
    lines = _within_budget(df, key, pos, line, budget, block_rows, budget + 1)
    text = F.right(F.concat(F.array_join("_lines", "\n"), F.lit("\n")), F.lit(budget))
    with_text = lines.withColumn("_text", text).withColumn(out, F.lag("_text", 1, "").over(block_window(key, pos)))
    return drop_halo(with_text.drop("_lines", "_end", "_text"))


def char_budget_lines(
    df: DataFrame, key: str, pos: str, line: str, budget: int = 500, block_rows: int = 100_000,
    out: str = "lines",
) -> DataFrame:
    """Add the whole last lines that fit into ``budget`` characters, as an array."""
    lines = _within_budget(df, key, pos, line, budget, block_rows)

    # All but the oldest collected line fit for sure; that one fits if the sum does.
    used = F.aggregate("_lines", F.lit(0), lambda n, x: n + F.length(x) + 1)
    fitting = F.when(used > budget, F.slice("_lines", F.lit(2), F.size("_lines"))).otherwise(F.col("_lines"))
    return drop_halo(lines.withColumn(out, fitting).drop("_lines", "_end"))


def line_rows(df: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """One row per line of each text, numbered from 0."""
    return df.select(key, pos, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def transcript_minus_lines(
    lines: DataFrame, removed: DataFrame, key: str, line: str = "line"
) -> DataFrame:
    """Line rows without those equal to a removed line of the same conversation."""
    return lines.join(removed.select(key, line).distinct(), [key, line], "left_anti")
