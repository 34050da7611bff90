"""Which messages deserve an answer, and when."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import config as cfg
from threadloom.functions.jsonio import affirmative
from threadloom.functions.text import first_line
from threadloom.operators.ordered import last_value, running

TICK = f"{cfg.TICK_MILLIS} milliseconds"


def drop_self(df: DataFrame, bot_id: int) -> DataFrame:
    return df.where(F.col("author_id") != bot_id)


def with_answerable(df: DataFrame) -> DataFrame:
    """Messages of bots stay in the transcript but are never answered."""
    return df.withColumn("answerable", ~F.col("is_bot"))


def direct_mention(mentioned: Column, content: Column, bot_id: int, min_length: int = 22) -> Column:
    return F.array_contains(mentioned, bot_id) & (F.length(content) > min_length)


def channel_scope(df: DataFrame, channel_ids: Iterable[int]) -> DataFrame:
    return df.where(F.col("channel_id").isin(list(channel_ids)))


def log_filter(df: DataFrame, blacklist: Iterable[str] = cfg.LOG_BLACKLIST) -> DataFrame:
    """Log text worth keeping: the message unless blacklisted, else the exception."""
    listed = F.lit(False)
    for word in blacklist:
        listed = listed | F.contains("message", F.lit(word))
    text = F.when(F.col("message").isNotNull() & ~listed, F.col("message")).otherwise(F.col("exception"))
    return df.withColumn("text", text).where(F.col("text").isNotNull())


def error_lines(df: DataFrame, text: str) -> DataFrame:
    """Count errors by their first line."""
    return df.groupBy(first_line(F.col(text)).alias("first_line")).agg(F.count(F.lit(1)).alias("errors"))


# --- owner commands -------------------------------------------------------------


def owner_command(content: Column, author: Column, owner_id: int) -> Column:
    """True for enable, false for disable, null for anything else."""
    said = F.lower(content)
    return F.when(
        author == owner_id,
        F.when(said == cfg.COMMAND_ENABLE, True).when(said == cfg.COMMAND_DISABLE, False),
    )


def toggle_state(
    df: DataFrame, key: str, pos: str, command: Column, block_rows: int = 100_000
) -> DataFrame:
    """Add the mode before and after each message, and whether the command is used up.

    Two flags make the mode: on (off at the start) and allowed (on at the start).
    Any command sets both, so a command is used up unless it repeats the last one.
    """
    known = last_value(
        df.withColumn("_command", command), key, pos, F.col("_command"), "_before", block_rows, before=True
    )
    used = F.col("_command").isNotNull() & ~F.col("_command").eqNullSafe(F.col("_before"))
    return (
        known.withColumn("mode_before", F.coalesce("_before", F.lit(False)))
        .withColumn("mode_after", F.coalesce("_command", "_before", F.lit(False)))
        .withColumn("swallowed", used)
        .drop("_command", "_before")
    )


# --- ticks ------------------------------------------------------------------------


def tick_of(ts: Column) -> Column:
    """Number of the tick that a time falls into."""
    return F.call_function("div", F.unix_millis(ts), F.lit(cfg.TICK_MILLIS))


def latest_per_tick(df: DataFrame, width: str = TICK, more: tuple[str, ...] = ()) -> DataFrame:
    """The newest message of each channel and tick, and how many it stands for.

    Other columns named in ``more`` come along.  Partial aggregation leaves one row
    per channel, tick and task to shuffle.
    """
    newest = F.max_by(F.struct("msg_id", "content", *more), F.struct("ts", "msg_id"))
    return (
        df.groupBy("channel_id", F.window("ts", width).alias("_w"))
        .agg(newest.alias("_m"), F.count(F.lit(1)).alias("n_messages"))
        .select(
            "channel_id",
            F.col("_w.start").alias("tick_start"),
            F.col("_m.msg_id").alias("msg_id"),
            F.col("_m.content").alias("content"),
            "n_messages",
            *[F.col(f"_m.{c}").alias(c) for c in more],
        )
    )


# --- backoff after negative verdicts ------------------------------------------------


def backoff_wait(streak: Column, cap_holds: bool = False) -> Column:
    """Ticks to wait after the n-th negative verdict in a row: 1, 2, 3, then none
    (or, with ``cap_holds``, 3 for good)."""
    beyond = F.lit(3 if cap_holds else 0)
    return F.when(streak <= 3, streak).otherwise(beyond).cast("int")


def negative_streak_backoff(
    df: DataFrame, key: str, pos: str, answer: str, block_rows: int = 100_000, cap_holds: bool = False
) -> DataFrame:
    """Add verdict, length of the negative streak and ticks to wait after each check."""
    judged = df.withColumn("positive", affirmative(F.col(answer)))
    last_yes = F.when(F.col("positive"), F.col(pos))
    known = running(judged, key, pos, last_yes, "_yes", "max", block_rows)
    streak = F.col(pos) - F.coalesce("_yes", F.lit(-1))
    return (
        known.withColumn("streak", streak).withColumn("wait", backoff_wait(F.col("streak"), cap_holds)).drop("_yes")
    )


# --- cooldown ------------------------------------------------------------------------


def cooldown(
    df: DataFrame, channel: str = "channel_id", ts: str = "ts", ticks: int = 10, chunk_ticks: int = 4096
) -> DataFrame:
    """Ticks of a channel, and whether a request is accepted in each.

    An accepted request locks the channel for ``ticks`` ticks.  Which ticks are
    accepted depends on all before, but a channel can enter a chunk of ticks in
    just ``ticks + 1`` ways (0 to ``ticks`` ticks left on the lock).  So each chunk
    is worked out for every way in, on its own; the chunks of a channel, of which
    there are few, are then chained; and the chunks are replayed with the way in
    that the chain gives.  Ticks come first: one row per channel and tick,
    however many messages there are.
    """
    chunk_ticks = max(chunk_ticks, ticks + 1)
    per_tick = df.groupBy(channel, tick_of(F.col(ts)).alias("tick")).agg(F.count(F.lit(1)).alias("n_messages"))
    chunk = F.call_function("div", F.col("tick"), F.lit(chunk_ticks))
    chunks = per_tick.groupBy(channel, chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("tick", "n_messages"))).alias("_ticks")
    )
    base = F.col("chunk") * chunk_ticks

    def lock(free: Column, tick: Column) -> Column:
        return F.when(tick >= free, tick + ticks).otherwise(free)

    def way_out(left: Column) -> Column:
        free = F.aggregate("_ticks", base + left, lambda f, t: lock(f, t["tick"]))
        return F.greatest(free - (base + chunk_ticks), F.lit(0).cast("bigint"))

    # Channels of a single chunk are always entered unlocked.
    spans = per_tick.groupBy(channel).agg(F.min(chunk).alias("_lo"), F.max(chunk).alias("_hi"))
    long_ones = spans.where("_lo < _hi").select(channel)
    ways = chunks.join(long_ones, channel, "left_semi").select(
        channel, "chunk", F.transform(F.sequence(F.lit(0), F.lit(ticks)), way_out).alias("ways")
    )

    def link(state: Column, c: Column) -> Column:
        # A skipped chunk is longer than any lock.
        left = F.when(c["chunk"] == state["next"], state["left"]).otherwise(F.lit(0).cast("bigint"))
        entry = F.struct(c["chunk"].alias("chunk"), left.alias("entry"))
        return F.struct(
            (c["chunk"] + 1).alias("next"),
            F.get(c["ways"], left.cast("int")).alias("left"),
            F.array_append(state["entries"], entry).alias("entries"),
        )

    start = F.struct(
        F.lit(-1).cast("bigint").alias("next"),
        F.lit(0).cast("bigint").alias("left"),
        F.array().cast("array<struct<chunk:bigint,entry:bigint>>").alias("entries"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("chunk", "ways")))
    chained = ways.groupBy(channel).agg(in_order.alias("_chunks")).select(
        channel, F.explode(F.aggregate("_chunks", start, link)["entries"]).alias("_e")
    )
    entry = chained.select(channel, "_e.chunk", "_e.entry")

    def accept(state: Column, t: Column) -> Column:
        ok = t["tick"] >= state["free"]
        return F.struct(
            lock(state["free"], t["tick"]).alias("free"), F.array_append(state["ok"], ok).alias("ok")
        )

    entered = chunks.join(entry, [channel, "chunk"], "left").withColumn(
        "_free", base + F.coalesce("entry", F.lit(0))
    )
    fresh = F.struct(F.col("_free").alias("free"), F.array().cast("array<boolean>").alias("ok"))
    verdicts = F.aggregate("_ticks", fresh, accept)["ok"]
    pairs = F.zip_with(
        "_ticks",
        verdicts,
        lambda t, ok: F.struct(t["tick"].alias("tick"), t["n_messages"].alias("n_messages"), ok.alias("accepted")),
    )
    rows = entered.select(channel, "chunk", "_free", F.explode(pairs).alias("_r")).select(
        channel, "chunk", "_free", "_r.*"
    )
    earlier = Window.partitionBy(channel, "chunk").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    last_taken = F.max(F.when(F.col("accepted"), F.col("tick"))).over(earlier)
    free_tick = F.coalesce(last_taken + ticks, F.col("_free"))
    return rows.withColumn("free_tick", free_tick).select(
        channel, "tick", "n_messages", "free_tick", "accepted"
    )


def release_time(ts: Column, free_tick: Column, max_wait_seconds: int = 45) -> Column:
    """When a waiting message goes ahead: once the lock ends, or after the longest wait."""
    lock_end = F.timestamp_millis(free_tick * cfg.TICK_MILLIS)
    latest = ts + F.make_dt_interval(secs=F.lit(max_wait_seconds))
    return F.least(F.greatest(ts, lock_end), latest)


# --- names ------------------------------------------------------------------------------


def name_change(before: Column, after: Column) -> Column:
    """New name that a member update brings, null when it brings none."""
    display = after["display_name"].isNotNull() & ~after["display_name"].eqNullSafe(before["display_name"])
    username = ~after["username"].eqNullSafe(before["username"])
    return (
        F.when(display, after["display_name"])
        .when(username & after["nickname"].isNotNull(), after["nickname"])
        .when(username, after["username"])
    )


def initial_name(nickname: Column, username: Column) -> Column:
    return F.coalesce(nickname, username)


def current_names(updates: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Latest name per member: the last change, else the initial name.

    Reduced by a partial aggregate, so a member with most of the updates is no burden.
    """
    change = name_change(F.col("before"), F.col("after"))
    latest = (
        updates.withColumn("_name", change)
        .where(F.col("_name").isNotNull())
        .groupBy("member_id")
        .agg(F.max_by("_name", "seq").alias("name"))
    )
    if initial is None:
        return latest
    first = initial.select("member_id", initial_name(F.col("nickname"), F.col("username")).alias("_initial"))
    return first.join(latest, "member_id", "full").select(
        "member_id", F.coalesce("name", "_initial").alias("name")
    )
