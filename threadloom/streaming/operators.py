"""Operators over message streams.

State that is kept per channel is fed one row per channel and tick (the table
that ``latest_per_tick`` writes), or rare rows such as commands: a channel with
most of the traffic then costs no more than any other.  Text state goes through
micro-batches, where the skew-proof batch operators do the work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from threadloom import config as cfg
from threadloom.config import ChatConfig
from threadloom.functions import jsonio
from threadloom.operators import gate, resolve, tokens, waiting_room
from threadloom.operators.ordered import materialize
from threadloom.plans.chains import sanitize_live
from threadloom.streaming import runs

# --- ticks ---------------------------------------------------------------------------


def latest_per_tick(stream: DataFrame, delay: str = "10 seconds", width: str = gate.TICK) -> DataFrame:
    """The newest message of each channel and tick, once the tick is over."""
    return gate.latest_per_tick(stream.withWatermark("ts", delay), width)


def ticks_table(
    stream: DataFrame, path: str, checkpoint: str, delay: str = "10 seconds", width: str = gate.TICK
) -> DataFrame:
    """The newest message of each channel and tick, the ticks still open among them.

    A micro-batch writes the ticks that it has changed, and overwrites its own folder when
    it is repeated; of a channel and tick the row of the latest micro-batch counts.  Rows
    that come late, but within ``delay``, thus mend their tick; the table is whole at any time.
    """
    runs.in_batches(latest_per_tick(stream, delay, width), lambda batch, epoch: batch, path, checkpoint, "update")
    rows = stream.sparkSession.read.option("basePath", path).parquet(path)
    newest = F.max_by(F.struct("msg_id", "content", "n_messages"), "epoch").alias("_row")
    return rows.groupBy("channel_id", "tick_start").agg(newest).select("channel_id", "tick_start", "_row.*")


def dedup(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each message once, also when backfill and live feed both deliver it."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["msg_id"])


# --- small state per channel -----------------------------------------------------------


def backoff(checks: DataFrame, cap_holds: bool = False) -> DataFrame:
    """Streak of negative verdicts and ticks to wait, per channel.

    ``checks`` has channel_id, pos (order of the checks) and answer.
    """
    judged = checks.select("channel_id", "pos", jsonio.affirmative(F.col("answer")).alias("positive"))

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState):
        streak = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("pos")
        streaks = []
        for yes in rows["positive"]:
            streak = 0 if yes else streak + 1
            streaks.append(streak)
        state.update((streak,))
        waits = [s if s <= 3 else (3 if cap_holds else 0) for s in streaks]
        yield rows.assign(streak=streaks, wait=waits)

    return judged.groupBy("channel_id").applyInPandasWithState(
        follow,
        "channel_id bigint, pos bigint, positive boolean, streak bigint, wait int",
        "streak bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def cooldown(ticked: DataFrame, ticks: int = 10) -> DataFrame:
    """Whether each tick's message is accepted; an accepted one locks the channel.

    ``ticked`` has channel_id and tick, one row per channel and tick.
    """

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState):
        free = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("tick")
        accepted = []
        for tick in rows["tick"]:
            accepted.append(tick >= free)
            free = tick + ticks if tick >= free else free
        state.update((int(free),))
        yield rows.assign(accepted=accepted)

    return ticked.select("channel_id", "tick").groupBy("channel_id").applyInPandasWithState(
        follow,
        "channel_id bigint, tick bigint, accepted boolean",
        "free bigint",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def toggle_state(stream: DataFrame, owner_id: int) -> DataFrame:
    """The owner's commands with the mode that each leaves, per channel.

    Only commands reach the state.  ``stream`` has channel_id, pos, content, author_id.
    """
    command = gate.owner_command(F.col("content"), F.col("author_id"), owner_id)
    commands = stream.select("channel_id", "pos", command.alias("command")).where("command IS NOT NULL")

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState):
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("pos")
        swallowed = []
        for said in rows["command"]:
            swallowed.append(last is None or bool(said) != last)
            last = bool(said)
        state.update((last,))
        yield rows.assign(swallowed=swallowed)

    return commands.groupBy("channel_id").applyInPandasWithState(
        follow,
        "channel_id bigint, pos bigint, command boolean, swallowed boolean",
        "last boolean",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def member_names(stream: DataFrame) -> DataFrame:
    """Latest name per member, as a streaming aggregate (use output mode "update")."""
    return gate.current_names(stream)


def member_names_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Keep the changed names of each micro-batch; the latest epoch of a member counts."""
    runs.in_batches(member_names(stream), lambda batch, epoch: batch, path, checkpoint, "update")
    rows = stream.sparkSession.read.option("basePath", path).parquet(path)
    return rows.groupBy("member_id").agg(F.max_by("name", "epoch").alias("name"))


def reply_gate(events: DataFrame, conf: ChatConfig, delay: str = "1 minute", cap_holds: bool = False) -> DataFrame:
    """(channel_id, at, msg_id, action): the whole gate, by the machine of the batch form.

    ``events`` is a stream of ``waiting_room.events``.  What is due without further input (a
    check, the end of a lock or of a wait) happens once the watermark has passed it; rows
    later than the watermark are dropped.  Rows of one channel in one micro-batch are taken
    in order of time, so that a backlog should come in several (``maxFilesPerTrigger``).
    """
    rules = waiting_room.rules_of(conf, cap_holds)

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState):
        channel = waiting_room.Channel(rules, state.get[0] if state.exists else None)
        if state.hasTimedOut:
            channel.advance(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "kind", "msg_id"], kind="stable")
            for at, kind, msg_id, direct, yes in zip(rows["at"], rows["kind"], rows["msg_id"], rows["direct"], rows["yes"]):
                channel.hear(int(at), int(kind), *(None if pd.isna(v) else f(v) for f, v in ((int, msg_id), (bool, direct), (bool, yes))))
        state.update((channel.state(),))
        if due := channel.next():
            state.setTimeoutTimestamp(max(due[0], state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *row) for row in channel.take()], columns=["channel_id", "at", "msg_id", "action"])

    return events.withWatermark("ts", delay).groupBy("channel_id").applyInPandasWithState(
        follow, waiting_room.ANSWERS, "state string", "append", GroupStateTimeout.EventTimeTimeout
    )


# --- tokens ---------------------------------------------------------------------------------


def assemble_tokens(
    stream: DataFrame, header: str, conf: ChatConfig, limit: int = 500, delay: str = "10 seconds"
) -> DataFrame:
    """Replies from token messages, each emitted when it is finished.

    State is the text since the header (or the end of what came before it).  With a
    ``ts`` column, a token more than the typing timeout after the first one ends
    the reply however short it is, and a request is given up (``timed_out``, with the text so
    far) when the stream has moved on by that time without a token for it.  A finished or
    given-up request leaves a mark that swallows its late tokens; the mark goes once the
    watermark is beyond them, when Spark itself drops what is later.  Without ``ts`` there is
    no such time, and marks of finished requests stay.
    """
    has_ts = "ts" in stream.columns
    timed = stream.withWatermark("ts", delay) if has_ts else stream.withColumn("ts", F.lit(None).cast("timestamp"))
    rows = timed.select(
        "request_id", "seq", "ts", jsonio.extract_token(F.col("raw")).alias("token"),
        F.unix_millis("ts").alias("millis"),
    ).where(F.length("token") > 0)
    wait = conf.typing_timeout_ticks * cfg.TICK_MILLIS
    keep = len(header) - 1

    marker = re.compile(cfg.end_marker_pattern(conf.bot_name), re.IGNORECASE)

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            phase, text, first = state.get
            if phase == 2:
                state.remove()
                return
            # Given up; tokens that are late but not yet dropped find the mark.
            state.update((2, "", first))
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + wait)
            yield pd.DataFrame({"request_id": [key[0]], "status": ["timed_out"], "text": [text if phase == 1 else None]})
            return
        phase, text, first = state.get if state.exists else (0, "", None)
        first = None if pd.isna(first) else int(first)
        tokens_in = pd.concat(list(batches)).sort_values("seq")
        done = None
        for token, millis_now in zip(tokens_in["token"], tokens_in["millis"]):
            now = None if pd.isna(millis_now) else int(millis_now)
            first = now if first is None else first
            if phase == 0:
                text += token
                if header in text:
                    phase, text = 1, ""
                else:
                    text = text[-keep:]
            elif phase == 1:
                text += token
                ended = len(text) > 2 and (len(text) > limit or marker.search(text) is not None)
                late = now is not None and now - first > wait
                if (ended or late) and marker.sub("", text):
                    done, phase, text = text, 2, ""
        state.update((phase, text, first))
        if has_ts:
            state.setTimeoutTimestamp(max(now + wait, state.getCurrentWatermarkMs() + 1))
        if done is not None:
            yield pd.DataFrame({"request_id": [key[0]], "status": ["finished"], "text": [done]})

    heard = rows.groupBy("request_id").applyInPandasWithState(
        follow,
        "request_id bigint, status string, text string",
        "phase int, text string, first bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout if has_ts else GroupStateTimeout.NoTimeout,
    )
    return heard.select("request_id", "status", tokens.clean_reply(F.col("text"), conf.bot_name).alias("reply"))


# --- micro-batches ----------------------------------------------------------------------------


def moderate(
    stream: DataFrame, users: DataFrame, channels: DataFrame, conf: ChatConfig, path: str, checkpoint: str
) -> DataFrame:
    """The whole live chain, a micro-batch at a time; nothing is carried over."""
    runs.in_batches(
        stream, lambda batch, epoch: sanitize_live(batch, users, channels, conf), path, checkpoint
    )
    return stream.sparkSession.read.option("basePath", path).parquet(path)


def _channels_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct channels of each Arrow batch, so that a hot channel shuffles few rows."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).unique()], names=["channel_id"])


def first_heard(stream: DataFrame) -> DataFrame:
    """Each channel of the stream once, in the micro-batch that first has it.

    Spark's keyed state holds the channels heard so far, one small row each.
    """
    channels = stream.select("channel_id").where(F.col("channel_id").isNotNull())
    return channels.mapInArrow(_channels_of_batches, channels.schema).dropDuplicates(["channel_id"])


def backfill_then_live(
    stream: DataFrame,
    history: DataFrame,
    path: str,
    checkpoint: str,
    k: int = 10,
    served: DataFrame | None = None,
) -> DataFrame:
    """Live messages, and for each channel that is heard its recent history, once.

    The history is a snapshot from before the stream; the k newest of each channel are
    worked out once.  One query writes live messages as they come, a second one reads
    their channels only, and writes the history of those it has not heard before; no
    micro-batch reads what others have written.  ``served`` (channel_id) are channels whose
    history an earlier run has given.  A message that comes through both, however late, is
    kept as live.  Messages without a channel have no history; history rows without
    an id are left out.
    """
    spark = stream.sparkSession
    live_path, backfill_path = f"{path}/live", f"{path}/backfill"
    scoped = history if served is None else history.join(served.select("channel_id"), "channel_id", "left_anti")
    recent = resolve.newest_k_per_channel(scoped.where(F.col("channel_id").isNotNull()), k).drop("rank")
    recent = materialize(recent.where(F.col("msg_id").isNotNull()).select(stream.columns))

    # A stream without messages writes no epoch; its history is this empty one.
    recent.limit(0).write.mode("overwrite").parquet(runs.epoch_path(backfill_path, -1))
    live = runs.to_table(stream, live_path, f"{checkpoint}/live")
    runs.in_batches(
        first_heard(stream),
        lambda channels, epoch: recent.join(channels, "channel_id", "left_semi").select(stream.columns),
        backfill_path,
        f"{checkpoint}/backfill",
    )
    backfill = spark.read.schema(stream.schema).option("basePath", backfill_path).parquet(backfill_path)
    return resolve.backfill_union_live(resolve.exclude_current(backfill, live), live)


def running_transcript(stream: DataFrame, budget: int = 500) -> DataFrame:
    """The last ``budget`` characters of the transcript after each line.

    ``stream`` has conv_id, turn, line, and turns arrive in order.  Spark's keyed state holds
    one tail of at most ``budget`` characters per conversation.  A task takes the lines
    of a conversation that one micro-batch brings, and keeps of each no more than the
    budget, so that the size of a micro-batch (``maxFilesPerTrigger``) bounds its memory.
    """
    # A line longer than the budget counts by its end only, before it goes to its task.
    short = stream.select("conv_id", "turn", F.right(F.coalesce("line", F.lit("")), F.lit(budget)).alias("line"))

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState):
        tail = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        tails = []
        for line in rows["line"]:
            tail = (tail + line + "\n")[-budget:]
            tails.append(tail)
        state.update((tail,))
        yield rows[["conv_id", "turn"]].assign(tail=tails)

    return short.groupBy("conv_id").applyInPandasWithState(
        follow, "conv_id bigint, turn bigint, tail string", "tail string", "append", GroupStateTimeout.NoTimeout
    )
