"""The whole gate of a channel: messages, verdicts and replies in, answers out.

One small state machine per channel follows three interleaved inputs in order of time:

* a *message* that names the bot is answered at once and locks the channel; any other
  becomes the newest, which the next tick puts to a model;
* a *verdict* on that message answers it, or makes the next checks wait 1, 2, 3 ticks;
* a *reply*, once sent, frees the lock before its time.

A message that comes while the channel is locked waits, in order, until the lock ends or
for ``max_wait_millis``.  The same machine drives the batch and the streaming form.  Its
state is bounded by what may wait at once: a newer message that does not name the bot
takes the place of one like it right before.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import config as cfg
from threadloom.config import ChatConfig
from threadloom.functions import jsonio
from threadloom.functions import text as tx
from threadloom.operators import gate

REPLY, VERDICT, MESSAGE, CLOCK = range(4)
#: What the machine reads: kinds in this order at one time.  CLOCK only tells the time.
EVENTS = "channel_id bigint, at bigint, kind int, msg_id bigint, direct boolean, yes boolean"
ANSWERS = "channel_id bigint, at bigint, msg_id bigint, action string"


class Channel:
    """State of one channel; times in milliseconds."""

    FIELDS = ("free_at", "resume", "streak", "pending", "checking", "waiting")

    def __init__(self, rules: dict, state: str | None = None):
        self.rules, self.tick = rules, rules["tick"]
        self.free_at, self.resume, self.streak = 0, 0, 0
        self.pending = None  # [msg_id, yes, since when]
        self.checking = None  # [msg_id, since when]
        self.waiting: list = []  # [msg_id, yes, direct, arrived]
        self.out: list = []
        if state:
            self.__dict__.update(zip(self.FIELDS, json.loads(state)))

    def state(self) -> str:
        return json.dumps([getattr(self, f) for f in self.FIELDS])

    def emit(self, at: int, msg_id: int, action: str) -> None:
        self.out.append((at, msg_id, action))

    def lock(self, at: int, ticks: int) -> None:
        if ticks:
            self.free_at = (at // self.tick + ticks) * self.tick

    def fire(self) -> int:
        """When the newest message can be checked: at a tick after it came, with no wait and no lock."""
        after = (self.pending[2] // self.tick + 1) * self.tick
        return max(after, self.resume, -(-self.free_at // self.tick) * self.tick)

    def next(self) -> tuple[int, int] | None:
        """Time and kind of what happens next without any input."""
        due = []
        if self.waiting:
            due += [(self.free_at, 0), (self.waiting[0][3] + self.rules["max_wait"], 1)]
        if self.checking:
            due.append((self.checking[1] + self.rules["max_wait"], 2))
        elif self.pending:
            due.append((self.fire(), 3))
        return min(due, default=None)

    def advance(self, until: int | None) -> None:
        """All that happens up to ``until``; with None all there is to come."""
        while (due := self.next()) and (until is None or due[0] <= until):
            at, what = due
            if what < 2:
                msg_id, yes, direct, _ = self.waiting.pop(0)
                self.arrive(at, msg_id, yes, direct)
            elif what == 2:
                self.checking, self.resume = None, max(self.resume, (at // self.tick + 1) * self.tick)
            else:
                (msg_id, yes, _), self.pending = self.pending, None
                self.emit(at, msg_id, "asked")
                self.checking = [msg_id, at]
                if yes is not None:
                    self.verdict(at, msg_id, yes)

    def arrive(self, at: int, msg_id: int, yes: bool | None, direct: bool) -> None:
        if direct:
            self.pending = None
            self.emit(at, msg_id, "direct_mention")
            self.lock(at, self.rules["lock"])
        else:
            self.pending = [msg_id, yes, at]

    def verdict(self, at: int, msg_id: int, yes: bool | None) -> None:
        if not self.checking or self.checking[0] != msg_id or yes is None:
            return
        self.checking = None
        self.streak = 0 if yes else self.streak + 1
        wait = self.streak if self.streak <= 3 else 3 * self.rules["cap_holds"]
        self.resume = (at // self.tick + 1 + wait) * self.tick
        if yes:
            self.emit(at, msg_id, "verdict")
            self.lock(at, self.rules["verdict_lock"])

    def hear(self, at: int, kind: int, msg_id: int | None, direct: bool | None, yes: bool | None) -> None:
        self.advance(at)
        if kind == REPLY:
            self.free_at = min(self.free_at, at)
            self.advance(at)
        elif kind == VERDICT:
            self.verdict(at, msg_id, yes)
        elif kind == MESSAGE and at < self.free_at:
            if self.waiting and not direct and not self.waiting[-1][2]:
                self.waiting.pop()
            self.waiting.append([msg_id, yes, bool(direct), at])
        elif kind == MESSAGE:
            self.arrive(at, msg_id, yes, bool(direct))

    def take(self) -> list:
        out, self.out = self.out, []
        return out


def rules_of(conf: ChatConfig, cap_holds: bool = False) -> dict:
    return {
        "tick": cfg.TICK_MILLIS,
        "lock": conf.lock_ticks,
        "verdict_lock": conf.verdict_lock_ticks,
        "max_wait": conf.max_wait_millis,
        "cap_holds": cap_holds,
    }


# --- input -------------------------------------------------------------------


def events(
    messages: DataFrame, conf: ChatConfig, verdicts: DataFrame | None = None, replies: DataFrame | None = None
) -> DataFrame:
    """The three inputs as one table of ``EVENTS``, and their times as ``ts``.

    ``messages``: msg_id, channel_id, ts, author_id, is_bot, content, mentioned_ids, and answer
    where it is known beforehand.  The bot's own are its replies; other bots are not heard.
    ``verdicts``: channel_id, ts, msg_id, answer.  ``replies``: channel_id, ts.
    """
    yes = lambda answer: jsonio.affirmative(tx.trim_all(answer))
    known = yes(F.col("answer")) if "answer" in messages.columns else F.lit(None)
    own = F.col("author_id") == conf.bot_id
    direct = gate.direct_mention(F.col("mentioned_ids"), F.col("content"), conf.bot_id, conf.direct_mention_min_length)

    def rows(table: DataFrame, kind: Column, msg_id: Column, direct: Column, yes: Column) -> DataFrame:
        return table.select(
            "channel_id", F.unix_millis("ts").alias("at"), kind.cast("int").alias("kind"), msg_id.cast("long").alias("msg_id"),
            direct.cast("boolean").alias("direct"), yes.cast("boolean").alias("yes"), "ts",
        )

    none = F.lit(None)
    heard = messages.where(own | ~F.col("is_bot"))
    out = rows(heard, F.when(own, REPLY).otherwise(MESSAGE), F.col("msg_id"), F.coalesce(direct, F.lit(False)), known)
    if verdicts is not None:
        out = out.unionByName(rows(verdicts, F.lit(VERDICT), F.col("msg_id"), none, yes(F.col("answer"))))
    if replies is not None:
        out = out.unionByName(rows(replies, F.lit(REPLY), none, none, none))
    return out


def newest_only(rows: DataFrame) -> DataFrame:
    """Of the messages of a channel and tick that do not name the bot, the newest.

    And that only if none after it in the tick names the bot: the machine would forget the
    others.  Partial aggregation leaves a row for each channel, tick and task to shuffle,
    however many messages there are.
    """
    plain = (F.col("kind") == MESSAGE) & ~F.col("direct")
    place = F.struct("at", "msg_id")
    last = rows.where(F.col("kind") == MESSAGE).groupBy("channel_id", F.expr(f"at div {cfg.TICK_MILLIS}").alias("_tick")).agg(
        F.max_by(F.struct("at", "kind", "msg_id", "direct", "yes"), place).alias("_m")
    )
    return rows.where(~plain).drop("ts").unionByName(last.select("channel_id", "_m.*").where(~F.col("direct")))


# --- batch -------------------------------------------------------------------


def following(rules: dict):
    """The rows of a task, sorted by channel and time, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list = []
        key, channel = None, None

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = list(zip(*done)) or [()] * 4
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["channel_id", "at", "msg_id", "action"])

        def close() -> None:
            channel.advance(None)
            done.extend((key, *row) for row in channel.take())

        for rows in batches:
            for channel_id, *event in zip(*(c.to_pylist() for c in rows.columns)):
                if channel is None or channel_id != key:
                    if channel:
                        close()
                    key, channel = channel_id, Channel(rules)
                channel.hear(*event)
            if channel:
                done.extend((key, *row) for row in channel.take())
            yield batch()
        if channel:
            close()
            yield batch()

    return run


def answers(rows: DataFrame, conf: ChatConfig, cap_holds: bool = False) -> DataFrame:
    """(channel_id, at, msg_id, action) of a table of ``events``.

    Actions: ``asked`` (put to the model), ``verdict`` and ``direct_mention`` (answered).
    A channel is followed row after row by one task, as a stream that holds one state; it
    gets at most one row for each tick, besides mentions and replies.
    """
    names = ["channel_id", "at", "kind", "msg_id", "direct", "yes"]
    dealt = newest_only(rows).select(names).repartition("channel_id")
    return dealt.sortWithinPartitions("channel_id", "at", "kind", "msg_id").mapInArrow(following(rules_of(conf, cap_holds)), ANSWERS)
