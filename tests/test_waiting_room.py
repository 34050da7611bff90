"""The whole gate: locks, waits, backoff; batch, stream and the bare machine agree."""

import random

from pyspark.sql import functions as F

from threadloom import ChatConfig
from threadloom.operators import waiting_room as room
from threadloom.operators.waiting_room import CLOCK, MESSAGE, REPLY, VERDICT, Channel
from threadloom.sources import readers
from threadloom.streaming import operators as st
from threadloom.streaming import runs

TICK = 5500
CONF = ChatConfig(bot_id=99)


def said(events, until=None, **options):
    channel = Channel(room.rules_of(CONF, **options))
    for e in events:
        channel.hear(*e)
    channel.advance(until)
    return [(at, i, action) for at, i, action in channel.take() if action != "asked"]


def message(at, i, direct=False, yes=None):
    return (at, MESSAGE, i, direct, yes)


def test_mention_locks_until_the_reply():
    events = [message(0, 1, True), message(1000, 2, True), (7000, REPLY, None, None, None), message(8000, 3, True)]
    assert said(events) == [(0, 1, "direct_mention"), (7000, 2, "direct_mention"), (53_000, 3, "direct_mention")]


def test_wait_ends_after_45_seconds_though_the_lock_holds():
    assert said([message(0, 1, True), message(100, 2, True)]) == [(0, 1, "direct_mention"), (45_100, 2, "direct_mention")]
    assert said([message(0, 1, True), message(20_000, 2, True)]) == [(0, 1, "direct_mention"), (10 * TICK, 2, "direct_mention")]
    # What waits and does not name the bot is checked at a tick after the lock.
    assert said([message(0, 1, True), message(20_000, 2, yes=True)]) == [(0, 1, "direct_mention"), (11 * TICK, 2, "verdict")]
    # A mention makes the gate forget what came before it.
    assert said([message(0, 1, yes=True), message(10, 2, True)]) == [(10, 2, "direct_mention")]


def test_checks_wait_after_each_no():
    asked = []
    channel = Channel(room.rules_of(CONF))
    for i in range(30):
        channel.hear(*message(i * TICK, i, yes=False))
    channel.advance(None)
    asked = [at // TICK for at, _, action in channel.take() if action == "asked"]
    assert asked[:7] == [1, 3, 6, 10, 11, 12, 13]  # waits of 1, 2, 3 ticks, then none
    holds = Channel(room.rules_of(CONF, cap_holds=True))
    for i in range(30):
        holds.hear(*message(i * TICK, i, yes=False))
    holds.advance(None)
    assert [at // TICK for at, *_ in holds.take()][:6] == [1, 3, 6, 10, 14, 18]


def test_verdicts_that_come_later():
    events = [message(0, 1), (6000, VERDICT, 1, None, False), message(6100, 2), (11_600, VERDICT, 2, None, True), message(16_600, 3), (22_100, VERDICT, 3, None, True)]
    # The no makes the check of 2 wait a tick, so that a verdict before it is not heard; the next is asked once 45 seconds are over.
    assert said(events) == []
    assert said([message(0, 1), (6000, VERDICT, 1, None, True)]) == [(6000, 1, "verdict")]
    assert said([message(0, 1), (6000, VERDICT, 7, None, True), (60_000, VERDICT, 1, None, True)]) == []


def table(spark, events):
    schema = "channel_id bigint, at bigint, kind int, msg_id bigint, direct boolean, yes boolean"
    return spark.createDataFrame(events, schema).withColumn("ts", F.timestamp_millis("at"))


def random_events(seed, channels=6, n=120):
    r = random.Random(seed)
    out, i = [], 0
    for c in range(channels):
        at = 0
        for _ in range(n):
            i += 1
            at += r.choice([0, 300, 2000, 5500, 20_000])
            kind = r.choice([MESSAGE] * 6 + [REPLY])
            out.append((c, at, kind, i if kind == MESSAGE else None, kind == MESSAGE and r.random() < 0.3, r.choice([True, False, None])))
    return out


def bare(events, conf):
    out = set()
    for c in {e[0] for e in events}:
        channel = Channel(room.rules_of(conf))
        for e in sorted((e[1:] for e in events if e[0] == c), key=lambda e: (e[0], e[1], e[2] or 0)):
            channel.hear(*e)
        channel.advance(None)
        out |= {(c, *row) for row in channel.take()}
    return out


def test_batch_reduces_messages_without_a_change(spark):
    for seed, conf in ((1, CONF), (2, ChatConfig(bot_id=99, verdict_lock_ticks=2))):
        events = random_events(seed)
        got = {tuple(r) for r in room.answers(table(spark, events).repartition(5), conf).collect()}
        want = bare(events, conf)
        assert {w for w in got if w[3] != "asked"} == {w for w in want if w[3] != "asked"} and len(got) > 100
        assert room.newest_only(table(spark, events)).count() < len(events)


def test_stream_with_timers(spark, tmp_path):
    """Several files, a short watermark: what is due comes out as the clock passes it."""
    events = random_events(3, channels=4, n=60)
    source = str(tmp_path / "in")
    last = max(e[1] for e in events)
    step = last // 4 + 1
    for lo in range(0, last + 1, step):
        table(spark, [e for e in events if lo <= e[1] < lo + step]).coalesce(1).write.mode("append").parquet(source)
    for later in (10**7, 10**7 + 10**6):
        table(spark, [(-1, last + later, CLOCK, None, None, None)]).coalesce(1).write.mode("append").parquet(source)
    stream = readers.read_stream(spark, source, table(spark, events).schema, files_per_trigger=1)
    got = runs.to_table(st.reply_gate(stream, CONF, "1 second"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {tuple(r) for r in got.collect()} == bare(events, CONF)


def test_empty_and_odd_input(spark):
    none = table(spark, [])
    assert room.answers(none, CONF).collect() == []
    rows = [(None, 0, MESSAGE, 1, True, None), (1, 0, REPLY, None, None, None), (1, 5, CLOCK, None, None, None)]
    assert [tuple(r) for r in room.answers(table(spark, rows), CONF).collect()] == [(None, 0, 1, "direct_mention")]
