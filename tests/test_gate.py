"""Ticks, cooldown, backoff, names."""

import random

from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.operators import gate
from threadloom.plans import chains

TICK = 5500


def test_cooldown_of_a_busy_channel(spark):
    rng = random.Random(2)
    ticks = {1: sorted(rng.choices(range(1000, 3000), k=3000)), 2: [5, 16, 17, 400, 409, 410], 3: [7]}
    rows = [(k, i, t * TICK + rng.randint(0, TICK - 1)) for k, ts in ticks.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "channel_id bigint, msg_id int, ms bigint").withColumn("ts", F.timestamp_millis("ms"))
    for chunk in (11, 64, 100_000):
        got = gate.cooldown(df, ticks=10, chunk_ticks=chunk).collect()
        for k, ts in ticks.items():
            free, want = 0, {}
            for t in sorted(set(ts)):
                want[t] = t >= free
                free = t + 10 if t >= free else free
            assert {r.tick: r.accepted for r in got if r.channel_id == k} == want
            assert sum(r.n_messages for r in got if r.channel_id == k) == len(ts)


def test_release_time(spark):
    base = 1_000_000
    ts = F.timestamp_millis(F.lit(base * TICK))
    cases = {base: 0, base - 5: 0, base + 2: 11, base + 10: 45}
    for free, seconds in cases.items():
        waited = gate.release_time(ts, F.lit(free).cast("bigint")).cast("double") - ts.cast("double")
        assert spark.range(1).select(waited).first()[0] == seconds


def test_backoff(spark):
    df = spark.createDataFrame([(1, i, "no") for i in range(5)] + [(1, 5, "Yes"), (1, 6, "no")], "c int, pos bigint, a string")
    got = sorted(gate.negative_streak_backoff(df, "c", "pos", "a", 2).collect(), key=lambda r: r.pos)
    assert [r.wait for r in got] == [1, 2, 3, 0, 0, 0, 1]


def test_owner_toggle(spark):
    said = [(1, "Enable Gemini"), (1, "enable gemini"), (2, "disable gemini"), (1, "hi"), (1, "DISABLE GEMINI")]
    df = spark.createDataFrame([(9, i, a, c) for i, (a, c) in enumerate(said)], "ch int, pos bigint, author int, content string")
    command = gate.owner_command(F.col("content"), F.col("author"), 1)
    got = sorted(gate.toggle_state(df, "ch", "pos", command, 2).collect(), key=lambda r: r.pos)
    assert [r.swallowed for r in got] == [True, False, False, False, True]
    assert [r.mode_after for r in got] == [True, True, True, True, False]


def test_names(spark):
    name = "display_name string, nickname string, username string"
    rows = [
        (1, 1, (None, None, "a"), ("D", "N", "b")),
        (1, 2, ("D", None, "a"), ("D", "N", "b")),
        (1, 3, ("D", "N", "b"), ("D", "M", "b")),
        (2, 1, (None, None, "a"), (None, None, "b")),
    ]
    df = spark.createDataFrame(rows, f"member_id int, seq int, before struct<{name.replace(' string', ':string')}>, after struct<{name.replace(' string', ':string')}>")
    initial = spark.createDataFrame([(1, "x", "y"), (3, None, "z")], "member_id int, nickname string, username string")
    got = {r.member_id: r.name for r in gate.current_names(df, initial).collect()}
    assert got == {1: "N", 2: "b", 3: "z"}


def test_newest_message_of_a_tick_wins(spark):
    rows = [(1, 10, 0, "a", 5), (1, 11, 1, "b", 5), (1, 12, 6, "c", 5), (1, 13, 7, f"{'x' * 30}", 5)]
    df = spark.createDataFrame(rows, "channel_id bigint, msg_id bigint, s bigint, content string, author_id bigint").select(
        "*", F.timestamp_seconds("s").alias("ts"), F.lit(False).alias("is_bot"),
        F.when(F.col("msg_id") == 13, F.array(F.lit(99).cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("mentioned_ids"),
    )
    verdicts = spark.createDataFrame([(10, "yes"), (11, "yes"), (12, "no")], "msg_id bigint, answer string")
    got = chains.reply_gate(df, verdicts, ChatConfig(bot_id=99)).collect()
    assert sorted((r.msg_id, r.reason) for r in got) == [(11, "verdict"), (13, "direct_mention")]
