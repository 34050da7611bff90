"""Streams over split files give what batch gives over all."""

import random
from pathlib import Path

import pytest
from compare import compare, oracle_connection
from pyspark.sql import functions as F

from threadloom import ChatConfig
from threadloom.operators import gate, transcript
from threadloom.plans import catalog, catalog_stream
from threadloom.sources import readers
from threadloom.streaming import operators as st
from threadloom.streaming import runs


def files_of(df, source, parts):
    """A file for each part, to be read one after another."""
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(source)
    return readers.read_stream(df.sparkSession, source, df.schema, files_per_trigger=1)


def state_rows(spark, checkpoint):
    return spark.read.format("statestore").load(checkpoint).count()


@pytest.mark.parametrize("budget", [40, 900])
def test_running_transcript_across_batches(spark, tmp_path, budget):
    rng = random.Random(6)
    sizes = {1: 90, 2: 12, 3: 1}
    rows = [(k, i, "x" * rng.choice([0, 2, 9, 70]) + str(i)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, line string")
    stream = files_of(df, str(tmp_path / "in"), [f"turn >= {lo} AND turn < {lo + 30}" for lo in (0, 30, 60)])
    got = runs.to_table(st.running_transcript(stream, budget), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = transcript.char_budget_suffix(df, "conv_id", "turn", "line", budget)
    key = ["conv_id", "turn", "tail"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert state_rows(spark, str(tmp_path / "cp")) == len(sizes)


def test_ticks_with_late_rows_and_open_ticks(spark, tmp_path):
    """Rows that come files later mend their tick; the last ticks are there without a later row."""
    rng = random.Random(2)
    rows = [(rng.randrange(3), i, rng.randrange(200), f"m{i}", rng.randrange(4)) for i in range(400)]
    df = spark.createDataFrame(rows, "channel_id bigint, msg_id bigint, s bigint, content string, part int").withColumn("ts", F.timestamp_seconds("s"))
    stream = files_of(df, str(tmp_path / "in"), [f"part = {i}" for i in range(4)])
    columns = ["channel_id", "tick_start", "msg_id", "content", "n_messages"]
    got = st.ticks_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"), delay="5 minutes").select(columns)
    want = gate.latest_per_tick(df).select(columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_token_state_ends(spark, tmp_path):
    """A request is given up, finished ones leave a mark that swallows late tokens, and both go in the end."""
    conf = ChatConfig(bot_name="Bot")
    token = lambda r, q, s, w, part: (r, q, s, '{"response":"' + w + '","done":"0"}', part)
    rows = [
        token(1, 0, 0, "### Response:\\n[Bot]:", 0), token(1, 1, 1, "well done ", 0), token(1, 2, 2, "\\n# next", 0), token(1, 3, 3, "late", 1),
        token(2, 0, 0, "### Response:\\n[Bot]:", 0), token(2, 1, 1, "half", 0), token(2, 2, 995, "after", 3),
        token(3, 0, 0, "no header", 0), token(9, 0, 1000, "x", 1), token(9, 1, 1001, "x", 2), token(9, 2, 4000, "x", 3), token(9, 3, 8000, "x", 4), token(9, 4, 8001, "x", 5),
    ]
    df = spark.createDataFrame(rows, "request_id bigint, seq bigint, s bigint, raw string, part int").withColumn("ts", F.timestamp_seconds(F.col("s") + 100)).drop("s")
    stream = files_of(df, str(tmp_path / "in"), [f"part = {i}" for i in range(6)])
    got = runs.to_table(st.assemble_tokens(stream, conf.reply_header, conf), str(tmp_path / "out"), str(tmp_path / "cp")).where("request_id <> 9")
    assert {tuple(r) for r in got.collect()} == {(1, "finished", "well done  next"), (2, "timed_out", "half"), (3, "timed_out", None)}
    assert state_rows(spark, str(tmp_path / "cp")) <= 1  # that of the clock, request 9


def test_backfill_once_per_channel(spark, tmp_path):
    rows = [(c * 100 + i, c, i, f"m{i}") for c in (1, 2) for i in range(8)]
    df = spark.createDataFrame(rows, "msg_id bigint, channel_id bigint, s bigint, content string")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    source = str(tmp_path / "in")
    for part in ("msg_id IN (105, 106)", "msg_id IN (107, 207)"):
        df.where(part).coalesce(1).write.mode("append").parquet(source)
    stream = readers.read_stream(spark, source, df.schema, files_per_trigger=1)
    history = df.where("msg_id NOT IN (106, 107, 207)")
    got = st.backfill_then_live(stream, history, str(tmp_path / "out"), str(tmp_path / "cp"), 3)
    assert sorted((r.msg_id, r.is_live) for r in got.collect()) == [
        (103, False), (104, False), (105, True), (106, True), (107, True), (204, False), (205, False), (206, False), (207, True),
    ]


def test_backfill_reads_no_output_and_keeps_late_copies_live(spark, tmp_path, monkeypatch):
    rows = [(c * 100 + i, c, i) for c in (1, 2, 3) for i in range(6)] + [(900, None, 7)]
    df = spark.createDataFrame(rows, "msg_id bigint, channel_id bigint, s bigint")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    # 104 is history and comes live two micro-batches after its channel was first heard.
    for part in ("msg_id IN (105, 900)", "msg_id = 205", "msg_id IN (104, 305)"):
        df.where(part).coalesce(1).write.mode("append").parquet(source)
    stream = readers.read_stream(spark, source, df.schema, files_per_trigger=1)
    history = df.where("msg_id NOT IN (105, 205, 305, 900)").unionByName(df.limit(1).withColumn("msg_id", F.lit(None).cast("bigint")))
    read_back = []
    work_of = runs.in_batches
    def watched(stream, work, *rest):
        def seen(batch, epoch):
            done = work(batch, epoch)
            read_back.extend(f for f in done.inputFiles() if f.startswith(f"file://{out}"))
            return done
        work_of(stream, seen, *rest)
    monkeypatch.setattr(runs, "in_batches", watched)
    served = spark.createDataFrame([(3,)], "channel_id bigint")
    got = st.backfill_then_live(stream, history, out, str(tmp_path / "cp"), 2, served)
    assert sorted((r.msg_id, r.is_live) for r in got.collect()) == [
        (103, False), (104, True), (105, True), (203, False), (204, False), (205, True), (305, True), (900, True),
    ]
    assert read_back == []


def test_cooldown_and_backoff_across_batches(spark, tmp_path):
    ticks = [1, 5, 11, 12, 21, 40]
    df = spark.createDataFrame([(1, t) for t in ticks], "channel_id bigint, tick bigint")
    source = str(tmp_path / "in")
    for part in ("tick < 6", "tick >= 6"):
        df.where(part).coalesce(1).write.mode("append").parquet(source)
    stream = readers.read_stream(spark, source, df.schema, files_per_trigger=1)
    got = runs.to_table(st.cooldown(stream, 10), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert {r.tick: r.accepted for r in got.collect()} == {1: True, 5: False, 11: True, 12: False, 21: True, 40: True}
    checks = stream.select("channel_id", F.col("tick").alias("pos"), F.when(F.col("tick") == 21, "Yes").otherwise("No").alias("answer"))
    got = runs.to_table(st.backoff(checks), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert {r.pos: r.wait for r in got.collect()} == {1: 1, 5: 2, 11: 3, 12: 0, 21: 0, 40: 1}


FOLDER = "/root/testdata/sf0.001"
DEALT = {"st4_stream_assemble_tokens": ("tokens", 2), "st8_stream_transcript": ("lines", 3), "st11_stream_typing_timeout": ("tokens", 1)}


@pytest.mark.parametrize("name", DEALT)
def test_written_input_is_dealt_over_tasks(spark, monkeypatch, name):
    roots = []

    class Kept(catalog_stream.Scratch):
        def __init__(self, spark):
            super().__init__(spark)
            roots.append(self.root)

    monkeypatch.setattr(catalog_stream, "Scratch", Kept)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        assert compare(spark, oracle_connection(FOLDER), name, catalog.QUERIES[name], catalog.ORACLES[name], FOLDER) is None
    finally:
        spark.conf.unset(setting)
    folder, parts = DEALT[name]
    assert len(list(Path(roots[0].removeprefix("file:"), folder).glob("*.parquet"))) > parts
