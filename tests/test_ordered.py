"""Block windows against plain loops; one conversation holds most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from threadloom.operators import loops, ordered, transcript


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    rows = []
    for key, n in ((1, 700), (2, 40), (3, 1), (4, 64)):
        rows += [(key, i, rng.choice([None, 0, 1, 2, 5]), "x" * rng.choice([0, 1, 3, 30]) + str(i)) for i in range(n)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k bigint, pos bigint, v bigint, line string").repartition(4)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[:2]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_running(data, block):
    rows, df = data
    out = ordered.running(df, "k", "pos", F.col("v"), "s", "sum", block)
    out = ordered.running(out, "k", "pos", F.col("v"), "m", "max", block, before=True)
    out = ordered.last_value(out, "k", "pos", F.when(F.col("v") > 1, F.col("line")), "last", block)
    got = {(r.k, r.pos): (r.s, r.m, r.last) for r in out.collect()}
    want = {}
    for key, group in by_key(rows).items():
        total, top, last = 0, None, None
        for _, pos, v, line in group:
            total += v or 0
            last = line if v is not None and v > 1 else last
            want[key, pos] = (total, top, last)
            top = top if v is None else v if top is None else max(top, v)
    assert got == want


@pytest.mark.parametrize("block", [1, 5, 10_000])
def test_look_back(data, block):
    rows, df = data
    got = {(r.k, r.pos): r.recent for r in transcript.last_n_lines(df, "k", "pos", "line", 4, block).collect()}
    want = {}
    for key, group in by_key(rows).items():
        for i, r in enumerate(group):
            want[key, r[1]] = [g[3] for g in group[max(0, i - 3) : i + 1]]
    assert got == want


@pytest.mark.parametrize("block", [1, 90, 10_000])
def test_char_budget(data, block):
    rows, df = data
    budget = 83
    tail = transcript.char_budget_suffix(df, "k", "pos", "line", budget, block)
    both = transcript.char_budget_lines(tail, "k", "pos", "line", budget, block)
    got = {(r.k, r.pos): (r.tail, r.lines) for r in both.collect()}
    want = {}
    for key, group in by_key(rows).items():
        text, lines = "", []
        for r in group:
            text += r[3] + "\n"
            lines = [*lines, r[3]]
            while sum(len(x) + 1 for x in lines) > budget:
                lines = lines[1:]
            want[key, r[1]] = (text[-budget:], lines)
    assert got == want


def test_transcript_segments(data):
    rows, df = data
    got = transcript.build_transcript(df, "k", "pos", "line", 50).orderBy("k", "segment").collect()
    assert max(r.n_lines for r in got) == 50
    for key, group in by_key(rows).items():
        assert "\n".join(r.transcript for r in got if r.k == key) == "\n".join(g[3] for g in group)


def test_number_rows(spark):
    rng = random.Random(3)
    times = {k: rng.sample(range(100_000), n) for k, n in ((1, 500), (2, 3))}
    df = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "k int, t int")
    out = ordered.number_rows(df, "k", ["t"], F.floor(F.col("t") / 1000)).collect()
    for k, ts in times.items():
        order = {t: i for i, t in enumerate(sorted(ts))}
        assert {r.t: r.pos for r in out if r.k == k} == order


def test_exact_repeat_and_policy(spark):
    rows = [(1, i, "same") for i in range(6)] + [(2, 0, "<noinput>"), (2, 1, "a"), (2, 2, "b")]
    df = spark.createDataFrame(rows, "k int, pos bigint, reply string")
    out = loops.repeat_policy(loops.exact_repeat(df, "k", "pos", "reply", 2), "k", "pos", "is_repeat", 2)
    got = {(r.k, r.pos): r.policy for r in out.collect()}
    assert [got[1, i] for i in range(6)] == [None, "retry", "retry", "give_up", "retry", "retry"]
    assert [got[2, i] for i in range(3)] == ["retry", None, None]


def test_tail_and_edges_of_a_long_conversation(spark):
    said = [f"line {i}" for i in range(3000)]
    rows = [(1, i, t) for i, t in enumerate(said)] + [(2, 5, "one"), (2, 2_007, "two"), (3, 0, "only")]
    df = spark.createDataFrame(rows, "k bigint, pos bigint, line string")
    segments = transcript.build_transcript(df, "k", "pos", "line", 1000)
    got = {(r.k, r.segment): r.tail for r in transcript.with_tail(segments, "k", "transcript", 12_000).collect()}
    assert got[1, 2] == ("\n".join(said) + "\n")[-12_000:] and got[1, 0] is got[1, 1] is None
    assert got[2, 2] == "one\ntwo\n" and got[3, 0] == "only\n"
    kept = transcript.without_edges(df, "k", "pos", "line", first=2, last=1).orderBy("k", "segment").collect()
    assert "\n".join(r.transcript for r in kept if r.k == 1) == "\n".join(said[2:-1])
    assert [r.transcript for r in kept if r.k > 1] == [None, None, None]


GAPS = [0, 1, 2, 7, 8, 9, 50, 51, 400]


@pytest.mark.parametrize("block", [1, 4, 64, 10_000])
def test_lines_and_memory_of_messages_with_notes_and_gaps(spark, block):
    rng = random.Random(3)
    positions = {1: GAPS, 2: range(0, 3000, 3), 3: [5], 4: range(3000)}
    rows = [(k, p, None if rng.random() < 0.05 else "\n".join("x" * rng.choice([0, 3, 40]) + str(p) for _ in range(rng.choice([1, 1, 2, 12])))) for k, ps in positions.items() for p in ps]
    df = spark.createDataFrame(rows, "k bigint, pos bigint, line string").repartition(3)
    recent = {(r.k, r.pos): r.recent for r in transcript.last_text_lines(df, "k", "pos", "line", 5, block).collect()}
    memory = {(r.k, r.pos): r.memory for r in transcript.memory_text(df, "k", "pos", "line", 90, block).collect()}
    assert len(recent) == len(memory) == len(rows)
    for key, group in by_key(rows).items():
        so_far = ""
        for _, pos, line in group:
            so_far += (line or "") + "\n"
            assert recent[key, pos] == so_far[:-1].split("\n")[-5:]
            assert memory[key, pos] == so_far[-90:]


def test_last_lines_over_a_gap(spark):
    df = spark.createDataFrame([(1, p, f"x{p}") for p in GAPS[:6]], "k bigint, pos bigint, line string")
    got = {r.pos: r.recent for r in transcript.last_text_lines(df, "k", "pos", "line", 3, 4).collect()}
    assert got[7] == ["x1", "x2", "x7"] and got[8] == ["x2", "x7", "x8"]


def test_picture_request_is_read_without_the_note(spark):
    from threadloom import ChatConfig
    from threadloom.plans import chains

    rows = [(1, 1, 0, 7, "see this?", "[A]: do you see this", "\n[System]: A attached an image"), (2, 1, 1, 7, "x", "[A]: take a picture of you", "")]
    df = spark.createDataFrame(rows, "msg_id bigint, conv_id bigint, turn bigint, author_id bigint, content string, filtered string, note string")
    df = df.withColumn("line", F.concat("filtered", "note")).withColumn("ref_msg_id", F.lit(None).cast("bigint"))
    users = spark.createDataFrame([(7, "A")], "user_id bigint, username string")
    got = {r.msg_id: r for r in chains.reply_requests(df, users, ChatConfig(), filtered="filtered").collect()}
    assert not got[1].is_picture and "attached an image" in got[1].prompt and got[2].is_picture
    asked = {r.msg_id: r.prompt for r in chains.verdict_requests(df, users, ChatConfig(), filtered="filtered").collect()}
    assert "[A]: do you see this\n[System]: A attached an image\n[A]: take a picture of you\n" in asked[2]
