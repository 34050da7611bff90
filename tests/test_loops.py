"""Reply policies against a message-by-message replay."""

import random
import re

from test_distance import plain

from threadloom.operators import loops


def bare(x):
    return re.sub(r"\s+", "", x)


def near_line(reply, lines):
    for line in lines:
        if line and plain(bare(reply), bare(line)) < len(reply) // 3:
            return line
    return None


def memory(lines, i, budget):
    """Lines of the last characters of the transcript before line i."""
    return "".join(x + "\n" for x in lines[:i])[-budget:].split("\n")


def replay(replies, lines, budget):
    last, loops_seen, out = "<noinput>", 0, []
    for i, reply in enumerate(replies):
        hit = near_line(reply, memory(lines, i, budget))
        if reply == last:
            if loops_seen < 2:
                loops_seen += 1
                out.append("retry")
            else:
                loops_seen = 0
                out.append("give_up")
        elif hit is not None:
            out.append("wipe_and_retry")
        else:
            out.append("send")
            if reply.strip():
                last = reply
    return out


def test_replay(spark):
    rng = random.Random(11)
    bases = ["hello there my friend", "hello there my fr1end!", "what is 2 + 2", "   ", "", "ok", "something else entirely 42"]
    groups = {}
    for key, n in ((1, 120), (2, 9), (3, 1)):
        replies = [rng.choice(bases) for _ in range(n)]
        lines = [rng.choice([r, f"[Bot]: {r}", " ", "", "unrelated line of text"]) for r in replies]
        groups[key] = (replies, lines)
    rows = [(k, i, r, line) for k, (rs, ls) in groups.items() for i, (r, line) in enumerate(zip(rs, ls))]
    df = spark.createDataFrame(rows, "k bigint, pos bigint, reply string, line string").repartition(4)
    for block in (4, 1000):
        near = loops.near_duplicate_reply(df, "k", "pos", "reply", "line", 60, block).collect()
        for r in near:
            assert r.near_line == near_line(r.reply, memory(groups[r.k][1], r.pos, 60)), r
        judged = loops.judge_replies(df, "k", "pos", "reply", "line", "Bot", 60, block).collect()
        for key, (replies, lines) in groups.items():
            got = [r.policy for r in sorted(judged, key=lambda r: r.pos) if r.k == key]
            assert got == replay(replies, lines, 60)


def test_repeat_twelve_turns_back(spark):
    """The memory is measured in characters: short lines reach further back than nine turns."""
    said = ["tell me a story about the sea"] + [f"line {i}" for i in range(11)] + ["tell me a story about the sea"]
    df = spark.createDataFrame([(1, i, t, t) for i, t in enumerate(said)], "k bigint, pos bigint, reply string, line string")
    got = {r.pos: r.near_line for r in loops.near_duplicate_reply(df, "k", "pos", "reply", "line").collect()}
    assert got[12] == said[0]
