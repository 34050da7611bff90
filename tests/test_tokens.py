"""Token assembly, batch and stream, against a token-by-token replay."""

import random
import re

import pytest

from threadloom.config import ChatConfig, end_marker_pattern
from threadloom.operators.tokens import assemble_tokens
from threadloom.streaming import operators as st
from threadloom.streaming import runs
from threadloom.sources import readers

CONF = ChatConfig()
MARK = re.compile(end_marker_pattern("Bot"), re.IGNORECASE)


def replay(tokens, header, limit):
    heard, text, listening = "", "", False
    for t in tokens:
        if listening:
            text += t
            stripped = MARK.sub("", text)
            if len(text) > 2 and (MARK.search(text) or len(text) > limit) and stripped:
                return "finished", stripped
        else:
            heard += t
            if header in heard:
                listening = True
    return ("listening" if listening else "no_header"), None


@pytest.fixture(scope="module")
def requests():
    rng = random.Random(4)
    out = {}
    for i in range(60):
        head = rng.choice([["### Response:\n[Bot]:"], ["noise ", "##", "# Resp", "onse:\n", "[Bot]", ":x"], ["no header "] * 5])
        noise = ["filler "] * rng.choice([0, 3, 40])
        body = [rng.choice(["a ", "word ", "]:", "<end", "\n[", "b", "longer text here "]) for _ in range(rng.randint(0, 60))]
        out[i] = noise + head + body
    out[100] = ["w "] * 3000 + ["### Response:\n", "[Bot]:"] + ["w "] * 900
    out[101] = ["### Response:\n[Bot]:"] + ["]:"] * 300 + ["end"]
    return out


def rows(spark, requests):
    data = [(i, n, '{"response":"%s","done":"0"}' % t.replace("\n", "\\n")) for i, ts in requests.items() for n, t in enumerate(ts)]
    return spark.createDataFrame(data, "request_id bigint, seq bigint, raw string").repartition(4)


@pytest.mark.parametrize("block", [1, 8, 2048])
def test_batch(spark, requests, block):
    got = {r.request_id: (r.status, r.reply) for r in assemble_tokens(rows(spark, requests), CONF.reply_header, 100, "Bot", block).collect()}
    for i, tokens in requests.items():
        assert got[i] == replay(tokens, CONF.reply_header, 100), i


def test_stream(spark, requests, tmp_path):
    df = rows(spark, requests)
    for part in ("seq < 7", "seq BETWEEN 7 AND 30", "seq > 30"):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = readers.read_stream(spark, str(tmp_path / "in"), df.schema, files_per_trigger=1)
    replies = st.assemble_tokens(stream, CONF.reply_header, CONF, 100)
    got = runs.to_table(replies, str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    want = {i: replay(t, CONF.reply_header, 100)[1] for i, t in requests.items()}
    assert {r.request_id: r.reply for r in got} == {i: r for i, r in want.items() if r is not None}
