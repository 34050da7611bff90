"""The second backend in the chains: its requests, and what its responses come to."""

import json

from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.plans import chains


def said(text):
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})


def test_answers(spark):
    bodies = [said("Yes."), said("No"), '{"promptFeedback":{"blockReason":"SAFETY"}}', '{"error":{"code":429}}', "", None, '{"candidates":[]}', said("")]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id bigint, body string")
    got = {r.request_id: (r.status, r.text) for r in chains.model_answers(df, second_backend=True).collect()}
    lost = ("malformed", None)
    assert got == {0: ("ok", "Yes."), 1: ("ok", "No"), 2: ("blocked", None), 3: lost, 4: lost, 5: lost, 6: lost, 7: ("ok", "")}
    verdicts = {r.msg_id: r.answer for r in chains.verdicts_of(df, second_backend=True).collect()}
    assert verdicts == {0: "Yes.", 1: "No", **{i: "" for i in range(2, 8)}}
    # The first backend does not understand these.
    assert {r.status for r in chains.model_answers(df.where("body <> ''")).collect()} == {"malformed"}


def test_gate_on_verdicts_of_the_second_backend(spark):
    conf = ChatConfig()
    rows = [(1, 1, 100, said("yes")), (2, 2, 100, '{"promptFeedback":{}}'), (3, 3, 100, said("nope"))]
    df = spark.createDataFrame(rows, "msg_id bigint, channel_id bigint, s bigint, body string")
    messages = df.select(
        "msg_id", "channel_id", F.timestamp_seconds("s").alias("ts"), F.lit(7).cast("bigint").alias("author_id"),
        F.lit(False).alias("is_bot"), F.lit("hello there").alias("content"), F.array().cast("array<bigint>").alias("mentioned_ids"),
    )
    verdicts = chains.verdicts_of(df.select(F.col("msg_id").alias("request_id"), "body"), second_backend=True)
    got = [(r.channel_id, r.msg_id, r.reason) for r in chains.reply_gate(messages, verdicts, conf).collect()]
    assert got == [(1, 1, "verdict")]
