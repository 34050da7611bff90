"""Tags of messages: one pass, whatever the rows are."""

from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.operators import resolve
from threadloom.plans.chains import sanitize_live

A, B, X = 100000000000001, 100000000000002, 100000000000999
USERS = [(A, "ann", "Annie"), (A, "ann", "Zoe"), (B, "bob", None)]


def dims(spark):
    users = spark.createDataFrame(USERS, "user_id long, username string, nickname string").withColumn("display_name", F.lit(None).cast("string"))
    return users, spark.createDataFrame([(A, "room")], "channel_id long, name string")


def test_tags_of_odd_rows(spark):
    texts = [
        (1, f"<@{A}> and <#{A}> and <@{A}>"), (2, f"<@{B}> <@{X}> <@{A}>"), (3, "no tag"), (4, None), (4, None), (5, ""),
        (6, f"<@{B}>"), (6, f"<@{B}>"), (6, f"<@{A}> other"), (None, f"x <@{B}>"), (None, "y"), (7, f"<@{X}>"),
    ]
    df = spark.createDataFrame(texts, "msg_id long, content string").withColumn("extra", F.array(F.lit(1)))
    got = sorted(map(tuple, resolve.resolve_mentions(df, *dims(spark), "content", "msg_id", "out").select("msg_id", "out").collect()), key=repr)
    want = [
        (1, "Annie and #room and Annie"), (2, f"bob <@{X}> <@{A}>"), (3, "no tag"), (4, None), (4, None), (5, ""),
        (6, "bob"), (6, "bob"), (6, "Annie other"), (None, "x bob"), (None, "y"), (7, f"<@{X}>"),
    ]
    assert got == sorted(want, key=repr)
    every = resolve.resolve_mentions(df, *dims(spark), "content", "msg_id", stop_on_unknown=False)
    assert every.columns == df.columns and every.where("msg_id = 2").first().content == f"bob <@{X}> Annie"
    assert resolve.resolve_mentions(df.limit(0), *dims(spark), "content", "msg_id").collect() == []


def test_live_chain_reads_its_messages_once(spark, tmp_path):
    path = str(tmp_path / "messages")
    spark.createDataFrame([(1, 5, A, "hi", 0)], "msg_id long, channel_id long, author_id long, content string, n_attachments int").write.parquet(path)
    users, channels = dims(spark)
    plan = sanitize_live(spark.read.parquet(path), users, channels, ChatConfig())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
