"""Chat tables derived from the plain test tables.

``MESSAGES_SQL`` and its companions are portable: Spark and an SQL oracle run the
same text.  What differs by dialect is added on the Spark side only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOT_ID = 999000000000000

# One row per turn.  The neighbours of a turn come from equi joins on
# (conversation, turn), so a long conversation does not end up in one task.
MESSAGES_SQL = """
SELECT c.conv_id * 100 + c.turn AS msg_id,
       200000000000000 + c.conv_id AS channel_id,
       c.conv_id, c.turn,
       1704067200 + c.conv_id * 3600 + c.turn * 20 AS ts_s,
       CASE WHEN c.role = 'user'
            THEN 100000000000000 + (c.conv_id * 7 + c.turn) % (SELECT count(*) FROM customer)
            ELSE 999000000000000 END AS author_id,
       c.role, c.role <> 'user' AS is_bot,
       CASE WHEN c.conv_id % 10 = 0 AND c.turn >= 1 THEN f.text
            WHEN c.k = 1 THEN '[Admin]: ' || c.text
            WHEN c.k = 2 THEN c.text || ' see example.com/path now'
            WHEN c.k = 3 THEN c.text || ' <@' || CAST(CASE WHEN c.conv_id % 2 = 0 THEN 999000000000000
                              ELSE 100000000000000 + c.conv_id END AS STRING) || '>'
            WHEN c.k = 4 THEN c.text || ' <#' || CAST(200000000000000 + c.conv_id AS STRING)
                              || '> <@999999999999999>'
            WHEN c.k = 5 THEN '(smiles) ' || c.text
            WHEN c.k = 6 THEN 'take a picture of you holding tea' || c.text
            WHEN c.k = 7 THEN c.text || ' BADWORD badwrod b1ocked thing'
            WHEN c.k = 8 THEN c.text || chr(10) || '# next'
            WHEN c.k = 9 THEN c.text || ' {x} "q" $5 ’'
            WHEN c.k = 10 AND c.turn >= 1 THEN p.text
            WHEN c.k = 11 AND c.turn >= 2 THEN substr(q.text, 1, 12) || c.text
            ELSE c.text END AS content,
       CASE WHEN c.turn % 3 = 2 THEN c.conv_id * 100 + c.turn - 1 END AS ref_msg_id,
       CASE WHEN c.k = 3 AND NOT (c.conv_id % 10 = 0 AND c.turn >= 1)
            THEN CASE WHEN c.conv_id % 2 = 0 THEN 999000000000000
                      ELSE 100000000000000 + c.conv_id END END AS mention_id,
       CASE WHEN (c.conv_id + c.turn) % 9 = 4 THEN 1 ELSE 0 END AS n_attachments
FROM (SELECT conv_id, turn, role, text, (conv_id * 7 + turn) % 12 AS k FROM conversations) c
LEFT JOIN conversations f ON f.conv_id = c.conv_id AND f.turn = 0
LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
LEFT JOIN conversations q ON q.conv_id = c.conv_id AND q.turn = c.turn - 2
"""

USERS_SQL = """
SELECT 100000000000000 + c_custkey AS user_id, c_name AS username,
       CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ''
            ELSE 'Nick.' || CAST(c_custkey AS STRING) END AS nickname,
       CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 20 = 3 THEN '***'
            ELSE 'D ' || CAST(c_custkey AS STRING) END AS display_name
FROM customer
UNION ALL
SELECT 999000000000000, 'Bot', NULL, NULL
"""

CHANNELS_SQL = """
SELECT DISTINCT 200000000000000 + conv_id AS channel_id,
       'room-' || CAST(conv_id AS STRING) AS name
FROM conversations
"""

LOGS_SQL = """
SELECT event_id AS log_id, event_type AS source,
       CASE event_id % 5 WHEN 0 THEN 'Heartbeat' WHEN 1 THEN 'GET x' WHEN 2 THEN 'MESSAGE_CREATE'
            WHEN 3 THEN 'user did ' || event_type END AS message,
       CASE WHEN event_id % 7 = 0 THEN 'failed ' || CAST(event_id AS STRING) END AS exception
FROM events
"""

MEMBER_UPDATES_SQL = """
SELECT event_id AS seq,
       CASE WHEN event_id % 3 = 0 THEN 999000000000000 ELSE 100000000000000 + user_id END AS member_id,
       CASE WHEN event_id % 2 = 0 THEN 'D' || CAST(event_id % 5 AS STRING) END AS old_display,
       CASE WHEN event_id % 5 = 0 THEN 'N' || CAST(event_id % 7 AS STRING) END AS old_nick,
       'u' || CAST(event_id % 4 AS STRING) AS old_user,
       CASE WHEN event_id % 4 = 0 THEN 'D' || CAST(event_id % 3 AS STRING) END AS new_display,
       CASE WHEN event_id % 5 IN (0, 1) THEN 'N' || CAST(event_id % 6 AS STRING) END AS new_nick,
       'u' || CAST(event_id % 3 AS STRING) AS new_user
FROM events WHERE event_type = 'signup'
"""

# Yes/no answers of a model to "is the bot addressed?", one per channel and check.
VERDICTS_SQL = """
SELECT user_id AS channel_id, event_id,
       CASE WHEN event_type IN ('click', 'error') THEN ' Yes.' WHEN event_type = 'view' THEN 'No'
            ELSE 'nope' END AS answer
FROM events
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one in too few splits to use the cores is dealt out to them first.

    Only a small table can be in few splits, so a large one is never shuffled here.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def run_sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """Run ``sql`` over the folder's tables, under view names that no user's view has."""
    for name in tables:
        load(spark, sf_dir, name).createOrReplaceTempView(f"threadloom_{name}")
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 threadloom_{name}", sql)
    return spark.sql(sql)


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = run_sql(spark, sf_dir, MESSAGES_SQL, "conversations", "customer")
    return df.withColumn("ts", F.timestamp_seconds("ts_s")).withColumn(
        "mentioned_ids",
        F.when(F.col("mention_id").isNull(), F.array().cast("array<bigint>")).otherwise(
            F.array("mention_id")
        ),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, USERS_SQL, "customer")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, CHANNELS_SQL, "conversations")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, LOGS_SQL, "events")


def member_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = run_sql(spark, sf_dir, MEMBER_UPDATES_SQL, "events")

    def names(prefix: str):
        return F.struct(
            F.col(f"{prefix}_display").alias("display_name"),
            F.col(f"{prefix}_nick").alias("nickname"),
            F.col(f"{prefix}_user").alias("username"),
        )

    return flat.select("seq", "member_id", names("old").alias("before"), names("new").alias("after"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, VERDICTS_SQL, "events")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model responses in five shapes, one per message."""
    text = F.to_json(F.struct(F.col("content").alias("t")))
    quoted = F.substring(text, F.lit(6), F.length(text) - 6)
    shape = (F.col("conv_id") + F.col("turn")) % 5
    body = (
        F.when(shape == 0, F.concat(F.lit('{"choices":[{"text":'), quoted, F.lit("}]}")))
        .when(
            shape == 1,
            F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":'), quoted, F.lit("}]}}]}")),
        )
        .when(shape == 2, '{"promptFeedback":{"blockReason":"SAFETY"}}')
        .when(shape == 3, '{"error":{"code":429}}')
        .otherwise("")
    )
    return chat_messages(spark, sf_dir).select(F.col("msg_id").alias("request_id"), body.alias("body"))


def tokens(spark: SparkSession, sf_dir: str, picture: bool = False) -> DataFrame:
    """Token messages: the prompt's header first, then one word of the reply each."""
    head = ["noise ", "### ", "Response:"] + ([] if picture else ["\\n[Bot]", ":"])
    words = F.split(F.replace("content", F.lit("\n"), F.lit("\\n")), " ")
    pieces = F.concat(
        F.array(*[F.lit(h) for h in head]), F.transform(words, lambda w: F.concat(w, F.lit(" ")))
    )
    rows = chat_messages(spark, sf_dir).select(
        F.col("msg_id").alias("request_id"), F.posexplode(pieces).alias("seq", "word")
    )
    raw = F.concat(F.lit('{"response":"'), F.col("word"), F.lit('","done":"0"}'))
    return rows.select("request_id", F.col("seq").cast("bigint").alias("seq"), raw.alias("raw"))
