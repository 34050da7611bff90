"""Replies put together from token messages (batch form).

A request listens once the response header has been seen, and is finished by an
end marker or by its length.  Tokens are joined per (request, block of sequence
numbers), so that a request of any size is spread over tasks; just the blocks
that the reply touches are then brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.jsonio import extract_token
from threadloom.functions.text import has_end_marker, remove_end_markers, unescape
from threadloom.operators.ordered import materialize


def clean_reply(text: Column, bot_name: str) -> Column:
    return unescape(remove_end_markers(text, bot_name))


def assemble_tokens(
    tokens: DataFrame, header: str, limit: int = 500, bot_name: str = "Bot", block_rows: int = 2048
) -> DataFrame:
    """One row per request: the finished reply (null while unfinished) and its status.

    Tokens up to the one that completes the header are prompt echo.  What comes
    after the finish is discarded.
    """
    rows = tokens.select("request_id", "seq", extract_token(F.col("raw")).alias("token")).withColumn(
        "block", F.call_function("div", F.col("seq"), F.lit(block_rows))
    )
    heard_rows = F.collect_list(F.when(F.length("token") > 0, F.struct("seq", "token")))
    joined = rows.groupBy("request_id", "block").agg(F.array_sort(heard_rows).alias("tokens"))
    # Three branches read the blocks, each of them other columns.
    every_block = materialize(
        joined.withColumn("text", F.array_join(F.transform("tokens", lambda t: t["token"]), ""))
    )
    blocks = every_block.where(F.size("tokens") > 0)
    # Enough of the text before each block to find a header that straddles blocks;
    # every block has a character, so this many blocks suffice.
    reach = len(header) - 1
    before = Window.partitionBy("request_id").orderBy("block").rowsBetween(-reach, -1)
    tails = F.collect_list(F.right("text", F.lit(reach))).over(before)
    lead = F.right(F.array_join("_tails", ""), F.lit(reach))
    # The window is over blocks, not tokens, and carries short texts only.
    seen = (
        blocks.select("request_id", "block", "text")
        .withColumn("_tails", tails)
        .withColumn("_lead", lead)
        .withColumn("_at", F.instr(F.concat("_lead", "text"), header))
        .where("_at > 0")
        .withColumn("_end", F.col("_at") + (len(header) - 1) - F.length("_lead"))
        .groupBy("request_id")
        .agg(F.min(F.struct("block", "_end")).alias("_h"))
        .select("request_id", F.col("_h.block").alias("_block"), F.col("_h._end").alias("_end"))
    )
    listening = blocks.join(seen, "request_id").where(F.col("block") >= F.col("_block"))

    # In the header's block, skip the tokens that start before the header's end.
    def skip(acc: Column, t: Column) -> Column:
        after = acc["n"] >= F.col("_end")
        return F.struct(
            (acc["n"] + F.length(t["token"])).alias("n"),
            F.when(after, F.array_append(acc["kept"], t["token"])).otherwise(acc["kept"]).alias("kept"),
        )

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))
    own = F.aggregate("tokens", start, skip)["kept"]
    words = F.when(F.col("block") == F.col("_block"), own).otherwise(
        F.transform("tokens", lambda t: t["token"])
    )
    heard = listening.select("request_id", "block", words.alias("words")).withColumn(
        "_len", F.length(remove_end_markers(F.array_join("words", ""), bot_name))
    )
    # Blocks that start after the reply must have ended are not needed.  End
    # markers do not count: a reply of nothing else goes on.
    running = Window.partitionBy("request_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    needed = heard.withColumn("_before", F.coalesce(F.sum("_len").over(running), F.lit(0))).where(
        F.col("_before") <= limit
    )
    whole = needed.groupBy("request_id").agg(
        F.flatten(
            F.transform(F.array_sort(F.collect_list(F.struct("block", "words"))), lambda b: b["words"])
        ).alias("words")
    )

    # A text without an end marker has none at any earlier point either, so most
    # replies are followed by length alone.  The flag rides along in the state;
    # as a column it would be worked out again for every token.
    def listen(acc: Column, token: Column) -> Column:
        text = F.concat(acc["text"], token)
        ended = (F.length(text) > limit) | (acc["marked"] & has_end_marker(text, bot_name))
        done = ended & (F.length(text) > 2) & (F.length(clean_reply(text, bot_name)) > 0)
        grown = F.struct(text.alias("text"), done.alias("done"), acc["marked"].alias("marked"))
        return F.when(acc["done"], acc).otherwise(grown)

    marked = has_end_marker(F.array_join("words", ""), bot_name)
    silent = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"), marked.alias("marked"))
    heard_all = whole.withColumn("_r", F.aggregate("words", silent, listen))
    reply = F.when(F.col("_r.done"), clean_reply(F.col("_r.text"), bot_name))
    replies = heard_all.select("request_id", reply.alias("reply"))
    requests = every_block.select("request_id").distinct()
    status = (
        F.when(F.col("reply").isNotNull(), "finished").when(F.col("_heard"), "listening").otherwise("no_header")
    )
    return (
        requests.join(replies.withColumn("_heard", F.lit(True)), "request_id", "left")
        .withColumn("status", status)
        .select("request_id", "status", "reply")
    )
