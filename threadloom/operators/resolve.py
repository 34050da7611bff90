"""Names for ids: authors, mentions and replied-to messages; recent messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.functions.text import clean_username, distinct_tags


def resolve_author(messages: DataFrame, users: DataFrame, missing: Column) -> DataFrame:
    """Add ``author_name``: display name, else nickname, else username.

    ``missing`` is the name of an author that is not in the table.  Spark picks
    the join: a small table is broadcast, a skewed author is split.
    """
    known = users.select(
        F.col("user_id").alias("author_id"),
        F.coalesce("display_name", "nickname", "username").alias("_name"),
        F.lit(True).alias("_known"),
    )
    name = F.when(F.col("_known"), F.col("_name")).otherwise(missing)
    return messages.join(known, "author_id", "left").withColumn("author_name", name).drop("_name", "_known")


def resolve_mentions(
    df: DataFrame,
    users: DataFrame,
    channels: DataFrame,
    text: str,
    row_id: str,
    out: str | None = None,
    stop_on_unknown: bool = True,
) -> DataFrame:
    """Replace mention tags by nickname or username, channel tags by ``#name``.

    With ``stop_on_unknown`` the first tag that cannot be resolved ends the
    replacing.  The rows are read once: tags leave their row to be looked up, and the
    labels meet again by row id and text, so that rows of one id keep their own.
    """
    out = out or text
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # The row itself goes beside its tags, at a key of its own that no label has: so a
    # hot tag gathers short tags only, and several labels of one tag don't repeat a row.
    tags = F.coalesce(distinct_tags(F.col(text)), F.array().cast("array<string>"))
    each = df.select(
        F.col(row_id).alias("_row_id"),
        F.xxhash64(F.col(text)).alias("_of_text"),
        row.alias("_row"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")), tags)).alias("_tag"),
    ).select(
        "_row_id",
        "_of_text",
        F.when(F.col("_tag").isNull(), F.col("_row")).alias("_row"),
        "_tag",
        F.coalesce(F.contains("_tag", F.lit("@")), F.lit(False)).alias("_is_user"),
        F.coalesce(F.regexp_extract("_tag", r"\d+", 0).try_cast("bigint"), -1 - F.pmod(F.xxhash64("_row_id", "_of_text"), F.lit(1 << 40))).alias("_id"),
    )
    people = users.select(
        F.lit(True).alias("_is_user"),
        F.col("user_id").alias("_id"),
        F.when(F.length("nickname") > 0, F.col("nickname")).otherwise(F.col("username")).alias("_label"),
    )
    rooms = channels.select(
        F.lit(False).alias("_is_user"),
        F.col("channel_id").alias("_id"),
        F.concat(F.lit("#"), F.col("name")).alias("_label"),
    )
    gathered = (
        each.join(people.unionByName(rooms), ["_is_user", "_id"], "left")
        .groupBy("_row_id", "_of_text")
        .agg(
            F.collect_list("_row").alias("_rows"),
            F.collect_set(F.when(F.col("_label").isNotNull(), F.struct("_tag", "_label"))).alias("_labels"),
        )
    )
    # Of several labels of one tag the first in order holds, as a map has one.
    one_each = F.map_from_entries(
        F.filter(F.sort_array("_labels"), lambda x, i: (i == 0) | (F.get(F.sort_array("_labels"), F.greatest(i - 1, F.lit(0)))["_tag"] != x["_tag"]))
    )
    rows = gathered.select(F.inline("_rows"), F.when(F.size("_labels") > 0, one_each).alias("_names"))
    named = F.transform(distinct_tags(F.col(text)), lambda t: F.struct(t.alias("tag"), F.col("_names")[t].alias("label")))
    stop = F.array_position(F.transform(named, lambda x: x["label"].isNull()), True)
    usable = F.when(stop > 0, F.slice(named, F.lit(1), (stop - 1).cast("int"))).otherwise(named) if stop_on_unknown else named
    known = F.filter(usable, lambda x: x["label"].isNotNull())
    resolved = F.aggregate(known, F.col(text), lambda s, x: F.replace(s, x["tag"], x["label"]))
    return rows.withColumn(out, F.when(F.col("_names").isNotNull(), resolved).otherwise(F.col(text))).drop("_names")


def thread_context(messages: DataFrame, users: DataFrame, conf: ChatConfig, quote_limit: int | None = None) -> DataFrame:
    """Add ``quote_line``: ``[name]: text`` of the replied-to message, null when there is none.

    Rows that are no reply do not take part in the join, so they cannot pile up
    on the null key.
    """
    ref = F.col("ref_msg_id")
    plain = messages.where(ref.isNull()).withColumn("quote_line", F.lit(None).cast("string"))
    replies = messages.where(ref.isNotNull())
    quoted = messages.select(
        F.col("msg_id").alias("ref_msg_id"),
        F.col("author_id").alias("_ref_author"),
        F.col("content").alias("_ref_text"),
    )
    people = users.select(F.col("user_id").alias("_ref_author"), F.col("username").alias("_ref_name"))
    name = F.when(F.col("_ref_author") == conf.bot_id, F.lit(conf.bot_name)).otherwise(
        clean_username(F.coalesce("_ref_name", F.lit("")), fallback=False)
    )
    text = F.col("_ref_text") if quote_limit is None else F.left("_ref_text", F.lit(quote_limit))
    line = F.when(F.col("_ref_text").isNotNull(), F.concat(F.lit("["), name, F.lit("]: "), text))
    joined = replies.join(quoted, "ref_msg_id", "left").join(people, "_ref_author", "left")
    done = joined.withColumn("quote_line", line).drop("_ref_author", "_ref_text", "_ref_name")
    return plain.unionByName(done)


def thread_lines(lines: Column, quote_line: Column, current: Column, drop_last: int = 1) -> Column:
    """Context lines with the quoted message just before the current one.

    ``lines`` is an array; its last ``drop_last`` entries give way to the quote
    and the current line.  Without a quote the lines stay as they are.
    """
    kept = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - drop_last, F.lit(0)))
    threaded = F.concat(
        F.array_join(kept, "\n"), F.lit("\n"), quote_line, F.lit("\n"), current, F.lit("\n")
    )
    return F.when(quote_line.isNotNull(), threaded).otherwise(F.array_join(lines, "\n"))


def newest_k_per_channel(df: DataFrame, k: int = 10, channel: str = "channel_id") -> DataFrame:
    """The k newest messages per channel with ``rank`` 1 for the newest.

    Spark keeps k rows per channel in every task before it shuffles.
    """
    newest = Window.partitionBy(channel).orderBy(F.desc("ts"), F.desc("msg_id"))
    return df.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= k)


def exclude_current(history: DataFrame, current: DataFrame) -> DataFrame:
    """History without the messages that triggered the run, and without null rows."""
    return history.where(F.col("msg_id").isNotNull()).join(current.select("msg_id"), "msg_id", "left_anti")


def backfill_recent(messages: DataFrame, triggers: DataFrame, k: int = 10) -> DataFrame:
    """The newest k messages of the triggers' channels, less the triggers themselves.

    The k are counted with the trigger among them, as a chat service returns them.
    """
    scoped = messages.join(triggers.select("channel_id").distinct(), "channel_id", "left_semi")
    return exclude_current(newest_k_per_channel(scoped, k), triggers)


def backfill_union_live(backfill: DataFrame, live: DataFrame) -> DataFrame:
    """Backfill and live messages in one table; ``is_live`` orders them."""
    return backfill.withColumn("is_live", F.lit(False)).unionByName(
        live.withColumn("is_live", F.lit(True)), allowMissingColumns=True
    )


def chronological(df: DataFrame) -> DataFrame:
    """Oldest first, over the whole table (a range-partitioned sort)."""
    return df.orderBy("ts", "msg_id")


def first_attachment(attachments: Column) -> Column:
    return F.try_element_at(attachments, F.lit(1))
