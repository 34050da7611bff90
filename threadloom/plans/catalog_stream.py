"""Named queries that run streams over whole tables until their input is used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadloom.operators import gate, ordered, waiting_room
from threadloom.plans import catalog_chains as chained
from threadloom.plans import catalog_chat as chat
from threadloom.plans import oracle_parts as o
from threadloom.plans.catalog_chains import dims
from threadloom.plans.catalog_text import messages
from threadloom.plans.oracle_parts import M, TEST
from threadloom.plans.registry import query
from threadloom.sources import derived, readers
from threadloom.streaming import operators as st
from threadloom.streaming import runs


class Scratch:
    """Fresh folders of one run, in the shared folder."""

    def __init__(self, spark):
        self.root = f"{ordered.shared_folder(spark)}/run-{uuid.uuid4().hex}"

    def __getattr__(self, name):
        return f"{self.root}/{name}"


def table_stream(spark, d, name):
    """A test table, file or folder, as a stream (a stream may read a file by pattern only)."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return readers.read_stream(spark, f"{d}/{name}.parquet*", schema)


def event_stream(spark, d):
    return chat.event_messages(table_stream(spark, d, "events"))


def until_the_end(spark, stream, path, **values):
    """``stream`` and a last row long after all others, by which the watermark passes them."""
    end = F.timestamp_seconds(F.lit(200 * 31_536_000)).alias("ts")
    last = spark.range(1).select(
        *[end if f.name == "ts" else F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema]
    )
    last.write.parquet(path)
    return stream.unionByName(readers.read_stream(spark, path, stream.schema))


def tick_table(spark, stream, run, width=gate.TICK):
    """The newest message per channel and tick, by way of a table, as a stream again."""
    whole = until_the_end(spark, stream, run.end)
    done = runs.to_table(st.latest_per_tick(whole, width=width), run.ticks, run.tick_checkpoint)
    return readers.read_stream(spark, run.ticks, done.schema)


def write_parts(parts, path, key):
    """Append the tables in turn, each dealt by ``key``: how many files the first has, for one micro-batch."""
    files = []
    for part in parts:
        part.repartition(key).write.mode("append").parquet(path)
        files = files or part.sparkSession.read.schema(part.schema).parquet(path).inputFiles()
    return max(len(files), 1)


@query(
    "s2_read_messages_stream",
    f"WITH {M} SELECT msg_id, channel_id, is_bot, content FROM m",
)
def s2(spark, d):
    run = Scratch(spark)
    rows = readers.conform(messages(spark, d), readers.MESSAGE_SCHEMA)
    rows.repartition("channel_id").write.parquet(run.messages)
    stream = readers.read_messages_stream(spark, run.messages, files_per_trigger=4)
    return runs.to_table(stream.select("msg_id", "channel_id", "is_bot", "content"), run.out, run.checkpoint)


@query(
    "s6_read_tokens_stream",
    f"""WITH {M}, w AS (SELECT msg_id AS request_id, ['noise ', '### ', 'Response:', {o.lit(chr(92) + "n[Bot]")}, ':'] ||
      list_transform(string_split(replace(content, chr(10), {o.lit(chr(92) + "n")}), ' '), lambda x: x || ' ') AS w FROM m)
    SELECT request_id, seq, '{{"response":"' || word || '","done":"0"}}' AS raw
    FROM (SELECT request_id, unnest(range(0, len(w))) AS seq, unnest(w) AS word FROM w)""",
)
def s6(spark, d):
    run = Scratch(spark)
    derived.tokens(spark, d).write.parquet(run.tokens)
    stream = readers.read_tokens_stream(spark, run.tokens).select("request_id", "seq", "raw")
    return runs.to_table(stream, run.out, run.checkpoint)


@query(
    "st1_stream_latest_per_tick",
    f"""WITH t AS (SELECT user_id AS channel_id, epoch_us(ts) // 1800000000 AS tick, arg_max(event_id, (ts, event_id))
      AS msg_id, count(*) AS n_messages FROM events GROUP BY 1, 2) SELECT * FROM t""",
)
def st1(spark, d):
    run = Scratch(spark)
    ticks = st.ticks_table(event_stream(spark, d), run.out, run.checkpoint, width="30 minutes")
    tick = F.call_function("div", F.unix_millis("tick_start"), F.lit(1800000))
    return ticks.select("channel_id", tick.alias("tick"), "msg_id", "n_messages")


@query(
    "st2_stream_backoff",
    f"""WITH t AS (SELECT user_id AS channel_id, epoch_us(ts) // 1800000000 AS tick,
      arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY 1, 2),
    p AS (SELECT channel_id, tick, kind IN ('purchase', 'click') AS positive, row_number() OVER
      (PARTITION BY channel_id ORDER BY tick) AS k FROM t),
    s AS (SELECT *, k - coalesce(max(CASE WHEN positive THEN k END) OVER (PARTITION BY channel_id ORDER BY tick), 0)
      AS streak FROM p)
    SELECT channel_id, tick, positive, streak, CASE WHEN streak <= 3 THEN streak ELSE 0 END AS wait FROM s""",
)
def st2(spark, d):
    run = Scratch(spark)
    ticks = tick_table(spark, event_stream(spark, d), run, "30 minutes")
    tick = F.call_function("div", F.unix_millis("tick_start"), F.lit(1800000))
    answer = F.when(F.col("content").isin("purchase", "click"), "Yes").otherwise("No")
    checks = ticks.select("channel_id", tick.alias("pos"), answer.alias("answer"))
    return runs.to_table(st.backoff(checks), run.out, run.checkpoint).withColumnRenamed("pos", "tick")


@query(
    "st3_stream_cooldown",
    f"""WITH RECURSIVE t AS (SELECT user_id % 3 AS channel_id, epoch_us(ts) // 5500000 AS tick
      FROM events GROUP BY 1, 2),
    a AS (SELECT channel_id, min(tick) AS tick FROM t GROUP BY channel_id
      UNION ALL SELECT * FROM (SELECT a.channel_id, (SELECT min(t.tick) FROM t WHERE t.channel_id = a.channel_id
        AND t.tick >= a.tick + 40) AS tick FROM a) WHERE tick IS NOT NULL)
    SELECT t.channel_id, t.tick, a.tick IS NOT NULL AS accepted
    FROM t LEFT JOIN a ON a.channel_id = t.channel_id AND a.tick = t.tick""",
)
def st3(spark, d):
    run = Scratch(spark)
    events = event_stream(spark, d).withColumn("channel_id", F.col("channel_id") % 3)
    ticks = tick_table(spark, events, run).select("channel_id", gate.tick_of(F.col("tick_start")).alias("tick"))
    return runs.to_table(st.cooldown(ticks, 40), run.out, run.checkpoint)


@query(
    "st4_stream_assemble_tokens",
    f"WITH {M}, {chat._WORDS_SO_FAR.replace('LIMIT_', '500')} SELECT request_id, 'finished' AS status, reply FROM r",
)
def st4(spark, d):
    run = Scratch(spark)
    tokens = derived.tokens(spark, d)
    halves = tokens.where(F.col("seq") < 12), tokens.where(F.col("seq") >= 12)  # replies span micro-batches
    files = write_parts(halves, run.tokens, "request_id")
    stream = readers.read_tokens_stream(spark, run.tokens, files_per_trigger=files)
    replies = st.assemble_tokens(stream.select("request_id", "seq", "raw"), TEST.reply_header, TEST)
    return runs.to_table(replies, run.out, run.checkpoint)


@query(
    "st5_stream_backfill_then_live",
    f"""WITH {M}, live AS (SELECT * FROM m WHERE turn >= 3),
    h AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts_s DESC, msg_id DESC) AS rank FROM m
      WHERE turn < 3)
    SELECT msg_id, TRUE AS is_live FROM live UNION ALL
    SELECT msg_id, FALSE FROM h WHERE rank <= 2 AND channel_id IN (SELECT channel_id FROM live)""",
)
def st5(spark, d):
    run = Scratch(spark)
    columns = ["msg_id", "channel_id", "ts", "content", "turn"]
    m = messages(spark, d).select(columns)
    files = write_parts(map(m.where, ("turn = 3", "turn = 4", "turn > 4")), run.live, "msg_id")
    stream = readers.read_stream(spark, run.live, m.schema, files_per_trigger=files)
    both = st.backfill_then_live(stream, m.where("turn < 3"), run.out, run.checkpoint, 2)
    return both.select("msg_id", "is_live")


@query(
    "st6_stream_toggle_state",
    """WITH k AS (SELECT user_id % 2 AS channel_id, event_id AS pos, event_type = 'signup' AS command FROM events
      WHERE user_id % 7 = 0 AND event_type IN ('signup', 'error'))
    SELECT channel_id, pos, command, command IS DISTINCT FROM lag(command) OVER (PARTITION BY channel_id ORDER BY pos)
      AS swallowed FROM k""",
)
def st6(spark, d):
    run = Scratch(spark)
    kind = F.col("event_type")
    said = F.when(kind == "signup", "Enable Gemini").when(kind == "error", "disable gemini").otherwise(kind)
    stream = table_stream(spark, d, "events").select(
        (F.col("user_id") % 2).alias("channel_id"), F.col("event_id").alias("pos"), said.alias("content"),
        F.when(F.col("user_id") % 7 == 0, 1).otherwise(2).alias("author_id"),
    )
    return runs.to_table(st.toggle_state(stream, 1), run.out, run.checkpoint)


@query("st7_stream_member_names", chat._NAMES + " SELECT member_id, arg_max(name, seq) AS name FROM c "
       "WHERE name IS NOT NULL GROUP BY member_id")
def st7(spark, d):
    run = Scratch(spark)
    updates = derived.member_updates(spark, d)
    updates.write.parquet(run.updates)
    stream = readers.read_stream(spark, run.updates, updates.schema)
    return st.member_names_table(stream, run.out, run.checkpoint)


@query(
    "st8_stream_transcript",
    f"""WITH {o.L} SELECT conv_id, turn, right(string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn)
      || chr(10), 900) AS tail FROM l""",
)
def st8(spark, d):
    run = Scratch(spark)
    rows = chat.lines(spark, d).select("conv_id", "turn", "line")
    files = write_parts(map(rows.where, ("turn < 2", "turn BETWEEN 2 AND 4", "turn > 4")), run.lines, "conv_id")
    stream = readers.read_stream(spark, run.lines, rows.schema, files_per_trigger=files)
    return runs.to_table(st.running_transcript(stream, 900), run.out, run.checkpoint)


@query(
    "p6_stream_reply_gate",
    f"WITH RECURSIVE {chained.GATE} SELECT channel_id, o_id AS msg_id, o_at AS \"at\", o_action AS reason FROM s WHERE o_id IS NOT NULL",
)
def p6_stream(spark, d):
    """The gate over three micro-batches that cut each conversation; clock rows end the stream.

    All conversations are replayed side by side, hours apart by their own clocks, so that the
    watermark stays behind them all until the last row.
    """
    run = Scratch(spark)
    m = messages(spark, d).withColumn("answer", F.col("content"))
    rows = waiting_room.events(m, TEST)
    second = F.unix_timestamp("ts") % 3600  # a conversation starts on the hour
    parts = [second < 60, (second >= 60) & (second < 120), second >= 120]
    files = write_parts([rows.where(p) for p in parts], run.events, "channel_id")
    for years in (200, 201):  # what is due at the first comes out with the second
        clock = rows.limit(0).unionByName(
            spark.range(1).select(
                F.lit(-1).cast("long").alias("channel_id"), F.lit(years * 31_536_000_000).alias("at"), F.lit(waiting_room.CLOCK).alias("kind"),
                *[F.lit(None).cast(t).alias(c) for c, t in (("msg_id", "long"), ("direct", "boolean"), ("yes", "boolean"))],
                F.timestamp_seconds(F.lit(years * 31_536_000)).alias("ts"),
            )
        )
        clock.write.mode("append").parquet(run.events)
    stream = readers.read_stream(spark, run.events, rows.schema, files_per_trigger=files)
    found = runs.to_table(st.reply_gate(stream, TEST, "1200 months"), run.out, run.checkpoint)
    return found.where("action <> 'asked'").select("channel_id", "msg_id", "at", F.col("action").alias("reason"))


@query("st9_stream_moderate", f"WITH {chained.SANITIZED} SELECT msg_id, line FROM z")
def st9(spark, d):
    run = Scratch(spark)
    columns = ["msg_id", "author_id", "content", "n_attachments"]
    rows = messages(spark, d).select(columns)
    rows.write.parquet(run.messages)
    stream = readers.read_stream(spark, run.messages, rows.schema)
    return st.moderate(stream, *dims(spark, d), TEST, run.out, run.checkpoint).select("msg_id", "line")


@query("st10_stream_dedup_current", "SELECT event_id AS msg_id, event_type AS content FROM events")
def st10(spark, d):
    run = Scratch(spark)
    both = event_stream(spark, d).unionByName(event_stream(spark, d))
    return runs.to_table(st.dedup(both).select("msg_id", "content"), run.out, run.checkpoint)


@query(
    "st11_stream_typing_timeout",
    f"""WITH {M}, w AS (SELECT msg_id AS request_id, unnest(string_split(content, ' ')) || ' ' AS token,
      unnest(range(0, len(string_split(content, ' ')))) AS i FROM m),
    u AS (SELECT request_id, i, string_agg(token, '') OVER (PARTITION BY request_id ORDER BY i) AS text FROM w),
    f AS (SELECT request_id, i, {o.sub('text', o.END, '', 'gi')} AS reply FROM u WHERE length(text) > 2
      AND (length(text) > 500 OR regexp_matches(text, {o.lit('(?i)' + o.END)})) OR (i + 5) * 1000 > 38500),
    r AS (SELECT request_id, arg_min(reply, i) AS reply FROM f WHERE length(reply) > 0 GROUP BY request_id)
    SELECT request_id, 'finished' AS status, reply FROM r
    UNION ALL SELECT request_id, 'timed_out', {o.sub('arg_max(text, i)', o.END, '', 'gi')} FROM u
    WHERE request_id NOT IN (SELECT request_id FROM r) GROUP BY request_id""",
)
def st11(spark, d):
    """One token a second: a reply of more than seven ticks is ended, one that stays short given up."""
    run = Scratch(spark)
    tokens = derived.tokens(spark, d).withColumn("ts", F.timestamp_seconds(F.col("seq") + 1704067200))
    write_parts([tokens], run.tokens, "request_id")
    stream = readers.read_tokens_stream(spark, run.tokens)
    whole = until_the_end(spark, stream, run.end, request_id=-1, seq=0, raw='{"response":"x","done":"0"}')
    return runs.to_table(st.assemble_tokens(whole, TEST.reply_header, TEST), run.out, run.checkpoint)
