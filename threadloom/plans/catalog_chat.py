"""Named queries: sources, joins, aggregates and windows over whole message tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import jsonio
from threadloom.functions import text as tx
from threadloom.operators import gate, loops, moderation, ordered, resolve, tokens, transcript
from threadloom.plans import oracle_parts as o
from threadloom.plans.catalog_text import image_bodies, lines, messages
from threadloom.plans.oracle_parts import L, M, TEST, lit
from threadloom.plans.registry import query
from threadloom.sources import derived, readers, sinks

BLOCKS = 4  # rows per block: small, so that conversations of the test tables span several

# --- sources and sinks ------------------------------------------------------------------


@query(
    "s1_read_messages",
    f"WITH {M} SELECT msg_id, channel_id, conv_id, turn, author_id, is_bot, content, ref_msg_id FROM m",
)
def s1(spark, d):
    path = f"{ordered.shared_folder(spark)}/messages-{ordered.uuid.uuid4().hex}"
    messages(spark, d).select(
        "msg_id", "channel_id", "conv_id", "turn", "ts", "author_id", "is_bot", "content", "ref_msg_id", "mentioned_ids"
    ).write.json(path)
    return readers.read_messages(spark, path, "json").select(
        "msg_id", "channel_id", "conv_id", "turn", "author_id", "is_bot", "content", "ref_msg_id"
    )


def triggers(spark, d):
    """The newest message of every channel sets off the backfill."""
    return resolve.newest_k_per_channel(messages(spark, d), 1).drop("rank")


_RANKED = f"""{M}, r AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY ts_s DESC, msg_id DESC) AS rank
  FROM m)"""


@query(
    "s3_backfill_recent",
    f"WITH {_RANKED} SELECT channel_id, msg_id, rank FROM r WHERE rank BETWEEN 2 AND 4",
)
def s3(spark, d):
    return resolve.backfill_recent(messages(spark, d), triggers(spark, d), 4).select("channel_id", "msg_id", "rank")


@query(
    "s4_read_dims",
    f"WITH {o.USERS}, {o.CHANNELS} SELECT 'user' AS kind, user_id AS id, username AS name FROM users "
    "UNION ALL SELECT 'channel', channel_id, name FROM channels",
)
def s4(spark, d):
    path = f"{ordered.shared_folder(spark)}/dims-{ordered.uuid.uuid4().hex}"
    derived.users(spark, d).write.parquet(f"{path}/users")
    derived.channels(spark, d).write.parquet(f"{path}/channels")
    users, rooms = readers.read_dims(spark, f"{path}/users", f"{path}/channels")
    users = users.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.col("username").alias("name"))
    rooms = rooms.select(F.lit("channel").alias("kind"), F.col("channel_id").alias("id"), "name")
    return users.unionByName(rooms)


@query(
    "s5_read_responses",
    f"""WITH {M}, b AS (SELECT msg_id AS request_id, (conv_id + turn) % 5 AS shape, content FROM m)
    SELECT request_id, shape = 4 AS is_empty, CASE WHEN shape < 2 THEN content END AS said,
      CASE WHEN shape IN (2, 3) THEN length(CASE shape WHEN 2 THEN '{{"promptFeedback":{{"blockReason":"SAFETY"}}}}' ELSE '{{"error":{{"code":429}}}}' END)
      END AS n_chars FROM b""",
)
def s5(spark, d):
    path = f"{ordered.shared_folder(spark)}/responses-{ordered.uuid.uuid4().hex}"
    derived.responses(spark, d).write.json(path)
    text = F.coalesce(F.get_json_object("body", "$.choices[0].text"), F.get_json_object("body", "$.candidates[0].content.parts[0].text"))
    return readers.read_responses(spark, path).select(
        "request_id", (F.col("body") == "").alias("is_empty"), text.alias("said"),
        F.when(text.isNull() & (F.col("body") != ""), F.length("body")).alias("n_chars"),
    )


@query(
    "s7_decode_images",
    f"""WITH {M}, i AS (SELECT msg_id AS request_id, 0 AS image_no, content AS x, turn FROM m
      UNION ALL SELECT msg_id, 1, role, turn FROM m)
    SELECT request_id, image_no, octet_length(encode(x)) AS n_bytes, md5(x) AS digest,
      CASE WHEN turn % 2 = 0 THEN 'cutepic.png' ELSE 'pic.png' END AS file_name FROM i""",
)
def s7(spark, d):
    bodies = image_bodies(spark, d).withColumn("images", jsonio.image_list(F.col("body"))).drop("body")
    return sinks.image_rows(bodies).select(
        "request_id", "image_no", F.octet_length("content").alias("n_bytes"), F.md5("content").alias("digest"), "file_name"
    )


@query("s8_encode_images", f"WITH {M} SELECT msg_id, to_base64(encode(content)) AS image FROM m")
def s8(spark, d):
    return messages(spark, d).select(
        "msg_id", jsonio.encode_image(F.encode("content", "UTF-8")).alias("image")
    )


@query(
    "s9_write_replies",
    f"WITH {M} SELECT msg_id AS source_msg_id, {o.cut('content')} AS reply FROM m WHERE is_bot",
)
def s9(spark, d):
    path = f"{ordered.shared_folder(spark)}/replies-{ordered.uuid.uuid4().hex}"
    replies = messages(spark, d).where("is_bot").select(
        F.col("msg_id").alias("source_msg_id"), tx.cut_at_end_marker(F.col("content")).alias("reply")
    )
    sinks.write_replies(replies, path)
    return spark.read.parquet(path)


@query(
    "s10_write_requests",
    f"WITH {M} SELECT md5(content) AS prompt, count(*) AS documents, 280 * count(*) AS tokens FROM m GROUP BY 1",
)
def s10(spark, d):
    path = f"{ordered.shared_folder(spark)}/requests-{ordered.uuid.uuid4().hex}"
    requests = messages(spark, d).select(jsonio.completion_request(F.col("content"), 280).alias("request"))
    sinks.write_requests(requests, path)
    field = lambda name: F.get_json_object("value", f"$.{name}")
    written = spark.read.text(path).select(F.md5(field("prompt")).alias("prompt"), field("max_tokens").cast("long").alias("n"))
    return written.groupBy("prompt").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"))


@query(
    "s12_image_result_sink",
    f"""WITH {M}, i AS (SELECT turn % 2 = 0 AS selfie, content AS x FROM m UNION ALL SELECT turn % 2 = 0, role FROM m)
    SELECT selfie, md5(x) AS digest, count(*) AS n, sum(octet_length(encode(x))) AS n_bytes FROM i GROUP BY 1, 2""",
)
def s12(spark, d):
    path = f"{ordered.shared_folder(spark)}/images-{ordered.uuid.uuid4().hex}"
    bodies = image_bodies(spark, d).withColumn("images", jsonio.image_list(F.col("body"))).drop("body")
    sinks.write_images(sinks.image_rows(bodies), path)
    stored = spark.read.parquet(path)
    return stored.groupBy(F.col("selfie").cast("boolean").alias("selfie"), F.md5("content").alias("digest")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("content")).alias("n_bytes")
    )


# --- filters --------------------------------------------------------------------------------


@query("f1_drop_self", f"WITH {M} SELECT msg_id FROM m WHERE author_id <> {TEST.bot_id}")
def f1(spark, d):
    return gate.drop_self(messages(spark, d), TEST.bot_id).select("msg_id")


@query("f2_drop_bots_from_reply_path", f"WITH {M} SELECT msg_id, NOT is_bot AS answerable FROM m")
def f2(spark, d):
    return gate.with_answerable(messages(spark, d)).select("msg_id", "answerable")


@query(
    "f3_direct_mention",
    f"WITH {M} SELECT msg_id, coalesce(mention_id = {TEST.bot_id}, FALSE) AND length(content) > 22 AS direct FROM m",
)
def f3(spark, d):
    flag = gate.direct_mention(F.col("mentioned_ids"), F.col("content"), TEST.bot_id)
    return messages(spark, d).select("msg_id", flag.alias("direct"))


# Owner commands: some event types stand for the two commands, one user for the owner.
_COMMANDS = """c AS (SELECT event_id, user_id % 2 AS channel_id,
    row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) - 1 AS pos,
    CASE event_type WHEN 'signup' THEN 'Enable Gemini' WHEN 'error' THEN 'disable gemini' ELSE event_type END AS content,
    CASE WHEN user_id % 7 = 0 THEN 1 ELSE 2 END AS author_id FROM events)"""


def commands(spark, d):
    events = derived.load(spark, d, "events")
    said = (
        F.when(F.col("event_type") == "signup", "Enable Gemini")
        .when(F.col("event_type") == "error", "disable gemini")
        .otherwise(F.col("event_type"))
    )
    rows = events.select(
        "event_id",
        (F.col("user_id") % 2).alias("channel_id"),
        said.alias("content"),
        F.when(F.col("user_id") % 7 == 0, 1).otherwise(2).alias("author_id"),
    )
    return ordered.number_rows(rows, "channel_id", ["event_id"], F.call_function("div", F.col("event_id"), F.lit(1000)))


_TOGGLED = f"""WITH {_COMMANDS}, k AS (SELECT *, CASE WHEN author_id = 1 AND lower(content) = 'enable gemini' THEN TRUE
      WHEN author_id = 1 AND lower(content) = 'disable gemini' THEN FALSE END AS command FROM c),
    p AS (SELECT *, last_value(command IGNORE NULLS) OVER (PARTITION BY channel_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)"""


def toggled(spark, d):
    command = gate.owner_command(F.col("content"), F.col("author_id"), 1)
    return gate.toggle_state(commands(spark, d), "channel_id", "pos", command, 1000)


@query(
    "f4_owner_command",
    f"{_TOGGLED} SELECT event_id, command IS NOT NULL AND command IS DISTINCT FROM before AS swallowed FROM p",
)
def f4(spark, d):
    return toggled(spark, d).select("event_id", "swallowed")


@query(
    "st6_toggle_state_batch",
    f"{_TOGGLED} SELECT event_id, pos, coalesce(before, FALSE) AS mode_before, coalesce(command, before, FALSE) "
    "AS mode_after FROM p",
)
def st6_batch(spark, d):
    return toggled(spark, d).select("event_id", "pos", "mode_before", "mode_after")


_LISTED = " OR ".join(f"contains(message, {lit(w)})" for w in TEST.log_blacklist)
_LOGS = f"""WITH logs AS ({derived.LOGS_SQL}), t AS (SELECT log_id, source,
    CASE WHEN message IS NOT NULL AND NOT ({_LISTED}) THEN message ELSE exception END AS text FROM logs)"""


@query("f6_log_filter", f"{_LOGS} SELECT log_id, source, text FROM t WHERE text IS NOT NULL")
def f6(spark, d):
    return gate.log_filter(derived.logs(spark, d)).select("log_id", "source", "text")


@query(
    "s11_read_logs",
    f"WITH logs AS ({derived.LOGS_SQL}) SELECT source, count(message) AS messages, count(exception) AS exceptions "
    "FROM logs GROUP BY source",
)
def s11(spark, d):
    path = f"{ordered.shared_folder(spark)}/logs-{ordered.uuid.uuid4().hex}"
    derived.logs(spark, d).write.json(path)
    return readers.read_logs(spark, path).groupBy("source").agg(
        F.count("message").alias("messages"), F.count("exception").alias("exceptions")
    )


@query("f11_channel_scope", f"WITH {M} SELECT msg_id FROM m WHERE channel_id IN (200000000000003, 200000000000005)")
def f11(spark, d):
    return gate.channel_scope(messages(spark, d), [200000000000003, 200000000000005]).select("msg_id")


# --- joins ------------------------------------------------------------------------------------


@query(
    "j1_resolve_author",
    f"""WITH {M}, {o.USERS} SELECT msg_id, coalesce(display_name, nickname, username, role) AS author_name
    FROM m LEFT JOIN users ON user_id = author_id""",
)
def j1(spark, d):
    return resolve.resolve_author(messages(spark, d), derived.users(spark, d), F.col("role")).select("msg_id", "author_name")


_TAGS = f"""{M}, {o.USERS}, {o.CHANNELS},
t0 AS (SELECT msg_id, unnest(regexp_extract_all(content, '<[@#]\\d{{15,}}>')) AS tag,
       unnest(range(0, len(regexp_extract_all(content, '<[@#]\\d{{15,}}>')))) AS pos FROM m),
t1 AS (SELECT msg_id, tag, min(pos) AS pos FROM t0 GROUP BY ALL),
t2 AS (SELECT msg_id, tag, pos, CASE WHEN contains(tag, '@')
         THEN (SELECT CASE WHEN length(nickname) > 0 THEN nickname ELSE username END FROM users
               WHERE user_id = CAST(regexp_extract(tag, '\\d+', 0) AS BIGINT))
         ELSE (SELECT '#' || name FROM channels WHERE channel_id = CAST(regexp_extract(tag, '\\d+', 0) AS BIGINT)) END
         AS label FROM t1),
t3 AS (SELECT *, min(CASE WHEN label IS NULL THEN pos END) OVER (PARTITION BY msg_id) AS stop FROM t2)"""


def _replaced(condition: str, cte: str) -> str:
    """CTE with the tags replaced; a message holds up to two different tags here."""
    return f"""{cte} AS (SELECT m.msg_id, coalesce(list_reduce(list({{'t': tag, 'l': label}} ORDER BY pos)
        FILTER (WHERE {condition}), lambda s, r: replace(s, r['t'], r['l']), any_value(m.content)), any_value(m.content))
      AS text FROM m LEFT JOIN t3 USING (msg_id) GROUP BY m.msg_id)"""


_STOPPED = _replaced("label IS NOT NULL AND pos < coalesce(stop, 1000000)", "a")


@query(
    "j2_resolve_mentions",
    f"""WITH {_TAGS}, {_STOPPED}, {_replaced("label IS NOT NULL", "b")}
    SELECT msg_id, a.text AS stopped, b.text AS resolved FROM a JOIN b USING (msg_id)""",
)
def j2(spark, d):
    dims = derived.users(spark, d), derived.channels(spark, d)
    m = messages(spark, d).select("msg_id", "content")
    first = resolve.resolve_mentions(m, *dims, "content", "msg_id", "stopped")
    both = resolve.resolve_mentions(first, *dims, "content", "msg_id", "resolved", stop_on_unknown=False)
    return both.select("msg_id", "stopped", "resolved")


_RECENT9 = "list(line) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)"
_THREADS = f"""{L}, {o.USERS}, w AS (SELECT *, {_RECENT9} AS recent FROM l),
q AS (SELECT w.*, CASE WHEN x.content IS NOT NULL THEN '[' || CASE WHEN x.author_id = {TEST.bot_id} THEN 'Bot'
        ELSE {o.clean('u.username')} END || ']: ' || x.content END AS quote,
        x.content AS quoted FROM w LEFT JOIN m x ON x.msg_id = w.ref_msg_id LEFT JOIN users u ON u.user_id = x.author_id)"""


def _threaded(drop: int, current: str) -> str:
    keep = f"array_to_string(recent[:greatest(len(recent) - {drop}, 0)], chr(10))"
    return (
        f"CASE WHEN quote IS NULL THEN array_to_string(recent, chr(10)) ELSE {keep} || chr(10) || quote "
        f"|| chr(10) || {current} || chr(10) END"
    )


@query(
    "j3_thread_context",
    f"WITH {_THREADS} SELECT msg_id, quote AS quote_line, {_threaded(1, 'line')} AS check_context, "
    f"{_threaded(2, 'line')} AS reply_context FROM q",
)
def j3(spark, d):
    recent = transcript.last_n_lines(lines(spark, d), "conv_id", "turn", "line", 9, 16)
    threaded = resolve.thread_context(recent, derived.users(spark, d), TEST)
    quote, line = F.col("quote_line"), F.col("line")
    return threaded.select(
        "msg_id",
        "quote_line",
        resolve.thread_lines(F.col("recent"), quote, line, 1).alias("check_context"),
        resolve.thread_lines(F.col("recent"), quote, line, 2).alias("reply_context"),
    )


@query(
    "j4_fuzzy_banned_match",
    f"WITH {M}, {o.fuzzy('m', 'msg_id', 'content')} SELECT msg_id, pos, token, word FROM hits",
)
def j4(spark, d):
    return moderation.fuzzy_banned_match(messages(spark, d), "content", TEST.fuzzy_words, ["msg_id"])


@query(
    "j4_fuzzy_banned_match_large",
    f"WITH {M}, {o.fuzzy('m', 'msg_id', 'content')} SELECT msg_id, pos, token, word FROM hits",
)
def j4_large(spark, d):
    words = spark.createDataFrame([(w,) for w in TEST.fuzzy_words], "word string")
    return moderation.fuzzy_banned_match_large(messages(spark, d), "content", words, ["msg_id"])


@query(
    "j4_documents",
    f"WITH {o.fuzzy('documents', 'doc_id', 'text')} SELECT doc_id, pos, token, word FROM hits",
)
def j4_documents(spark, d):
    documents = derived.load(spark, d, "documents")
    return moderation.fuzzy_banned_match(documents, "text", TEST.fuzzy_words, ["doc_id"])


# Bytes in place of accented letters, so that the byte-wise distance is the right one.
_PLAIN = f"translate({{}}, {lit(o.ACCENTED)}, {' || '.join(f'chr({i})' for i in range(1, 9))} || {' || '.join(f'chr({i})' for i in range(14, 14 + len(o.ACCENTED) - 8))})"
_BARE = o.sub("{}", r"\s+")


def memory(table: str) -> str:
    """CTEs up to ``mem``: the lines of the last 500 characters before each turn."""
    return f"""mem0 AS (SELECT conv_id, turn, string_split(right(coalesce(string_agg(line || chr(10), '') OVER
    (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), 500), chr(10)) AS x FROM {table}),
mem AS (SELECT conv_id, turn, unnest(x) AS line, generate_subscripts(x, 1) AS line_no FROM mem0)"""


_NEAR = f"""{L}, {memory('l')}, s AS (SELECT x.conv_id, x.turn, x.content AS reply, y.line_no AS line_turn, y.line,
    {_BARE.format('x.content')} AS a, {_BARE.format('y.line')} AS b, length(x.content) // 3 AS lim
  FROM l x JOIN mem y ON x.conv_id = y.conv_id AND x.turn = y.turn AND y.line <> ''),
g AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0 WHEN abs(length(a) - length(b)) >= lim THEN NULL
    ELSE levenshtein({_PLAIN.format('a')}, {_PLAIN.format('b')}) END AS plain FROM s),
v AS (SELECT *, CASE WHEN plain IS NULL OR plain >= lim THEN FALSE WHEN plain * 2 < lim THEN TRUE
    ELSE {o.weighted('a', 'b')} < lim END AS near FROM g),
n AS (SELECT conv_id, turn, arg_min(line, line_turn) AS near_line FROM v WHERE near GROUP BY ALL)"""


@query(
    "j5_near_duplicate_reply",
    f"WITH {_NEAR} SELECT l.conv_id, l.turn, n.near_line FROM l LEFT JOIN n USING (conv_id, turn)",
)
def j5(spark, d):
    near = loops.near_duplicate_reply(lines(spark, d), "conv_id", "turn", "content", "line", 500, 16)
    return near.select("conv_id", "turn", "near_line")


@query(
    "j6_transcript_minus_line",
    f"""WITH {M}, r AS (SELECT conv_id, turn, unnest(string_split(content, chr(10))) AS line,
      unnest(range(0, len(string_split(content, chr(10))))) AS line_no FROM m),
    gone AS (SELECT DISTINCT conv_id, line FROM r WHERE turn = 0)
    SELECT conv_id, turn, line_no, line FROM r WHERE NOT EXISTS
      (SELECT 1 FROM gone WHERE gone.conv_id = r.conv_id AND gone.line = r.line)""",
)
def j6(spark, d):
    rows = transcript.line_rows(messages(spark, d), "conv_id", "turn", "content")
    return transcript.transcript_minus_lines(rows, rows.where("turn = 0"), "conv_id")


# --- aggregates -----------------------------------------------------------------------------


@query(
    "a1_build_transcript",
    f"""WITH {L} SELECT conv_id, turn // 3 AS segment, count(*) AS n_lines,
      string_agg(line, chr(10) ORDER BY turn) AS transcript FROM l GROUP BY ALL""",
)
def a1(spark, d):
    return transcript.build_transcript(lines(spark, d), "conv_id", "turn", "line", segment_rows=3)


@query(
    "a2_distinct_tags",
    f"""WITH {M}, t AS (SELECT msg_id, unnest(list_distinct(regexp_extract_all(content, '<[@#]\\d{{15,}}>'))) AS tag
      FROM m) SELECT tag, count(*) AS n FROM t GROUP BY tag""",
)
def a2(spark, d):
    tags = messages(spark, d).select(F.explode(tx.distinct_tags(F.col("content"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a3_detected_words",
    f"WITH {M}, {o.fuzzy('m', 'msg_id', 'content')} SELECT msg_id, coalesce(joined, '') AS words, "
    "length(coalesce(joined, '')) > 2 AS hit FROM m LEFT JOIN det USING (msg_id)",
)
def a3(spark, d):
    found = messages(spark, d).select(
        "msg_id", moderation.detected_words(moderation.fuzzy_matches(F.col("content"), TEST.fuzzy_words)).alias("words")
    )
    return found.select("msg_id", "words", (F.length("words") > 2).alias("hit"))


@query(
    "a4_latest_per_tick",
    """SELECT user_id AS channel_id, epoch_us(ts) // 1800000000 AS tick, arg_max(event_id, (ts, event_id)) AS msg_id,
      arg_max(event_type, (ts, event_id)) AS content, count(*) AS n_messages FROM events GROUP BY 1, 2""",
)
def a4(spark, d):
    latest = gate.latest_per_tick(event_messages(derived.load(spark, d, "events")), "30 minutes")
    tick = F.call_function("div", F.unix_millis("tick_start"), F.lit(1800000))
    return latest.select("channel_id", tick.alias("tick"), "msg_id", "content", "n_messages")


def event_messages(events):
    """Events as messages: a channel per user."""
    return events.select(
        F.col("user_id").alias("channel_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("msg_id"),
        F.col("event_type").alias("content"),
    )


@query(
    "a5_counters",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors,
      count(*) FILTER (WHERE event_type = 'click') AS messages_sent,
      count(*) FILTER (WHERE event_type = 'purchase') AS images_sent FROM events GROUP BY user_id""",
)
def a5(spark, d):
    kind = F.col("event_type")
    return loops.counters(
        derived.load(spark, d, "events"), "user_id",
        errors=kind == "error", messages_sent=kind == "click", images_sent=kind == "purchase",
    )


@query(
    "a6_moderation_report",
    f"""WITH {M}, {o.fuzzy('m', 'msg_id', 'content')} SELECT channel_id, word, count(*) AS hits,
      count(DISTINCT author_id) AS authors FROM hits JOIN m USING (msg_id) GROUP BY ALL""",
)
def a6(spark, d):
    hits = moderation.fuzzy_banned_match(
        messages(spark, d), "content", TEST.fuzzy_words, ["channel_id", "author_id"]
    )
    return moderation.moderation_report(hits, "channel_id", "author_id")


# --- windows ------------------------------------------------------------------------------------


@query(
    "w1_last_n_lines",
    f"WITH {L} SELECT msg_id, array_to_string(list(line) OVER (PARTITION BY conv_id ORDER BY turn "
    "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), chr(10)) || chr(10) AS recent FROM l",
)
def w1(spark, d):
    recent = transcript.last_n_lines(lines(spark, d), "conv_id", "turn", "line", 4, BLOCKS)
    return recent.select("msg_id", transcript.recent_text(F.col("recent")).alias("recent"))


_SO_FAR = "string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn) || chr(10)"


@query(
    "w2_char_budget_suffix",
    f"WITH {L} SELECT msg_id, right({_SO_FAR}, 900) AS tail FROM l",
)
def w2(spark, d):
    return transcript.char_budget_suffix(lines(spark, d), "conv_id", "turn", "line", 900).select("msg_id", "tail")


@query(
    "w3_char_budget_lines",
    f"""WITH {L}, c AS (SELECT conv_id, turn, msg_id, line, sum(length(line) + 1) OVER (PARTITION BY conv_id
      ORDER BY turn) AS upto FROM l)
    SELECT a.msg_id, count(b.turn) AS n, coalesce(string_agg(b.line, chr(10) ORDER BY b.turn), '') AS lines
    FROM c a LEFT JOIN c b ON a.conv_id = b.conv_id AND b.turn <= a.turn
      AND a.upto - b.upto + length(b.line) + 1 <= 1200 GROUP BY a.msg_id""",
)
def w3(spark, d):
    fitted = transcript.char_budget_lines(lines(spark, d), "conv_id", "turn", "line", 1200)
    return fitted.select("msg_id", F.size("lines").alias("n"), F.array_join("lines", "\n").alias("lines"))


_LAG = "lag(content, 1, '<noinput>') OVER (PARTITION BY conv_id ORDER BY turn)"


@query("w4_exact_repeat", f"WITH {M} SELECT msg_id, content = {_LAG} AS is_repeat FROM m")
def w4(spark, d):
    return loops.exact_repeat(messages(spark, d), "conv_id", "turn", "content", BLOCKS).select("msg_id", "is_repeat")


@query(
    "w5_repeat_policy",
    f"""WITH {M}, r AS (SELECT *, content = {_LAG} AS rep FROM m),
    k AS (SELECT msg_id, rep, sum(rep::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM r)
    SELECT msg_id, CASE WHEN rep THEN CASE WHEN (k - 1) % 3 = 2 THEN 'give_up' ELSE 'retry' END END AS policy FROM k""",
)
def w5(spark, d):
    repeats = loops.exact_repeat(messages(spark, d), "conv_id", "turn", "content", BLOCKS)
    return loops.repeat_policy(repeats, "conv_id", "turn", "is_repeat", BLOCKS).select("msg_id", "policy")


def _common(a: str, b: str, n: str) -> str:
    return f"len(list_filter(range(1, {n} + 1), lambda i: lower(left({a}, i)) = lower(left({b}, i))))"


_AFFIX = f"""WITH {M}, a AS (SELECT msg_id, content AS cur, {_LAG} AS prev FROM m),
b AS (SELECT *, length(cur) AS n, length(prev) AS pn, least(length(cur), length(prev)) AS s FROM a),
c AS (SELECT *, {_common('cur', 'prev', 's')} AS lcp, {_common('reverse(cur)', 'reverse(prev)', 's')} AS lcs FROM b),
e AS (SELECT *, greatest(least(lcp, s - 1), 0) AS cut, greatest(least(lcs, s - 1), 0) AS tail FROM c)"""


@query("w6_trim_repeated_prefix", f"{_AFFIX} SELECT msg_id, CASE WHEN s > 0 THEN cut ELSE 0 END AS cut FROM e")
def w6(spark, d):
    rows = loops.with_previous_reply(messages(spark, d), "conv_id", "turn", "content", BLOCKS)
    return rows.select("msg_id", loops.trim_repeated_prefix(F.col("content"), F.col("previous")).alias("cut"))


@query(
    "w7_trim_repeated_suffix",
    f"""{_AFFIX} SELECT msg_id, cut AS prefix_cut, tail AS suffix_cut,
      CASE WHEN n - tail > pn - CASE WHEN lcp > 0 THEN cut + 1 ELSE 1 END THEN left(cur, n - tail)
           ELSE substr(cur, cut + 1) END AS text FROM e""",
)
def w7(spark, d):
    rows = loops.with_previous_reply(messages(spark, d), "conv_id", "turn", "content", BLOCKS)
    trimmed = loops.with_trimmed_affixes(rows, "content", "previous", "text")
    return trimmed.select("msg_id", "prefix_cut", "suffix_cut", "text")


@query(
    "w8_drop_lines",
    f"""WITH {L}, g AS (SELECT conv_id, list(line ORDER BY turn) AS x FROM l GROUP BY conv_id)
    SELECT conv_id, CAST(0 AS BIGINT) AS segment, CASE WHEN len(x) > 2 THEN array_to_string(x[3:], chr(10)) END AS without_first,
      CASE WHEN len(x) > 2 THEN array_to_string(x[:-3], chr(10)) END AS without_last FROM g""",
)
def w8(spark, d):
    rows = lines(spark, d)
    first = transcript.without_edges(rows, "conv_id", "turn", "line", first=2, out="without_first")
    last = transcript.without_edges(rows, "conv_id", "turn", "line", last=2, out="without_last")
    return first.join(last, ["conv_id", "segment"])


_CHECKS = f"""v AS ({derived.VERDICTS_SQL}), p AS (SELECT *, row_number() OVER (PARTITION BY channel_id
    ORDER BY event_id) - 1 AS pos, contains(lower(answer), 'y') AS positive FROM v),
  s AS (SELECT *, pos - coalesce(max(CASE WHEN positive THEN pos END) OVER (PARTITION BY channel_id ORDER BY pos), -1)
    AS streak FROM p)"""


def checks(spark, d):
    return ordered.number_rows(
        derived.verdicts(spark, d), "channel_id", ["event_id"],
        F.call_function("div", F.col("event_id"), F.lit(1000)),
    )


@query(
    "w9_negative_streak_backoff",
    f"WITH {_CHECKS} SELECT event_id, positive, streak, CASE WHEN streak <= 3 THEN streak ELSE 0 END AS wait, "
    "least(streak, 3) AS held FROM s",
)
def w9(spark, d):
    rows = gate.negative_streak_backoff(checks(spark, d), "channel_id", "pos", "answer", 10)
    return rows.select(
        "event_id", "positive", "streak", "wait", gate.backoff_wait(F.col("streak"), cap_holds=True).alias("held")
    )


# --- sorts and sets --------------------------------------------------------------------------


@query("k1_newest_k_per_channel", f"WITH {_RANKED} SELECT channel_id, msg_id, rank FROM r WHERE rank <= 3")
def k1(spark, d):
    return resolve.newest_k_per_channel(messages(spark, d), 3).select("channel_id", "msg_id", "rank")


@query("k2_chronological", f"WITH {M} SELECT ts_s, msg_id FROM m ORDER BY ts_s, msg_id")
def k2(spark, d):
    return resolve.chronological(messages(spark, d)).select("ts_s", "msg_id")


@query(
    "k3_first_attachment",
    f"""WITH {M} SELECT msg_id, CASE WHEN n_attachments > 0 THEN 'a' || CAST(turn AS STRING) END AS url,
      CASE WHEN n_attachments > 0 THEN 640 + turn END AS width FROM m""",
)
def k3(spark, d):
    def file(prefix: str):
        return F.struct(
            F.concat(F.lit(prefix), F.col("turn").cast("string")).alias("url"), (F.col("turn") + 640).alias("width")
        )

    files = F.when(F.col("n_attachments") > 0, F.array(file("a"), file("b"))).otherwise(
        F.slice(F.array(file("a")), F.lit(1), F.lit(0))
    )
    first = messages(spark, d).select("msg_id", resolve.first_attachment(files).alias("f"))
    return first.select("msg_id", "f.url", "f.width")


@query(
    "u1_backfill_union_live",
    f"WITH {_RANKED} SELECT msg_id, rank = 1 AS is_live FROM r WHERE rank <= 4",
)
def u1(spark, d):
    live = triggers(spark, d)
    backfill = resolve.backfill_recent(messages(spark, d), live, 4)
    return resolve.backfill_union_live(backfill.drop("rank"), live).select("msg_id", "is_live")


@query("u2_exclude_current", f"WITH {_RANKED} SELECT msg_id FROM r WHERE rank > 1")
def u2(spark, d):
    return resolve.exclude_current(messages(spark, d), triggers(spark, d)).select("msg_id")


# --- state, in batch -----------------------------------------------------------------------------


@query(
    "st3_cooldown_batch",
    """WITH RECURSIVE t AS (SELECT user_id % 3 AS channel_id, epoch_us(ts) // 5500000 AS tick, count(*) AS n_messages
      FROM events GROUP BY 1, 2),
    a AS (SELECT channel_id, min(tick) AS tick FROM t GROUP BY channel_id
      UNION ALL SELECT * FROM (SELECT a.channel_id, (SELECT min(t.tick) FROM t WHERE t.channel_id = a.channel_id
        AND t.tick >= a.tick + 40) AS tick FROM a) WHERE tick IS NOT NULL)
    SELECT t.channel_id, t.tick, t.n_messages, a.tick IS NOT NULL AS accepted
    FROM t LEFT JOIN a ON a.channel_id = t.channel_id AND a.tick = t.tick""",
)
def st3_batch(spark, d):
    events = event_messages(derived.load(spark, d, "events")).withColumn("channel_id", F.col("channel_id") % 3)
    return gate.cooldown(events, ticks=40, chunk_ticks=4096).drop("free_tick")


_WORDS_SO_FAR = f"""w AS (SELECT msg_id AS request_id, unnest(string_split(content, ' ')) || ' ' AS token,
    unnest(range(0, len(string_split(content, ' ')))) AS i FROM m),
  u AS (SELECT request_id, i, string_agg(token, '') OVER (PARTITION BY request_id ORDER BY i) AS text FROM w),
  f AS (SELECT request_id, i, {o.sub('text', o.END, '', 'gi')} AS reply FROM u WHERE length(text) > 2
    AND (length(text) > LIMIT_ OR regexp_matches(text, {lit('(?i)' + o.END)}))),
  r AS (SELECT request_id, arg_min(reply, i) AS reply FROM f WHERE length(reply) > 0 GROUP BY request_id)"""


@query(
    "st4_assemble_tokens_batch",
    f"""WITH {M}, {_WORDS_SO_FAR.replace('LIMIT_', '500')} SELECT msg_id AS request_id,
      CASE WHEN reply IS NULL THEN 'listening' ELSE 'finished' END AS status, reply
    FROM m LEFT JOIN r ON request_id = msg_id""",
)
def st4_batch(spark, d):
    return tokens.assemble_tokens(derived.tokens(spark, d), TEST.reply_header, 500, "Bot", block_rows=16)


_NAMES = f"""WITH u AS ({derived.MEMBER_UPDATES_SQL}), c AS (SELECT seq, member_id,
    CASE WHEN new_display IS NOT NULL AND new_display IS DISTINCT FROM old_display THEN new_display
         WHEN new_user IS DISTINCT FROM old_user AND new_nick IS NOT NULL THEN new_nick
         WHEN new_user IS DISTINCT FROM old_user THEN new_user END AS name FROM u)"""


@query(
    "st7_member_names_batch",
    f"{_NAMES} SELECT member_id, arg_max(name, seq) AS name FROM c WHERE name IS NOT NULL GROUP BY member_id",
)
def st7_batch(spark, d):
    return gate.current_names(derived.member_updates(spark, d))


@query(
    "st7_initial_name",
    f"""{_NAMES}, n AS (SELECT member_id, arg_max(name, seq) AS name FROM c WHERE name IS NOT NULL GROUP BY member_id),
    i AS ({derived.USERS_SQL}) SELECT coalesce(user_id, member_id) AS member_id,
      coalesce(n.name, nickname, username) AS name FROM i FULL JOIN n ON user_id = member_id""",
)
def st7_initial(spark, d):
    initial = derived.users(spark, d).withColumnRenamed("user_id", "member_id")
    return gate.current_names(derived.member_updates(spark, d), initial)
