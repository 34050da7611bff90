"""Named queries: text, time and JSON functions over whole message tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom import config as cfg
from threadloom.functions import editdistance as ed
from threadloom.functions import jsonio
from threadloom.functions import text as tx
from threadloom.operators import loops, moderation, pictures
from threadloom.plans import oracle_parts as o
from threadloom.plans.oracle_parts import L, M, TEST, lit, sub
from threadloom.plans.registry import query
from threadloom.sources import derived


def messages(spark, d):
    return derived.chat_messages(spark, d)


def lines(spark, d):
    body = tx.strip_spoof_headers(tx.flatten_newlines(F.col("content")))
    return messages(spark, d).withColumn("line", tx.format_chat_line(F.col("role"), body))


def simple(name: str, fn, sql_expr: str, source: str = "m", cte: str = M, column: str = "content"):
    """Register a query that shows msg_id and one function of the message text."""
    base = messages if source == "m" else lines

    @query(name, f"WITH {cte} SELECT msg_id, {sql_expr} AS result FROM {source}")
    def run(spark, d):
        return base(spark, d).select("msg_id", fn(F.col(column)).alias("result"))


# --- names and lines --------------------------------------------------------------


@query(
    "t1_clean_username",
    f"WITH {o.USERS} SELECT user_id, {o.nz('coalesce(display_name, nickname, username)')} AS live, "
    f"{o.clean('username')} AS quoted FROM users",
)
def t1(spark, d):
    live = F.coalesce("display_name", "nickname", "username")
    return derived.users(spark, d).select(
        "user_id",
        tx.clean_username(live).alias("live"),
        tx.clean_username(F.col("username"), fallback=False).alias("quoted"),
    )


simple("t2_flatten_newlines", tx.flatten_newlines, "replace(content, chr(10), ' ')")
simple("t3_strip_spoof_headers", tx.strip_spoof_headers, o.spoof("content"))
simple("t5_mask_exact", lambda c: tx.mask_words(c, TEST.exact_words), o.exact("content"))
simple(
    "t6_mask_exact_pic",
    lambda c: tx.mask_words(c, TEST.exact_picture_words, ""),
    o.exact("content", "", TEST.exact_picture_words),
)


@query("t4_format_chat_line", f"WITH {L} SELECT msg_id, line FROM l")
def t4(spark, d):
    return lines(spark, d).select("msg_id", "line")


@query(
    "t7_mask_fuzzy",
    f"WITH {M}, {o.fuzzy('m', 'msg_id', 'content')} SELECT msg_id, {o.masked('content', '****')} AS live, "
    f"{o.masked('content', '')} AS dropped FROM m LEFT JOIN det USING (msg_id)",
)
def t7(spark, d):
    words = TEST.fuzzy_words
    hits = messages(spark, d).select("msg_id", "content", moderation.fuzzy_matches(F.col("content"), words).alias("h"))
    tokens = moderation.detected_tokens(F.col("h"))
    return hits.select(
        "msg_id",
        moderation.mask_tokens(F.col("content"), tokens, "****").alias("live"),
        moderation.mask_tokens(F.col("content"), tokens, "").alias("dropped"),
    )


@query(
    "t8_normalize_token",
    f"WITH {M}, t AS (SELECT DISTINCT unnest(string_split(content, ' ')) AS token FROM m) "
    f"SELECT token, {o.clean('lower(token)')} AS clean FROM t",
)
def t8(spark, d):
    tokens = messages(spark, d).select(F.explode(F.split("content", " ")).alias("token")).distinct()
    return tokens.select("token", tx.normalize_token(F.col("token")).alias("clean"))


@query(
    "t9_weighted_levenshtein",
    f"""WITH {M}, t AS (SELECT msg_id, unnest(string_split(content, ' ')) AS a,
      unnest(range(0, len(string_split(content, ' ')))) AS pos FROM m),
    p AS (SELECT DISTINCT x.a, y.a AS b FROM t x JOIN t y ON x.msg_id = y.msg_id AND y.pos = x.pos + 1)
    SELECT a, b, {o.weighted('a', 'b')} AS distance FROM p""",
)
def t9(spark, d):
    words = F.split("content", " ")
    pairs = messages(spark, d).select(
        F.explode(
            F.zip_with(
                words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
            )
        ).alias("p")
    )
    neighbours = pairs.select("p.a", "p.b").where("b IS NOT NULL").distinct()
    return neighbours.select("a", "b", ed.weighted_levenshtein(F.col("a"), F.col("b")).alias("distance"))


@query(
    "t10_edit_threshold",
    f"""WITH {M}, t AS (SELECT DISTINCT {o.clean('lower(token)')} AS clean FROM
      (SELECT unnest(string_split(content, ' ')) AS token FROM m))
    SELECT clean, CASE WHEN length(clean) > 6 THEN 2 WHEN length(clean) > 4 THEN 1
      WHEN length(clean) > 2 THEN 0 END AS threshold FROM t""",
)
def t10(spark, d):
    tokens = messages(spark, d).select(F.explode(F.split("content", " ")).alias("token"))
    clean = tokens.select(tx.normalize_token(F.col("token")).alias("clean")).distinct()
    return clean.select("clean", tx.edit_threshold(F.col("clean")).alias("threshold"))


@query(
    "t11_redact_links",
    f"""WITH {M} SELECT 'message' AS kind, msg_id AS id, {sub('content', cfg.LINK_PATTERN, '<url>')} AS result FROM m
    UNION ALL SELECT 'page', page_id, {sub('url', cfg.LINK_PATTERN, 'url removed')} FROM pages""",
)
def t11(spark, d):
    texts = messages(spark, d).select(
        F.lit("message").alias("kind"), F.col("msg_id").alias("id"), tx.redact_links(F.col("content")).alias("result")
    )
    pages = derived.load(spark, d, "pages").select(
        F.lit("page").alias("kind"),
        F.col("page_id").alias("id"),
        tx.redact_links(F.col("url"), "url removed").alias("result"),
    )
    return texts.unionByName(pages)


simple("t12_strip_tags", tx.strip_tags, sub("content", cfg.TAG_PATTERN))
# The callout name here is a frequent word of the texts.
simple(
    "t13_strip_bot_callouts",
    lambda c: tx.strip_bot_callouts(c, "the"),
    f"replace({sub('content', '(?:the[?]|the,)')}, 'the', '')",
)
simple("t14_first_line", tx.first_line, "split_part(content, chr(10), 1)")
simple(
    "t15_remove_newlines",
    lambda c: tx.remove_newlines(F.replace(c, F.lit(" the "), F.lit("\\n"))),
    "replace(replace(replace(content, ' the ', '\\n'), chr(10), ''), '\\n', '')",
)
# Escapes are put in place of words, so that their values are known.
simple(
    "t16_soften_symbols",
    lambda c: tx.soften_symbols(F.concat(F.replace(c, F.lit(" the "), F.lit("\\\\\\\\")), F.lit("`“"))),
    "CASE WHEN contains(content, ' the ') THEN replace(translate(replace(replace(replace(replace("
    "replace(content, ' the ', '\\'), '{', ''), '}', ''), '$', ''), '`', ''), '\"“”’', ''''''''''), chr(0), '') "
    "|| '\\`''' ELSE content || '`“' END",
)
simple(
    "t16_escape_symbols",
    tx.escape_symbols,
    "replace(replace(replace(replace(replace(content, '{', '\\{'), '}', '\\}'), '\"', '\\\"'), '’', ''''), '$', '')",
)
simple(
    "t17_unescape",
    lambda c: tx.unescape(
        F.replace(F.replace(F.replace(c, F.lit(" the "), F.lit("\\u00e9\\ud83d\\ude00\\x41")), F.lit(". "), F.lit("\\n\\t\\.")),
                  F.lit(", "), F.lit("\\\\n\\q\\052"))
    ),
    "replace(replace(replace(content, ' the ', 'é😀A'), '. ', chr(10) || chr(9) || '.'), ', ', '\\n\\q*')",
)
simple("t18_strip_control", tx.strip_control, sub("content", r"\p{Cc}"))
simple(
    "t19_strip_prompt_echo",
    lambda c: tx.strip_prompt_echo(F.concat(F.lit("ask: "), c, F.lit(" \n")), F.lit("ask: ")),
    o.trim("replace('ask: ' || content || ' ' || chr(10), 'ask: ', '')"),
)
simple("t20_cut_at_end_marker", tx.cut_at_end_marker, o.cut("content"))
simple("t20_remove_end_markers", tx.remove_end_markers, sub("content", o.END, "", "gi"))

_HEAD = f"regexp_extract(content, {lit('^((?s:.)*?)(?:' + o.END + ')')}, 1)"
_OPEN = f"regexp_extract(content, {lit('^(?:' + o.END + ')')}, 0)"


@query(
    "t21_split_at_end_marker",
    f"""WITH {M}, h AS (SELECT msg_id, content, {_HEAD} AS head, {_OPEN} AS opening FROM m)
    SELECT msg_id, CASE WHEN length(head) >= 3 THEN head WHEN opening <> '' THEN opening ELSE content END AS head,
      CASE WHEN length(head) >= 3 THEN substr(content, length(head) + 1) ELSE '' END AS tail FROM h""",
)
def t21(spark, d):
    return messages(spark, d).select("msg_id", tx.split_at_end_marker(F.col("content")).alias("p")).select(
        "msg_id", "p.head", "p.tail"
    )


simple(
    "t22_tail_message",
    lambda c: tx.tail_message(F.replace(c, F.lit("# next"), F.lit(f"#x{TEST.reply_header} hi")), TEST.reply_header),
    f"CASE WHEN contains(content, '# next') THEN replace(substr(content, instr(content, '# next') + 6), "
    f"{lit(TEST.reply_header)}, '') END".replace("replace(substr", "' hi' || replace(substr"),
)


def _has(word: str) -> str:
    return f"contains(lower(content), {lit(word)})"


_ASKS = " OR ".join(_has(w) for w in ("selfie", *pictures.SELFIE_WORDS, "holding"))
_FORMAT = (
    f"CASE WHEN {_has('selfie')} THEN {lit(pictures.SELFIE_FORMAT)} ELSE '' END || "
    f"CASE WHEN {_has('holding')} THEN {lit(pictures.HOLDING_FORMAT)} ELSE '' END"
)


@query("t23_picture_intent", f"WITH {M} SELECT msg_id, {_ASKS} AS selfie, {_FORMAT} AS format FROM m")
def t23(spark, d):
    intent = pictures.picture_intent(F.col("content"), F.col("content"))
    return messages(spark, d).select("msg_id", intent.alias("i")).select("msg_id", "i.selfie", "i.format")


@query(
    "t24_picture_plan",
    f"""WITH {M}, p AS (SELECT msg_id, content, n_attachments > 0 AS img, {_ASKS} AS selfie, {_FORMAT} AS format FROM m)
    SELECT msg_id, CASE WHEN img THEN 'img2img' ELSE 'txt2img' END AS endpoint,
      CASE WHEN selfie AND NOT img THEN {lit(cfg.PICTURE_CHARACTER)} ELSE '' END || format || ' ((' || content || '))'
        AS prompt,
      CAST(CASE WHEN img THEN 640 WHEN selfie THEN 688 ELSE 768 END AS INT) AS width,
      CAST(CASE WHEN img THEN 480 WHEN selfie THEN 768 ELSE 488 END AS INT) AS height,
      CASE WHEN img THEN 'DPM++ SDE Karras' ELSE 'DDIM' END AS sampler_name,
      CAST(CASE WHEN img THEN NULL WHEN selfie THEN 1376 ELSE 1536 END AS INT) AS hr_resize_x FROM p""",
)
def t24(spark, d):
    intent = pictures.picture_intent(F.col("content"), F.col("content"))
    plan = pictures.picture_plan(
        F.col("i.selfie"), F.col("i.format"), F.col("content"), F.col("n_attachments"), F.lit(640), F.lit(480)
    )
    planned = messages(spark, d).withColumn("i", intent).select("msg_id", plan.alias("p"))
    return planned.select(
        "msg_id", "p.endpoint", "p.prompt", "p.width", "p.height", "p.sampler_name", "p.hr_resize_x"
    )


simple("t25_strip_tone_tag", tx.strip_tone_tag, sub("content", cfg.TONE_TAG_PATTERN, "", ""))
simple(
    "t26_keyword_list_clean",
    tx.keyword_list_clean,
    sub(sub("content", cfg.PICTURE_REQUEST_PATTERN), r"[^a-zA-Z,\s]+"),
)
simple(
    "t27_image_description_line",
    lambda c: pictures.image_description_line(F.lit(", holding "), c, "Bot"),
    "chr(10) || '[System]: Bot attached an image: Bot, , holding ' || replace(content, chr(10), ', ') || chr(10)",
)


@query(
    "t28_truncate_text",
    f"WITH {M} SELECT msg_id, left(content, 500) AS text, length(content) > 500 AS truncated, "
    "left(content, 150) AS quote FROM m",
)
def t28(spark, d):
    cut = messages(spark, d).select(
        "msg_id",
        tx.truncate_text(F.col("content"), TEST.message_limit).alias("t"),
        tx.truncate_text(F.col("content"), TEST.quote_limit)["text"].alias("quote"),
    )
    return cut.select("msg_id", "t.text", "t.truncated", "quote")


@query(
    "t29_ramble_ratio",
    f"""WITH {M}, c AS (SELECT msg_id, length(content) AS n, length(split_part(content, '.', 1)) AS k FROM m)
    SELECT msg_id, n // nullif(k, 0) AS ratio, coalesce(n // nullif(k, 0) >= 1.5, FALSE) AS rambling FROM c""",
)
def t29(spark, d):
    kept = F.split_part("content", F.lit("."), F.lit(1))
    return messages(spark, d).select("msg_id", tx.ramble_ratio(F.col("content"), kept).alias("r")).select(
        "msg_id", "r.ratio", "r.rambling"
    )


simple("t30_strip_whitespace", tx.strip_whitespace, sub("content", r"\s+"))
simple(
    "t31_cut_at_stop_strings",
    tx.cut_at_stop_strings,
    "left(content, least("
    + ", ".join(
        f"CASE WHEN contains(content, {lit(s)}) THEN instr(content, {lit(s)}) - 1 ELSE length(content) END"
        for s in cfg.STOP_STRINGS
    )
    + "))",
)
simple(
    "t32_reply_prompt",
    lambda c: tx.reply_prompt(c, TEST),
    f"{lit(TEST.character_prompt)} || line || chr(10) || {lit(TEST.reply_header)}",
    "l", L, "line",
)
simple(
    "t33_verdict_prompt",
    lambda c: tx.verdict_prompt(c, TEST),
    f"{lit(TEST.verdict_context)} || line || chr(10) || {lit(TEST.verdict_question)}",
    "l", L, "line",
)

_RAW_PIC = (
    f"{lit(cfg.PICTURE_INSTRUCTION)} || chr(10) || "
    + sub(
        o.trim(f"'### User request: ' || coalesce(q.content || chr(10), '') || m.content || chr(10) || {lit(cfg.PICTURE_HEADER)}"),
        cfg.TAG_PATTERN,
    )
)
_NO_NAME = "replace(" + sub(o.exact(o.exact(o.masked("prompt", ""), ""), "", ("tea",)), r"(?:Bot\?|Bot,)") + ", 'Bot', '')"


@query(
    "t34_picture_prompt",
    f"""WITH {M}, raw AS (SELECT m.msg_id, {_RAW_PIC} AS prompt FROM m LEFT JOIN m q ON q.msg_id = m.ref_msg_id),
    {o.fuzzy('raw', 'msg_id', 'prompt')}
    SELECT msg_id, {_NO_NAME} AS prompt FROM raw LEFT JOIN det USING (msg_id)""",
)
def t34(spark, d):
    m = messages(spark, d)
    quoted = m.select(F.col("msg_id").alias("ref_msg_id"), F.col("content").alias("quoted"))
    raw = m.join(quoted, "ref_msg_id", "left").select(
        "msg_id", pictures.raw_picture_prompt(F.col("content"), F.col("quoted")).alias("raw")
    )
    return raw.select("msg_id", pictures.clean_picture_prompt(F.col("raw"), TEST).alias("prompt"))


@query(
    "f7_attachment_note",
    f"""WITH {M}, {o.USERS} SELECT msg_id, CASE WHEN n_attachments > 0 THEN chr(10) || '[System]: ' || username
      || ' attached an image' ELSE '' END AS note FROM m JOIN users ON user_id = author_id""",
)
def f7(spark, d):
    named = messages(spark, d).join(
        derived.users(spark, d).select(F.col("user_id").alias("author_id"), "username"), "author_id"
    )
    return named.select("msg_id", tx.attachment_note(F.col("username"), F.col("n_attachments")).alias("note"))


@query(
    "f5_picture_request",
    f"WITH {M} SELECT msg_id, regexp_matches(replace(replace(content, chr(10), ''), '\\n', ''), "
    f"{lit('(?i)' + cfg.PICTURE_REQUEST_PATTERN)}) AS wanted FROM m",
)
def f5(spark, d):
    return messages(spark, d).select("msg_id", pictures.picture_request(F.col("content")).alias("wanted"))


@query(
    "f9_degenerate_reply",
    f"""WITH {M}, w AS (SELECT msg_id, unnest(string_split(content, ' ')) AS word,
        unnest(range(0, len(string_split(content, ' ')))) AS pos FROM m)
    SELECT msg_id, pos, word, word = regexp_extract(word, {lit(o.END)}, 0) OR NOT regexp_matches(word, '[^a-zA-Z0-9]')
      AS flagged, word = regexp_extract(word, {lit(o.END)}, 0) OR NOT regexp_matches(word, '[a-zA-Z0-9]') AS hollow
    FROM w""",
)
def f9(spark, d):
    words = messages(spark, d).select("msg_id", F.posexplode(F.split("content", " ")).alias("pos", "word"))
    marker = tx.first_end_marker(F.col("word"))
    return words.select(
        "msg_id", "pos", "word",
        loops.degenerate_reply(F.col("word"), marker).alias("flagged"),
        loops.degenerate_reply(F.col("word"), marker, strict=True).alias("hollow"),
    )


@query(
    "f12_prompt_text_guard",
    f"""WITH {M} SELECT msg_id, length(split_part(content, ' ', 2)) > 4
      AND length({o.trim("split_part(content, ' ', 1)")}) > 2 AS usable FROM m""",
)
def f12(spark, d):
    second = F.split_part("content", F.lit(" "), F.lit(2))
    first = F.split_part("content", F.lit(" "), F.lit(1))
    return messages(spark, d).select("msg_id", pictures.prompt_text_guard(second, first).alias("usable"))


@query("f10_non_empty_reply", f"WITH {M} SELECT msg_id FROM m WHERE length({o.trim(sub('content', '^[^,]*,?'))}) > 0")
def f10(spark, d):
    rest = F.regexp_replace("content", "^[^,]*,?", "")
    return messages(spark, d).where(F.length(tx.trim_all(rest)) > 0).select("msg_id")


# --- time -------------------------------------------------------------------------


@query(
    "dt1_local_time",
    """SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Australia/Sydney', '%Y-%m-%d %H:%M:%S') AS sydney,
      strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo', '%Y-%m-%d %H:%M:%S') AS tokyo FROM events""",
)
def dt1(spark, d):
    ts = F.col("ts").cast("timestamp")
    shown = "yyyy-MM-dd HH:mm:ss"
    return derived.load(spark, d, "events").select(
        "event_id",
        F.date_format(tx.local_time(ts, cfg.AUSTRALIA_ZONE), shown).alias("sydney"),
        F.date_format(tx.local_time(ts, cfg.JAPAN_ZONE), shown).alias("tokyo"),
    )


@query(
    "dt2_time_of_day",
    """WITH h AS (SELECT event_type, (hour(ts) + 9) % 24 AS h FROM events)
    SELECT event_type, CASE WHEN h BETWEEN 5 AND 10 THEN 'Morning' WHEN h BETWEEN 11 AND 14 THEN 'Mid-day'
      WHEN h BETWEEN 15 AND 16 THEN 'Afternoon' WHEN h BETWEEN 17 AND 20 THEN 'Evening' ELSE 'Night' END AS part,
      count(*) AS n FROM h GROUP BY ALL""",
)
def dt2(spark, d):
    tokyo = tx.local_time(F.col("ts").cast("timestamp"), cfg.JAPAN_ZONE)
    parts = derived.load(spark, d, "events").select("event_type", tx.time_of_day(tokyo).alias("part"))
    return parts.groupBy("event_type", "part").agg(F.count(F.lit(1)).alias("n"))


# --- JSON ---------------------------------------------------------------------------

_SHAPE = "(conv_id + turn) % 5"


@query(
    "n1_parse_candidates",
    f"""WITH {M} SELECT msg_id AS request_id, CASE {_SHAPE} WHEN 1 THEN 'ok' WHEN 2 THEN 'blocked' ELSE 'malformed' END
      AS status, CASE WHEN {_SHAPE} = 1 THEN content END AS text FROM m""",
)
def n1(spark, d):
    parsed = jsonio.parse_candidates(F.col("body"))
    return derived.responses(spark, d).select("request_id", parsed.alias("p")).select(
        "request_id", "p.status", "p.text"
    )


@query(
    "n2_parse_choices",
    f"""WITH {M} SELECT msg_id AS request_id, CASE {_SHAPE} WHEN 0 THEN 'ok' WHEN 4 THEN 'no_response'
      ELSE 'malformed' END AS status, CASE WHEN {_SHAPE} = 0 THEN content END AS text FROM m""",
)
def n2(spark, d):
    parsed = jsonio.parse_choices(F.col("body"))
    return derived.responses(spark, d).select("request_id", parsed.alias("p")).select(
        "request_id", "p.status", "p.text"
    )


def _json(value) -> str:
    if isinstance(value, tuple):
        return "[" + ",".join(_json(v) for v in value) + "]"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return '"' + value.replace("\n", "\\n") + '"'
    return str(value)


def _constants(values: dict) -> str:
    return ",".join(f'"{k}":{_json(v)}' for k, v in values.items())


def _safety(verdict: bool) -> str:
    rows = [
        f'{{"category":"{c}","threshold":"{strict if verdict else usual}"}}'
        for c, usual, strict in cfg.SAFETY_SETTINGS
    ]
    return '"safety_settings":[' + ",".join(rows) + "]"


def _concat(*parts: str) -> str:
    return " || ".join(parts)


_TEXT = "CAST(to_json(content) AS VARCHAR)"


@query(
    "n3_build_request",
    f"""WITH {M} SELECT msg_id,
    {_concat(lit('{"prompt":'), _TEXT, lit(',"max_tokens":280,' + _constants(cfg.COMPLETION_CONSTANTS) + '}'))} AS reply,
    {_concat(lit('{"contents":[{"parts":[{"text":'), _TEXT, lit('}]}],"generation_config":{"temperature":1,'
             '"max_output_tokens":350,"stop_sequences":["' + chr(92) + 'n["]},' + _safety(False) + '}'))} AS content_reply,
    {_concat(lit('{"contents":[{"parts":[{"text":'), _TEXT, lit('}]}],"generation_config":{"temperature":0.1,'
             '"max_output_tokens":2},' + _safety(True) + '}'))} AS content_verdict,
    {_concat(lit('{' + _constants(cfg.TOKEN_BACKEND_CONSTANTS) + ',"prompt":'), _TEXT, lit('}'))} AS token FROM m""",
)
def n3(spark, d):
    text = F.col("content")
    return messages(spark, d).select(
        "msg_id",
        jsonio.completion_request(text, cfg.TOKEN_LIMITS["reply"]).alias("reply"),
        jsonio.content_request(text).alias("content_reply"),
        jsonio.content_request(text, verdict=True).alias("content_verdict"),
        jsonio.token_request(text).alias("token"),
    )


@query(
    "n4_extract_token",
    f"""WITH {M}, w AS (SELECT msg_id AS request_id, unnest(string_split(content, ' ')) AS word,
      unnest(range(0, len(string_split(content, ' ')))) AS i FROM m)
    SELECT request_id, i + 5 AS seq, word || ' ' AS token FROM w UNION ALL
    SELECT msg_id, h.seq, h.token FROM m, (VALUES (0, 'noise '), (1, '### '), (2, 'Response:'),
      (3, chr(10) || '[Bot]'), (4, ':')) h(seq, token)""",
)
def n4(spark, d):
    return derived.tokens(spark, d).select(
        "request_id", "seq", jsonio.extract_token(F.col("raw")).alias("token")
    )


def image_bodies(spark, d):
    """Picture responses: two images per message, one with a data prefix."""
    encoded = jsonio.encode_image(F.encode("content", "UTF-8"))
    role = jsonio.encode_image(F.encode("role", "UTF-8"))
    images = F.array(F.concat(F.lit("data:image/png;base64,"), encoded), role)
    return messages(spark, d).select(
        F.col("msg_id").alias("request_id"),
        F.to_json(F.struct(images.alias("images"))).alias("body"),
        (F.col("turn") % 2 == 0).alias("selfie"),
    )


_IMAGES = "SELECT msg_id AS request_id, 0 AS image_no, content AS x, turn FROM m UNION ALL SELECT msg_id, 1, role, turn FROM m"


@query(
    "n5_explode_images",
    f"""WITH {M}, i AS ({_IMAGES}) SELECT request_id, image_no,
      CASE WHEN image_no = 0 THEN 'data:image/png;base64,' ELSE '' END || to_base64(encode(x)) AS image FROM i""",
)
def n5(spark, d):
    return image_bodies(spark, d).select(
        "request_id", F.posexplode(jsonio.image_list(F.col("body"))).alias("image_no", "image")
    )


@query(
    "n6_split_join_lines",
    f"""WITH {M} SELECT msg_id, len(string_split(content, chr(10))) AS n,
      array_to_string(string_split(content, chr(10))[3:], chr(10)) AS without_first,
      array_to_string(string_split(content, chr(10))[:-3], chr(10)) AS without_last,
      array_to_string(list_reverse(string_split(content, chr(10))), chr(10)) AS reversed FROM m""",
)
def n6(spark, d):
    split = tx.split_lines(F.col("content"))
    return messages(spark, d).select(
        "msg_id",
        F.size(split).alias("n"),
        tx.join_lines(tx.drop_first_lines(split, 2)).alias("without_first"),
        tx.join_lines(tx.drop_last_lines(split, 2)).alias("without_last"),
        tx.join_lines(F.reverse(split)).alias("reversed"),
    )


@query("f8_affirmative_verdict", f"WITH {M} SELECT msg_id, contains(lower(content), 'y') AS yes FROM m")
def f8(spark, d):
    return messages(spark, d).select("msg_id", jsonio.affirmative(F.col("content")).alias("yes"))
