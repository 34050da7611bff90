"""Named queries: the operators chained as a chat room needs them."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from threadloom import config as cfg
from threadloom.operators import ordered
from threadloom.plans import catalog_chat as chat
from threadloom.plans import catalog_text as texts
from threadloom.plans import chains
from threadloom.plans import oracle_parts as o
from threadloom.plans.catalog_chat import triggers
from threadloom.plans.catalog_text import lines, messages
from threadloom.plans.oracle_parts import L, M, TEST, lit, sub
from threadloom.plans.registry import query
from threadloom.sources import derived


def dims(spark, d):
    return derived.users(spark, d), derived.channels(spark, d)


_CONV_LINE = o.exact(f"'[' || {o.nz('role')} || ']: ' || {o.trim(o.spoof('replace(text, chr(10), chr(32))'))}")


@query(
    "moderated_transcript",
    f"""WITH l AS (SELECT conv_id, turn, {_CONV_LINE} AS line FROM conversations),
    t AS (SELECT conv_id, turn // 1000 AS segment, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY turn)
      AS transcript FROM l GROUP BY ALL),
    w AS (SELECT conv_id, max(turn // 1000) AS segment, right(string_agg(line, chr(10) ORDER BY turn) || chr(10), 500) AS tail
      FROM l GROUP BY conv_id)
    SELECT t.*, w.tail FROM t LEFT JOIN w USING (conv_id, segment)""",
)
def flagship(spark, d):
    return chains.moderated_transcript(derived.load(spark, d, "conversations"), TEST)


# --- sanitizing -----------------------------------------------------------------------------

_NAME = "coalesce(u.display_name, u.nickname, u.username)"
SANITIZED = f"""{chat._TAGS}, {chat._STOPPED},
x AS (SELECT m.*, {_NAME} AS author_name,
  {o.exact(f"'[' || {o.nz(_NAME)} || ']: ' || " + o.trim(o.spoof("replace(a.text, chr(10), ' ')")))} AS line
  FROM m JOIN a USING (msg_id) JOIN users u ON u.user_id = m.author_id),
{o.fuzzy('x', 'msg_id', 'line')},
z AS (SELECT x.* EXCLUDE (line), {o.masked('line', '****')} AS filtered, {o.masked('line', '****')} || CASE WHEN n_attachments > 0
    THEN chr(10) || '[System]: ' || author_name || ' attached an image' ELSE '' END AS line
  FROM x LEFT JOIN det USING (msg_id))"""


@query("p1_sanitize_live", f"WITH {SANITIZED} SELECT msg_id, line FROM z")
def p1(spark, d):
    return chains.sanitize_live(messages(spark, d), *dims(spark, d), TEST).select("msg_id", "line")


_HISTORY = f"""{chat._RANKED}, {o.USERS}, {o.CHANNELS},
h0 AS (SELECT r.channel_id, string_agg('[' || {_NAME} || ']: ' || content || CASE WHEN n_attachments > 0
    THEN chr(10) || '[System]: ' || {_NAME} || ' attached an image' ELSE '' END || chr(10), ''
    ORDER BY ts_s, msg_id) AS content
  FROM r JOIN users u ON u.user_id = r.author_id WHERE rank BETWEEN 2 AND 10 GROUP BY r.channel_id),
h AS (SELECT channel_id AS msg_id, {sub('content', cfg.LINK_PATTERN, '<url>')} AS content FROM h0)"""
# The tag steps work on any table of (msg_id, content): here, on whole histories.
_HISTORY_TAGS = (
    chat._TAGS.split(f"{o.CHANNELS},")[1].replace("FROM m)", "FROM h)")
    + ", "
    + chat._STOPPED.replace("FROM m LEFT JOIN t3", "FROM h m LEFT JOIN t3")
)


@query(
    "p2_sanitize_backfill",
    f"""WITH {_HISTORY}, {_HISTORY_TAGS}, {o.fuzzy('a', 'msg_id', 'text')}
    SELECT msg_id AS channel_id, {o.exact(o.masked('text', chr(92) + '*' + chr(92) + '*' + chr(92) + '*' + chr(92) + '*'))}
      AS history FROM a LEFT JOIN det USING (msg_id)""",
)
def p2(spark, d):
    return chains.sanitize_backfill(messages(spark, d), *dims(spark, d), triggers(spark, d), TEST).select(
        "channel_id", "history"
    )


# --- replies ------------------------------------------------------------------------------------

_PROMPT = "[Admin]: "
_CLEANED = f"""{L}, {o.fuzzy('l', 'msg_id', 'content')},
c0 AS (SELECT conv_id, turn, line, {o.trim(f"replace({o.masked('content', '')}, {lit(_PROMPT)}, '')")} AS raw
  FROM l LEFT JOIN det USING (msg_id)),
c AS (SELECT *, {sub(o.cut('raw'), cfg.TONE_TAG_PATTERN, '', '')} AS message FROM c0)"""


def _near(reply: str) -> str:
    """CTE chain: the first earlier line that the reply column nearly repeats."""
    bare = chat._BARE
    return f"""{chat.memory('c')},
s AS (SELECT x.conv_id, x.turn, y.line_no AS line_turn, y.line, {bare.format('x.' + reply)} AS a,
    {bare.format('y.line')} AS b, length(x.{reply}) // 3 AS lim
  FROM c x JOIN mem y ON x.conv_id = y.conv_id AND x.turn = y.turn AND y.line <> ''),
g AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0 WHEN abs(length(a) - length(b)) >= lim THEN NULL
    ELSE levenshtein({chat._PLAIN.format('a')}, {chat._PLAIN.format('b')}) END AS plain FROM s),
v AS (SELECT *, CASE WHEN plain IS NULL OR plain >= lim THEN FALSE WHEN plain * 2 < lim THEN TRUE
    ELSE {o.weighted('a', 'b')} < lim END AS near FROM g),
n AS (SELECT conv_id, turn, arg_min(line, line_turn) AS near_line FROM v WHERE near GROUP BY ALL)"""


_MARK = f"regexp_extract(raw, {lit(o.END)}, 0)"
_JUDGED = f"""{_CLEANED}, {_near('message')},
j AS (SELECT c.*, near_line, CASE WHEN near_line IS NULL AND length({o.trim('message')}) > 0 THEN message END AS sent
  FROM c LEFT JOIN n USING (conv_id, turn)),
k AS (SELECT *, coalesce(last_value(sent IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '<noinput>') AS prev FROM j),
q AS (SELECT *, message = prev AS rep, sum(CASE WHEN message = prev THEN 1 ELSE 0 END)
    OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM k),
pol AS (SELECT *, CASE WHEN rep THEN CASE WHEN (nth - 1) % 3 = 2 THEN 'give_up' ELSE 'retry' END
    WHEN near_line IS NOT NULL THEN 'wipe_and_retry' ELSE 'send' END AS policy,
    message = {_MARK} OR NOT regexp_matches(message, '[^a-zA-Z0-9]') AS bad,
    length(message) AS len, length(prev) AS plen, least(length(message), length(prev)) AS sh FROM q),
af AS (SELECT *, {chat._common('message', 'prev', 'sh')} AS lcp,
    {chat._common('reverse(message)', 'reverse(prev)', 'sh')} AS lcs FROM pol),
ag AS (SELECT *, greatest(least(lcp, sh - 1), 0) AS pcut, greatest(least(lcs, sh - 1), 0) AS stail FROM af),
ah AS (SELECT *, CASE WHEN sh < 1 THEN message WHEN len - stail > plen - CASE WHEN lcp > 0 THEN pcut + 1 ELSE 1 END
    THEN left(message, len - stail) ELSE substr(message, pcut + 1) END AS trimmed FROM ag)"""


@query(
    "p3_postprocess_reply",
    f"""WITH {_JUDGED} SELECT conv_id, turn, policy, bad AS is_degenerate,
      CASE WHEN policy = 'give_up' OR (policy = 'send' AND length({o.trim('message')}) > 0) THEN message END AS emitted,
      CASE WHEN policy = 'send' AND NOT bad THEN
        {sub(lit(TEST.reply_header) + " || trimmed || chr(10)", cfg.LINK_PATTERN, 'url removed')} END AS memory_line
    FROM ah""",
)
def p3(spark, d):
    replies = lines(spark, d).select("conv_id", "turn", "content", "line").withColumn("prompt", F.lit(_PROMPT))
    done = chains.postprocess_reply(replies, "conv_id", "turn", "content", "prompt", "line", TEST)
    return done.select("conv_id", "turn", "policy", "is_degenerate", "emitted", "memory_line")


# --- requests ---------------------------------------------------------------------------------------

# Threads over lines; in moderated ones the notes of pictures are lines of their own.
_THREADED = f"""
so AS (SELECT *, string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far FROM z),
w AS (SELECT *, string_split(so_far, chr(10))[-9:] AS recent,
  string_split({o.trim("right(so_far || chr(10), 500)")}, chr(10)) AS memory FROM so),
q AS (SELECT w.*, CASE WHEN y.content IS NOT NULL THEN '[' || CASE WHEN y.author_id = {TEST.bot_id} THEN 'Bot'
    ELSE {o.clean('u.username')} END || ']: ' || y.content END AS quote, y.content AS quoted
  FROM w LEFT JOIN m y ON y.msg_id = w.ref_msg_id LEFT JOIN users u ON u.user_id = y.author_id)"""
_PLAIN = f"{L}, {o.USERS}, z AS (SELECT *, line AS filtered FROM l), {_THREADED}"
_LIVE = f"{SANITIZED}, {_THREADED}"
_SAID = "replace(replace(filtered, chr(10), ''), '\\n', '')"
_CHECK = f"CASE WHEN quote IS NULL THEN {chat._threaded(1, 'filtered')} || chr(10) ELSE {chat._threaded(1, 'filtered')} END"


def _again(fuzzy: str) -> str:
    """The CTEs of a second search for words in one query."""
    return re.sub(r"\b(toks|cand|near|hits|det)\b", r"\g<1>2", fuzzy.removeprefix(f"{o.WORDS},"))


def live(spark, d):
    """Moderated messages, written once: windows, quotes and their two sides read them."""
    return ordered.materialize(chains.sanitize_live(messages(spark, d), *dims(spark, d), TEST))


def _verdict_twin(threads: str) -> str:
    return (
        f"WITH {threads} SELECT msg_id, {lit(TEST.verdict_context)} || {_CHECK} || chr(10) || "
        f"{lit(TEST.verdict_question)} AS prompt, CAST(2 AS STRING) AS max_tokens FROM q"
    )


def _verdict_prompts(spark, d, rows, filtered=None):
    asked = chains.verdict_requests(rows, derived.users(spark, d), TEST, filtered=filtered)
    return asked.select("msg_id", "prompt", F.get_json_object("request", "$.max_tokens").alias("max_tokens"))


@query("p6_verdict_requests", _verdict_twin(_PLAIN))
def p6_requests(spark, d):
    return _verdict_prompts(spark, d, lines(spark, d))


@query("p6_live_verdict_requests", _verdict_twin(_LIVE))
def p6_live_requests(spark, d):
    return _verdict_prompts(spark, d, live(spark, d), "filtered")


_WANTED = f"regexp_matches({_SAID}, {lit('(?i)' + cfg.PICTURE_REQUEST_PATTERN)})"
_QUOTED = texts._RAW_PIC.replace("q.content", "quoted").replace("m.content", "content")


def _reply_twin(threads: str) -> str:
    search = o.fuzzy("raw", "msg_id", "prompt")
    search, det = (search, "det") if threads is _PLAIN else (_again(search), "det2")
    return f"""WITH {threads}, raw AS (SELECT msg_id, {_QUOTED} AS prompt, {_WANTED} AS wanted,
      {lit(TEST.character_prompt)} || {chat._threaded(2, _SAID).replace('recent', 'memory')} || chr(10)
        || {lit(TEST.reply_header)} AS chat_prompt FROM q),
    {search}
    SELECT msg_id, wanted AS is_picture, CASE WHEN wanted THEN {texts._NO_NAME} ELSE chat_prompt END AS prompt,
      CASE WHEN wanted THEN '140' ELSE '280' END AS max_tokens FROM raw LEFT JOIN {det} USING (msg_id)"""


def _reply_prompts(spark, d, rows, filtered=None):
    asked = chains.reply_requests(rows, derived.users(spark, d), TEST, filtered=filtered)
    limit = F.get_json_object("request", "$.max_tokens").alias("max_tokens")
    return asked.select("msg_id", "is_picture", "prompt", limit)


@query("p6_reply_requests", _reply_twin(_PLAIN))
def p6_replies(spark, d):
    return _reply_prompts(spark, d, lines(spark, d))


@query("p6_live_reply_requests", _reply_twin(_LIVE))
def p6_live_replies(spark, d):
    return _reply_prompts(spark, d, live(spark, d), "filtered")


# --- the second backend ---------------------------------------------------------------------------

_NESTED = "$.contents[0].parts[0].text"


@query("p6_second_verdict_requests", _verdict_twin(_LIVE).replace(
    "AS max_tokens FROM", "AS max_tokens, 'BLOCK_MEDIUM_AND_ABOVE' AS strictest FROM"
))
def p6_second_requests(spark, d):
    asked = chains.verdict_requests(live(spark, d), derived.users(spark, d), TEST, filtered="filtered", second_backend=True)
    return asked.select(
        "msg_id", F.get_json_object("request", _NESTED).alias("prompt"),
        F.get_json_object("request", "$.generation_config.max_output_tokens").alias("max_tokens"),
        F.get_json_object("request", "$.safety_settings[1].threshold").alias("strictest"),
    )


@query(
    "p6_second_reply_requests",
    _reply_twin(_LIVE)
    .replace(lit(TEST.character_prompt), lit(TEST.second_character_prompt))
    .replace("CASE WHEN wanted THEN '140' ELSE '280' END AS max_tokens", "'350' AS max_tokens"),
)
def p6_second_replies(spark, d):
    asked = chains.reply_requests(live(spark, d), derived.users(spark, d), TEST, filtered="filtered", second_backend=True)
    return asked.select(
        "msg_id", "is_picture", F.get_json_object("request", _NESTED).alias("prompt"),
        F.get_json_object("request", "$.generation_config.max_output_tokens").alias("max_tokens"),
    )


# One transition of a channel's gate at a time: its next event, or what is due before it.
_NEVER = 4_000_000_000_000
GATE = f"""{M},
e AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY tm, kind, msg_id) AS k FROM (
  SELECT channel_id, msg_id, ts_s * 1000 AS tm, CASE WHEN author_id = {TEST.bot_id} THEN 0 ELSE 2 END AS kind,
    coalesce(mention_id = {TEST.bot_id}, FALSE) AND length(content) > 22 AS direct, contains(lower(content), 'y') AS yes
  FROM m WHERE author_id = {TEST.bot_id} OR NOT is_bot)),
s AS (
  SELECT DISTINCT channel_id, 0::BIGINT AS k, 0::BIGINT AS free_at, 0::BIGINT AS resume, 0::BIGINT AS streak,
    NULL::BIGINT AS p_id, NULL::BOOLEAN AS p_yes, NULL::BIGINT AS p_at,
    []::STRUCT(id BIGINT, yes BOOLEAN, direct BOOLEAN, tm BIGINT)[] AS w,
    NULL::BIGINT AS o_at, NULL::BIGINT AS o_id, NULL::VARCHAR AS o_action FROM e
  UNION ALL
  SELECT channel_id, k + (what = 4)::BIGINT,
    CASE WHEN a.direct THEN (a.tm // 5500 + 10) * 5500 WHEN what = 4 AND kind = 0 THEN least(free_at, e_at) ELSE free_at END,
    CASE WHEN what = 3 THEN (due // 5500 + 1 + CASE WHEN p_yes OR streak >= 3 THEN 0 ELSE streak + 1 END) * 5500 ELSE resume END,
    CASE WHEN what = 3 THEN CASE WHEN p_yes THEN 0 ELSE streak + 1 END ELSE streak END,
    CASE WHEN what = 3 OR a.direct THEN NULL ELSE coalesce(a.id, p_id) END,
    CASE WHEN what = 3 OR a.direct THEN NULL ELSE coalesce(a.yes, p_yes) END,
    CASE WHEN what = 3 OR a.direct THEN NULL ELSE coalesce(a.tm, p_at) END,
    CASE WHEN what < 2 THEN w[2:] WHEN what = 4 AND kind = 2 AND e_at < free_at
      THEN list_append(w, {{'id': msg_id, 'yes': e_yes, 'direct': e_direct, 'tm': e_at}}) ELSE w END,
    CASE WHEN a.direct THEN a.tm WHEN what = 3 AND p_yes THEN due END,
    CASE WHEN a.direct THEN a.id WHEN what = 3 AND p_yes THEN p_id END,
    CASE WHEN a.direct THEN 'direct_mention' WHEN what = 3 AND p_yes THEN 'verdict' END
  FROM (
    SELECT *, CASE WHEN what < 2 THEN {{'id': w[1].id, 'yes': w[1].yes, 'direct': w[1].direct, 'tm': due}}
      WHEN what = 4 AND kind = 2 AND e_at >= free_at THEN {{'id': msg_id, 'yes': e_yes, 'direct': e_direct, 'tm': e_at}} END AS a
    FROM (
      SELECT *, least(d0, d1, d3) AS due, CASE WHEN least(d0, d1, d3) <= coalesce(e_at, {_NEVER} - 1)
          THEN CASE least(d0, d1, d3) WHEN d0 THEN 0 WHEN d1 THEN 1 ELSE 3 END
        WHEN e_at IS NOT NULL THEN 4 END AS what
      FROM (
        SELECT s.channel_id, s.k, free_at, resume, streak, p_id, p_yes, p_at, w, e.tm AS e_at, e.kind, e.msg_id,
          e.direct AS e_direct, e.yes AS e_yes,
          CASE WHEN len(w) > 0 THEN free_at ELSE {_NEVER} END AS d0,
          CASE WHEN len(w) > 0 THEN w[1].tm + 45000 ELSE {_NEVER} END AS d1,
          CASE WHEN p_id IS NULL THEN {_NEVER} ELSE greatest((p_at // 5500 + 1) * 5500, resume, (free_at + 5499) // 5500 * 5500) END AS d3
        FROM s LEFT JOIN e ON e.channel_id = s.channel_id AND e.k = s.k + 1))
    WHERE what IS NOT NULL))"""


@query(
    "p6_reply_gate",
    f"WITH RECURSIVE {GATE} SELECT channel_id, o_id AS msg_id, o_at AS \"at\", o_action AS reason FROM s WHERE o_id IS NOT NULL",
)
def p6_gate(spark, d):
    m = messages(spark, d)
    verdicts = m.select("msg_id", F.col("content").alias("answer"))
    return chains.reply_gate(m, verdicts, TEST)


@query(
    "p6_second_backend_gate",
    f"WITH RECURSIVE {GATE} SELECT channel_id, o_id AS msg_id, o_at AS \"at\", o_action AS reason FROM s WHERE o_id IS NOT NULL".replace(
        "contains(lower(content), 'y') AS yes", "(conv_id + turn) % 5 = 1 AND contains(lower(content), 'y') AS yes"
    ),
)
def p6_second_gate(spark, d):
    verdicts = chains.verdicts_of(derived.responses(spark, d), second_backend=True)
    return chains.reply_gate(messages(spark, d), verdicts, TEST)


# --- pictures -------------------------------------------------------------------------------------

_ANSWER_TAIL = "\n# next " + TEST.reply_header + " here you are"
_PICTURES = f"""{M}, asked AS (SELECT *, content || {lit(_ANSWER_TAIL)} AS answer FROM m
    WHERE regexp_matches(replace(content, chr(10), ''), {lit('(?i)' + cfg.PICTURE_REQUEST_PATTERN)})),
  {o.fuzzy('asked', 'msg_id', 'answer')},
  b AS (SELECT msg_id, replace(content, chr(10), '') AS content, n_attachments > 0 AS img, {o.trim(o.masked('answer', ''))} AS raw
    FROM asked LEFT JOIN det USING (msg_id)),
  e AS (SELECT *, regexp_extract(raw, {lit('^((?s:.)*?)(?:' + o.END + ')')}, 1) AS hd,
    regexp_extract(raw, {lit('^(?:' + o.END + ')')}, 0) AS op FROM b),
  p AS (SELECT *, CASE WHEN length(hd) >= 3 THEN hd WHEN op <> '' THEN op ELSE raw END AS head,
    CASE WHEN length(hd) >= 3 THEN substr(raw, length(hd) + 1) ELSE '' END AS tail,
    {texts._ASKS} AS selfie, {texts._FORMAT} AS format FROM e)"""
_HEADER = lit(TEST.reply_header)


_P4 = f"""WITH {_PICTURES} SELECT msg_id AS request_id, selfie, CASE WHEN img THEN 'img2img' ELSE 'txt2img' END AS endpoint,
      CASE WHEN selfie AND NOT img THEN {lit(cfg.PICTURE_CHARACTER)} ELSE '' END || format || ' ((' || head || '))' AS prompt,
      CAST(CASE WHEN img THEN 640 WHEN selfie THEN 688 ELSE 768 END AS INT) AS width,
      chr(10) || '[System]: Bot attached an image: Bot, ' || format || replace(head, chr(10), ', ') || chr(10) AS memory_line,
      CASE WHEN contains(tail, {_HEADER}) THEN replace(substr(tail, instr(tail, {_HEADER})), {_HEADER}, '') END AS message
    FROM p"""


@query("p4_picture_request", _P4)
def p4(spark, d):
    return _picture_plans(_planned(messages(spark, d)))


@query("p4_second_backend", _P4)
def p4_second(spark, d):
    return _picture_plans(_planned(messages(spark, d), second_backend=True))


def _picture_plans(planned):
    return planned.select("request_id", "selfie", "plan.endpoint", "plan.prompt", "plan.width", "memory_line", "message")


def _planned(m, second_backend=False):
    requests = m.select(
        F.col("msg_id").alias("request_id"), "content", F.lit("no echo").alias("prompt"), "n_attachments",
        F.lit(640).alias("attached_width"), F.lit(480).alias("attached_height"),
    )
    text = F.struct(F.concat("content", F.lit(_ANSWER_TAIL)).alias("text"))
    if second_backend:
        content = F.struct(F.struct(F.array(text).alias("parts")).alias("content"))
        answer = F.array(content).alias("candidates")
    else:
        answer = F.array(text).alias("choices")
    responses = m.select(F.col("msg_id").alias("request_id"), F.to_json(F.struct(answer)).alias("body"))
    return chains.picture_replies(requests, responses, TEST, second_backend=second_backend)


_DRAWN = texts._concat(
    f"""'"prompt":' || CAST(to_json(CASE WHEN selfie AND NOT img THEN {lit(cfg.PICTURE_CHARACTER)} ELSE '' END || format || ' ((' || head || '))') AS VARCHAR)""",
    lit(f',"negative_prompt":"{cfg.PICTURE_NEGATIVE}","steps":20,'),
)


@query(
    "n3_picture_requests",
    f"""WITH {_PICTURES}, s AS (SELECT *, CASE WHEN selfie THEN 688 ELSE 768 END AS wd, CASE WHEN selfie THEN 768 ELSE 488 END AS ht FROM p)
    SELECT s.msg_id AS request_id, CASE WHEN img THEN 'img2img' ELSE 'txt2img' END AS endpoint,
      CASE WHEN img THEN '{{"init_images":["' || to_base64(encode(m.content)) || '"],' || {_DRAWN}
          || {lit('"width":640,"height":480,"sampler_name":"DPM++ SDE Karras","denoising_strength":0.35,' + texts._constants(cfg.IMG2IMG_CONSTANTS) + '}')}
        ELSE '{{' || {_DRAWN} || '"width":' || wd || ',"height":' || ht || ',"sampler_name":"DDIM","denoising_strength":0.3,"hr_resize_x":'
          || 2 * wd || ',"hr_resize_y":' || 2 * ht || {lit(',' + texts._constants(cfg.TXT2IMG_CONSTANTS) + ',"override_settings":{}}')} END AS request
    FROM s JOIN m USING (msg_id)""",
)
def n3_pictures(spark, d):
    m = messages(spark, d)
    attached = m.where("n_attachments > 0").select(F.col("msg_id").alias("request_id"), F.encode("content", "utf-8").alias("content"))
    return chains.picture_server_requests(_planned(m), attached)


# --- token server -------------------------------------------------------------------------------------

_SHORT = f"""{L}, {o.USERS}, y AS (SELECT l.msg_id, replace(l.line, '\\n', '') AS flat, CASE WHEN x.content IS NOT NULL THEN
    '[' || CASE WHEN x.author_id = {TEST.bot_id} THEN 'Bot' ELSE {o.clean('u.username')} END || ']: '
    || left(x.content, 150) || chr(10) ELSE '' END AS quote
  FROM l LEFT JOIN m x ON x.msg_id = l.ref_msg_id LEFT JOIN users u ON u.user_id = x.author_id),
i AS (SELECT msg_id, flat, {o.exact('quote || left(flat, 500)', '')} AS body FROM y)"""
_ESCAPED = (
    f"replace(replace(replace(replace(replace({o.masked('body', '')}, '{{', '\\{{'), '}}', '\\}}'), '\"', '\\\"'), "
    "'’', ''''), '$', '')"
)


@query(
    "p5_token_requests",
    f"""WITH {_SHORT}, {o.fuzzy('i', 'msg_id', 'body')} SELECT msg_id,
      {_ESCAPED} || chr(10) || CASE WHEN regexp_matches(flat, {lit('(?i)' + cfg.PICTURE_REQUEST_PATTERN)})
      THEN '### Response:' ELSE {_HEADER} END AS prompt FROM i LEFT JOIN det USING (msg_id)""",
)
def p5(spark, d):
    return chains.token_requests(lines(spark, d), derived.users(spark, d), TEST).select("msg_id", "prompt")


@query(
    "p5_token_pictures",
    f"""WITH {M}, {chat._WORDS_SO_FAR.replace('LIMIT_', '100')},
    ph AS (SELECT request_id, {sub('reply', cfg.PICTURE_REQUEST_PATTERN)} AS kw FROM r),
    {o.fuzzy('ph', 'request_id', 'kw')}
    SELECT request_id, {sub(o.masked('kw', ''), '[^a-zA-Z,' + chr(92) + 's]+')} AS keywords
    FROM ph LEFT JOIN det USING (request_id)""",
)
def p5_pictures(spark, d):
    return chains.token_pictures(derived.tokens(spark, d, picture=True), TEST)


