"""The operators in the order in which a chat room needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import TOKEN_LIMITS, ChatConfig
from threadloom.functions import jsonio
from threadloom.functions import text as tx
from threadloom.operators import loops, moderation, pictures, resolve, tokens, transcript, waiting_room


def sanitize_live(
    messages: DataFrame, users: DataFrame, channels: DataFrame, conf: ChatConfig
) -> DataFrame:
    """Add ``line``: the chat line of each live message, moderated.

    Names are resolved, tags replaced, fake headers removed; then exact banned
    words are masked, then misspelled ones; a note tells of an attachment.
    """
    named = resolve.resolve_mentions(messages, users, channels, "content", "msg_id", "_text")
    named = resolve.resolve_author(named, users, F.lit("User"))
    body = tx.strip_spoof_headers(tx.flatten_newlines(F.col("_text")))
    chat_line = tx.format_chat_line(tx.clean_username(F.col("author_name")), body)
    lines = named.withColumn("line", tx.mask_words(chat_line, conf.exact_words))
    masked = moderation.with_mask_fuzzy(lines, "line", conf.fuzzy_words, "****")
    note = tx.attachment_note(F.col("author_name"), F.col("n_attachments"))
    # What is matched against earlier lines is the line without the note.
    return (
        masked.withColumn("filtered", F.col("line"))
        .withColumn("line", F.concat("line", note))
        .drop("_text")
    )


def sanitize_backfill(
    messages: DataFrame, users: DataFrame, channels: DataFrame, triggers: DataFrame, conf: ChatConfig,
    k: int = 10,
) -> DataFrame:
    """One row per channel: the transcript of its k newest messages, moderated.

    Differs from the live way on purpose: raw names and texts, links redacted and
    tags replaced over the whole transcript, misspelled words before exact ones,
    and an escaped mask.  A channel has at most k lines here.
    """
    recent = resolve.backfill_recent(messages, triggers, k)
    named = resolve.resolve_author(recent, users, F.lit(""))
    note = tx.attachment_note(F.col("author_name"), F.col("n_attachments"))
    line = F.concat(F.lit("["), "author_name", F.lit("]: "), "content", note, F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "msg_id", line.alias("line"))))
    history = named.groupBy("channel_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("history")
    )
    linked = history.withColumn("history", tx.redact_links(F.col("history")))
    tagged = resolve.resolve_mentions(linked, users, channels, "history", "channel_id")
    fuzzy = moderation.with_mask_fuzzy(tagged, "history", conf.fuzzy_words, "\\*\\*\\*\\*")
    return fuzzy.withColumn("history", tx.mask_words(F.col("history"), conf.exact_words))


def clean_reply(replies: DataFrame, reply: str, prompt: str, conf: ChatConfig) -> DataFrame:
    """Add ``raw`` (echo stripped, banned words gone) and ``message`` (cut, no tone tag)."""
    masked = moderation.with_mask_fuzzy(replies, reply, conf.fuzzy_words, "", "_masked")
    raw = masked.withColumn("raw", tx.strip_prompt_echo(F.col("_masked"), F.col(prompt))).drop("_masked")
    cut = tx.cut_at_end_marker(F.col("raw"), conf.bot_name)
    return raw.withColumn("message", tx.strip_tone_tag(cut))


def postprocess_reply(
    replies: DataFrame, key: str, pos: str, reply: str, prompt: str, line: str, conf: ChatConfig
) -> DataFrame:
    """What becomes of each model reply.

    Adds the policy (send, retry, give_up, wipe_and_retry), the message that is
    sent, and the line that the transcript remembers: without openings and
    endings that the last reply had too, and without links.
    """
    cleaned = clean_reply(replies, reply, prompt, conf)
    judged = loops.judge_replies(
        cleaned, key, pos, "message", line, conf.bot_name, conf.char_budget, conf.block_rows, raw="raw"
    )
    sent = F.col("policy") == "send"
    judged = loops.with_trimmed_affixes(judged, "message", "previous")
    remembered = F.concat(F.lit(conf.reply_header), "trimmed", F.lit("\n"))
    speaks = sent & (F.length(tx.trim_all(F.col("message"))) > 0)
    return judged.select(
        "*",
        F.when(speaks | (F.col("policy") == "give_up"), F.col("message")).alias("emitted"),
        F.when(sent & ~F.col("is_degenerate"), tx.redact_links(remembered, "url removed")).alias("memory_line"),
    )


def verdict_requests(
    messages: DataFrame,
    users: DataFrame,
    conf: ChatConfig,
    line: str = "line",
    filtered: str | None = None,
    second_backend: bool = False,
) -> DataFrame:
    """Add ``request``: asks a model whether the bot is addressed.

    Context is the last lines of the conversation, notes of pictures counted as lines; a
    reply has the quoted message just before it.  ``filtered`` is the message's line
    without its note (that of ``sanitize_live``), where ``line`` has one.
    ``second_backend`` asks in the nested form, with the stricter safety settings of a check.
    """
    recent = transcript.last_text_lines(messages, "conv_id", "turn", line, conf.context_lines, conf.block_rows, "_recent")
    threaded = resolve.thread_context(recent, users, conf)
    text = resolve.thread_lines(F.col("_recent"), F.col("quote_line"), F.col(filtered or line), drop_last=1)
    context = F.when(F.col("quote_line").isNull(), F.concat(text, F.lit("\n"))).otherwise(text)
    prompt = tx.verdict_prompt(context, conf)
    if second_backend:
        request = jsonio.content_request(F.col("prompt"), verdict=True)
    else:
        request = jsonio.completion_request(F.col("prompt"), TOKEN_LIMITS["verdict"])
    return threaded.withColumn("prompt", prompt).withColumn("request", request).drop("_recent")


def model_answers(responses: DataFrame, second_backend: bool = False) -> DataFrame:
    """request_id, status and text of stored model responses (request_id, body).

    The text is null where the status is not ok: a blocked, malformed or missing answer.
    """
    parsed = responses.select("request_id", jsonio.parse_answer(F.col("body"), second_backend).alias("_answer"))
    return parsed.select("request_id", "_answer.status", "_answer.text")


def verdicts_of(responses: DataFrame, second_backend: bool = False) -> DataFrame:
    """Verdicts for ``reply_gate`` from the responses to ``verdict_requests``: msg_id, answer.

    A response without a text (blocked by the safety settings, say) is no yes, and counts as
    a no; a message without any response has no verdict.
    """
    heard = model_answers(responses, second_backend)
    return heard.select(F.col("request_id").alias("msg_id"), F.coalesce("text", F.lit("")).alias("answer"))


def reply_requests(
    messages: DataFrame,
    users: DataFrame,
    conf: ChatConfig,
    line: str = "line",
    filtered: str | None = None,
    second_backend: bool = False,
) -> DataFrame:
    """Add ``request``: the chat prompt, or the picture prompt for a picture request.

    The chat prompt has the last ``char_budget`` characters of the transcript.  Whether a
    picture is asked for is read off ``filtered``, the line without its note.
    ``second_backend`` asks in the nested form, with that backend's character and one token
    limit for both kinds.
    """
    memory = transcript.memory_text(messages, "conv_id", "turn", line, conf.char_budget, conf.block_rows, "_memory")
    threaded = resolve.thread_context(memory, users, conf)
    said = tx.remove_newlines(F.col(filtered or line))
    # The trimmed transcript loses its last two lines here.
    remembered = F.split(tx.trim_all(F.col("_memory")), "\n")
    text = resolve.thread_lines(remembered, F.col("quote_line"), said, drop_last=2)
    wants = threaded.withColumn("is_picture", pictures.picture_request(F.col(filtered or line)))
    quoted = F.regexp_extract("quote_line", r"^\[[^\]]*\]: ([\s\S]*)$", 1)
    quote = F.when(F.col("quote_line").isNotNull(), quoted)
    prompt = F.when(F.col("is_picture"), pictures.picture_prompt(F.col("content"), quote, conf)).otherwise(
        tx.reply_prompt(text, conf, second_backend)
    )
    limit = F.when(F.col("is_picture"), TOKEN_LIMITS["picture"]).otherwise(TOKEN_LIMITS["reply"])
    if second_backend:
        request = jsonio.content_request(F.col("prompt"))
    else:
        request = jsonio.completion_request(F.col("prompt"), limit)
    return wants.withColumn("prompt", prompt).withColumn("request", request).drop("_memory")


def picture_replies(
    requests: DataFrame,
    responses: DataFrame,
    conf: ChatConfig,
    message: str = "content",
    second_backend: bool = False,
) -> DataFrame:
    """From picture requests and stored model responses to picture parameters.

    ``requests`` has request_id, prompt, the asking message and n_attachments
    (with attached_width and attached_height); ``responses`` has request_id, body.
    """
    asked = requests.where(pictures.picture_request(F.col(message)))
    answered = asked.join(responses, "request_id")
    parsed = answered.withColumn("_text", jsonio.parse_answer(F.col("body"), second_backend)["text"]).where(
        F.col("_text").isNotNull()
    )
    masked = moderation.with_mask_fuzzy(parsed, "_text", conf.fuzzy_words, "")
    raw = tx.strip_prompt_echo(F.col("_text"), F.col("prompt"))
    split = masked.withColumn("_parts", tx.split_at_end_marker(raw, conf.bot_name))
    heads = split.withColumn("picture_text", F.col("_parts.head")).withColumn("_tail", F.col("_parts.tail"))
    request = tx.remove_newlines(F.col(message))
    intent = heads.withColumn("_intent", pictures.picture_intent(request, F.col("picture_text")))
    plan = pictures.picture_plan(
        F.col("_intent.selfie"), F.col("_intent.format"), F.col("picture_text"), F.col("n_attachments"),
        F.col("attached_width"), F.col("attached_height"),
    )
    return intent.select(
        "request_id",
        F.col("_intent.selfie").alias("selfie"),
        plan.alias("plan"),
        pictures.image_description_line(F.col("_intent.format"), F.col("picture_text"), conf.bot_name).alias(
            "memory_line"
        ),
        tx.tail_message(F.col("_tail"), conf.reply_header).alias("message"),
    )


def picture_server_requests(planned: DataFrame, attachments: DataFrame) -> DataFrame:
    """request_id, endpoint and document of each planned picture that can be drawn.

    ``planned`` comes from ``picture_replies``; ``attachments`` has request_id and
    content (bytes of the first attached picture, one row per request).  Requests
    whose picture is missing drop out.
    """
    pictures_of = attachments.where(F.col("content").isNotNull()).select(
        "request_id", jsonio.encode_image(F.col("content")).alias("_image")
    )
    document = jsonio.picture_server_request(F.col("plan"), F.col("_image"))
    told = planned.join(pictures_of, "request_id", "left").select(
        "request_id", F.col("plan.endpoint").alias("endpoint"), document.alias("request")
    )
    return told.where(F.col("request").isNotNull())


def token_requests(
    messages: DataFrame, users: DataFrame, conf: ChatConfig, line: str = "line"
) -> DataFrame:
    """Add ``request`` for the token server: shortened, quoted, cleaned and escaped."""
    threaded = resolve.thread_context(messages, users, conf, conf.quote_limit)
    flat = tx.remove_newlines(F.col(line))
    is_picture = flat.rlike("(?id)" + pictures.cfg.PICTURE_REQUEST_PATTERN)
    short = tx.truncate_text(flat, conf.message_limit)["text"]
    quoted = F.concat(F.coalesce(F.concat("quote_line", F.lit("\n")), F.lit("")), short)
    plain = threaded.withColumn("is_picture", is_picture).withColumn(
        "_prompt", tx.mask_words(quoted, conf.exact_words, "")
    )
    masked = moderation.with_mask_fuzzy(plain, "_prompt", conf.fuzzy_words, "")
    escaped = tx.escape_symbols(tx.unescape(F.col("_prompt")))
    header = F.when(F.col("is_picture"), pictures.cfg.PICTURE_HEADER).otherwise(conf.reply_header)
    return (
        masked.withColumn("prompt", F.concat(escaped, F.lit("\n"), header))
        .withColumn("request", jsonio.token_request(F.col("prompt")))
        .drop("_prompt")
    )


def token_replies(token_rows: DataFrame, conf: ChatConfig) -> DataFrame:
    """Replies of the token server."""
    return tokens.assemble_tokens(token_rows, conf.reply_header, conf.token_limit, conf.bot_name)


def token_pictures(token_rows: DataFrame, conf: ChatConfig) -> DataFrame:
    """Picture keywords of the token server, moderated."""
    heard = tokens.assemble_tokens(
        token_rows, pictures.cfg.PICTURE_HEADER, conf.picture_token_limit, conf.bot_name
    ).where(F.col("status") == "finished")
    phrase = F.regexp_replace("reply", "(?d)" + pictures.cfg.PICTURE_REQUEST_PATTERN, "")
    masked = moderation.with_mask_fuzzy(heard.withColumn("keywords", phrase), "keywords", conf.fuzzy_words, "")
    return masked.select("request_id", F.regexp_replace("keywords", "[^a-zA-Z,\\s]+", "").alias("keywords"))


def reply_gate(
    messages: DataFrame,
    verdicts: DataFrame | None,
    conf: ChatConfig,
    replies: DataFrame | None = None,
    cap_holds: bool = False,
) -> DataFrame:
    """Messages to answer, when, and why: channel_id, msg_id, at (milliseconds), reason.

    A direct mention is answered at once and locks the channel until a reply, for ten
    ticks at most.  The newest message of a tick, unless it is one, is put to a model and
    answered on a yes; after a no the next checks wait.  Messages wait for the lock for 45
    seconds at most.  ``verdicts`` (msg_id, answer) are known beforehand, or, with
    channel_id and ts, come when they do.  Replies are the bot's own messages and
    ``replies`` (channel_id, ts).
    """
    timed = verdicts is not None and "ts" in verdicts.columns
    if verdicts is not None and not timed:
        messages = messages.join(verdicts.select("msg_id", "answer"), "msg_id", "left")
    found = waiting_room.answers(waiting_room.events(messages, conf, verdicts if timed else None, replies), conf, cap_holds)
    return found.where("action <> 'asked'").select("channel_id", "msg_id", "at", F.col("action").alias("reason"))


def moderated_transcript(conversations: DataFrame, conf: ChatConfig) -> DataFrame:
    """Moderated transcript per conversation, in segments, the last with the last characters of all.

    The flagship: one shuffle on (conversation, segment), and one of the segments' ends.
    """
    body = tx.strip_spoof_headers(tx.flatten_newlines(F.col("text")))
    line = tx.mask_words(tx.format_chat_line(tx.clean_username(F.col("role")), body), conf.exact_words)
    lines = conversations.select("conv_id", "turn", line.alias("line"))
    joined = transcript.build_transcript(lines, "conv_id", "turn", "line", conf.segment_rows)
    return transcript.with_tail(joined, "conv_id", "transcript", conf.char_budget)
