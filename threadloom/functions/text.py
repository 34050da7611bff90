"""Text functions: column in, column out, all on Spark's built-in functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import config as cfg
from threadloom.config import ChatConfig

ANY = r"[\s\S]"


def apply_to(df: DataFrame, fn, in_col: str, out_col: str, **params) -> DataFrame:
    """Add ``out_col = fn(in_col, **params)`` to a table."""
    return df.withColumn(out_col, fn(F.col(in_col), **params))


def quote(text: str) -> str:
    """A regular expression that matches exactly this text."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def trim_all(text: Column) -> Column:
    """Trim every kind of Unicode white space, not just blanks."""
    return F.btrim(text, F.lit(cfg.WHITESPACE))


def clean_username(name: Column, fallback: bool = True) -> Column:
    """Letters and digits of a name; ``User`` when nothing is left."""
    clean = F.regexp_replace(name, "[^a-zA-Z0-9]+", "")
    return F.when(F.length(clean) < 1, "User").otherwise(clean) if fallback else clean


def flatten_newlines(text: Column) -> Column:
    return F.translate(text, "\n", " ")


def strip_spoof_headers(text: Column) -> Column:
    """Remove ``[name]:`` look-alikes, so that nobody can fake a chat line."""
    return F.regexp_replace(text, cfg.SPOOF_PATTERN, "")


def format_chat_line(name: Column, text: Column) -> Column:
    return F.concat(F.lit("["), name, F.lit("]: "), trim_all(text))


def mask_words(text: Column, words: Iterable[str], mask: str = "****") -> Column:
    """Replace whole words, case-sensitively (letters of any script bound a word)."""
    words = tuple(words)
    return F.regexp_replace(text, "(?U)" + cfg.whole_words_pattern(words), mask) if words else text


def normalize_token(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-zA-Z0-9]+", "")


def edit_threshold(token: Column) -> Column:
    """Allowed distance for a cleaned token; null means that it is not checked."""
    n = F.length(token)
    return F.when(n > 6, 2).when(n > 4, 1).when(n > 2, 0)


def redact_links(text: Column, mask: str = "<url>") -> Column:
    """Hide links, also those spelled with "dot" and "slash"."""
    return F.regexp_replace(text, "(?d)" + cfg.LINK_PATTERN, mask)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, cfg.TAG_PATTERN, "")


def distinct_tags(text: Column) -> Column:
    """Mention and channel tags of a text, each once, in order of first sight."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(cfg.TAG_PATTERN), F.lit(0)))


def strip_bot_callouts(text: Column, bot_name: str) -> Column:
    """Remove ``name?`` and ``name,``, then the bare name."""
    name = quote(bot_name)
    return F.replace(
        F.regexp_replace(text, f"(?:{name}\\?|{name},)", ""), F.lit(bot_name), F.lit("")
    )


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, "^[^\\r\\n]*", 0)


def remove_newlines(text: Column) -> Column:
    """Delete line feeds, both real ones and those written as backslash-n."""
    return F.replace(F.replace(text, F.lit("\n"), F.lit("")), F.lit("\\n"), F.lit(""))


# Pieces of a text with backslash escapes: runs of \uXXXX (whole surrogate pairs
# only), \xXX, octal, control letters, any other escaped character, plain text.
_UNICODE_RUN = (
    r"(?:\\u(?:[0-9a-cA-CefEF][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2}"
    r"|[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}))+"
)
_ESCAPE_PIECES = (
    "(?s)" + _UNICODE_RUN + r"|\\x[0-9a-fA-F]{2}|\\[0-7]{1,3}|\\c[A-Za-z]|\\.|[^\\]+|\\"
)
_LETTER_ESCAPES = {
    "n": "\n", "t": "\t", "r": "\r", "f": "\x0c", "v": "\x0b", "a": "\x07", "e": "\x1b",
}


def _utf16(hex_digits: Column) -> Column:
    return F.decode(F.unhex(hex_digits), "UTF-16BE")


def _unescape_piece(piece: Column) -> Column:
    rest = F.substring(piece, F.lit(2), F.length(piece))
    out = F.when(~piece.startswith("\\"), piece)
    for letter, value in _LETTER_ESCAPES.items():
        out = out.when(piece == "\\" + letter, value)
    return (
        out.when(piece.rlike("^" + _UNICODE_RUN + "$"), _utf16(F.replace(piece, F.lit("\\u"), F.lit(""))))
        .when(piece.rlike(r"^\\x..$"), _utf16(F.concat(F.lit("00"), F.substring(piece, 3, 2))))
        .when(piece.rlike(r"^\\[0-7]+$"), _utf16(F.lpad(F.conv(rest, 8, 16), 4, "0")))
        .when(piece.rlike(r"^\\c.$"), F.char(F.ascii(F.upper(F.substring(piece, 3, 1))) - 64))
        .when(piece.rlike(r"(?s)^\\[^a-zA-Z0-9_]$"), rest)
        .otherwise(piece)
    )


def unescape(text: Column) -> Column:
    """Turn backslash escapes into characters; an unknown escape is left alone."""
    pieces = F.regexp_extract_all(text, F.lit(_ESCAPE_PIECES), F.lit(0))
    return F.when(
        F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, _unescape_piece), "")
    ).otherwise(text)


def soften_symbols(text: Column) -> Column:
    """Symbols that confuse small models, dropped or made plain; only for texts
    that hold a doubled backslash, and again until none does."""

    def once(t: Column) -> Column:
        plain = F.translate(unescape(t), "{}$\"“”’", "\0\0\0''''")
        return F.replace(F.replace(plain, F.lit("\0"), F.lit("")), F.lit("`"), F.lit("\\`"))

    # One pass halves every run of backslashes, so 32 passes end any run.
    doubled = F.lit("\\\\")
    return F.when(
        F.contains(text, doubled),
        F.aggregate(
            F.sequence(F.lit(1), F.lit(32)),
            text,
            lambda t, _: F.when(F.contains(t, doubled), once(t)).otherwise(t),
        ),
    ).otherwise(text)


def escape_symbols(text: Column) -> Column:
    """Braces, double quotes and backticks behind a backslash; dollar signs dropped."""
    out = F.regexp_replace(text, r"[{}`]", r"\\$0")
    out = F.regexp_replace(out, "[\"“”]", "\\\\\"")
    return F.replace(F.translate(out, "’", "'"), F.lit("$"), F.lit(""))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, "\\p{Cc}", "")


def strip_prompt_echo(reply: Column, prompt: Column) -> Column:
    return trim_all(F.replace(reply, prompt, F.lit("")))


def _before(text: Column, pattern: str) -> Column:
    """What stands before the first match (empty when there is none, or at the start)."""
    return F.regexp_extract(text, f"(?d)^({ANY}*?)(?:{pattern})", 1)


def cut_at_end_marker(text: Column, bot_name: str = "Bot") -> Column:
    """Cut a reply at the first end marker, unless it opens the reply."""
    pattern = cfg.end_marker_pattern(bot_name)
    whole = f"(?d)^(?!(?:{pattern}))(?<head>{ANY}+?)(?:{pattern}){ANY}*"
    return F.regexp_replace(text, whole, "${head}")


def first_end_marker(text: Column, bot_name: str = "Bot") -> Column:
    """The first end marker itself, empty when there is none."""
    return F.regexp_extract(text, "(?d)" + cfg.end_marker_pattern(bot_name), 0)


def remove_end_markers(text: Column, bot_name: str = "Bot") -> Column:
    return F.regexp_replace(text, "(?id)" + cfg.end_marker_pattern(bot_name), "")


def has_end_marker(text: Column, bot_name: str = "Bot") -> Column:
    return text.rlike("(?id)" + cfg.end_marker_pattern(bot_name))


def split_at_end_marker(text: Column, bot_name: str = "Bot") -> Column:
    """Struct of head (picture prompt) and tail (message that follows it)."""
    pattern = cfg.end_marker_pattern(bot_name)
    head = _before(text, pattern)
    opening = F.regexp_extract(text, f"(?d)^(?:{pattern})", 0)
    cut = F.length(head) >= 3
    return F.struct(
        F.when(cut, head).when(opening != "", opening).otherwise(text).alias("head"),
        F.when(cut, F.substring(text, F.length(head) + 1, F.length(text))).otherwise("").alias("tail"),
    )


def tail_message(tail: Column, header: str) -> Column:
    """Message that follows the response header inside a tail; null when there is none."""
    at = F.instr(tail, header)
    body = F.replace(F.substring(tail, at, F.length(tail)), F.lit(header), F.lit(""))
    message = unescape(body)
    return F.when((at > 0) & (F.length(message) > 0), message)


def strip_tone_tag(text: Column) -> Column:
    return F.regexp_replace(text, cfg.TONE_TAG_PATTERN, "")


def keyword_list_clean(text: Column) -> Column:
    """Drop the request phrase, then all but letters, commas and white space."""
    return F.regexp_replace(
        F.regexp_replace(text, "(?d)" + cfg.PICTURE_REQUEST_PATTERN, ""), "[^a-zA-Z,\\s]+", ""
    )


def truncate_text(text: Column, limit: int) -> Column:
    return F.struct(
        F.left(text, F.lit(limit)).alias("text"), (F.length(text) > limit).alias("truncated")
    )


def ramble_ratio(raw: Column, kept: Column) -> Column:
    """Whole times that the raw reply is as long as the kept one, and the warning flag."""
    ratio = F.call_function("div", F.length(raw), F.nullif(F.length(kept), F.lit(0)))
    return F.struct(ratio.alias("ratio"), F.coalesce(ratio >= 1.5, F.lit(False)).alias("rambling"))


def strip_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, "\\s+", "")


def cut_at_stop_strings(text: Column, stops: Iterable[str] = cfg.STOP_STRINGS) -> Column:
    """Text before the first stop string."""
    alternatives = "|".join(quote(s) for s in stops)
    return F.regexp_extract(text, f"^({ANY}*?)(?:{alternatives}|\\z)", 1)


def attachment_note(name: Column, n_attachments: Column) -> Column:
    note = F.concat(F.lit("\n[System]: "), name, F.lit(" attached an image"))
    return F.when(n_attachments > 0, note).otherwise("")


def reply_prompt(lines: Column, conf: ChatConfig, second_backend: bool = False) -> Column:
    character = conf.second_character_prompt if second_backend else conf.character_prompt
    return F.concat(F.lit(character), lines, F.lit("\n" + conf.reply_header))


def verdict_prompt(lines: Column, conf: ChatConfig) -> Column:
    return F.concat(F.lit(conf.verdict_context), lines, F.lit("\n" + conf.verdict_question))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def drop_first_lines(lines: Column, n: int) -> Column:
    return F.slice(lines, F.lit(n + 1), F.greatest(F.size(lines) - n, F.lit(0)))


def drop_last_lines(lines: Column, n: int) -> Column:
    return F.slice(lines, F.lit(1), F.greatest(F.size(lines) - n, F.lit(0)))


def characters(text: Column) -> Column:
    """Array of the characters of a text."""
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def common_prefix_length(a: Column, b: Column) -> Column:
    """Length of the common prefix, without regard to case."""
    return _longest_equal(a, b, F.left)


def common_suffix_length(a: Column, b: Column) -> Column:
    return _longest_equal(a, b, F.right)


def _longest_equal(a: Column, b: Column, end) -> Column:
    """The largest n for which both ends of n characters agree, by halving."""
    shorter = F.least(F.length(a), F.length(b))

    def halve(range_: Column, _) -> Column:
        middle = F.call_function("div", range_["lo"] + range_["hi"] + 1, F.lit(2)).cast("int")
        same = F.lower(end(a, middle)) == F.lower(end(b, middle))
        return F.struct(
            F.when(same, middle).otherwise(range_["lo"]).alias("lo"),
            F.when(same, range_["hi"]).otherwise(middle - 1).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), shorter.alias("hi"))
    steps = F.sequence(F.lit(1), F.length(F.bin(shorter)))
    return F.aggregate(steps, start, halve)["lo"]


def local_time(ts: Column, zone: str) -> Column:
    """Clock time in a named zone of a UTC time."""
    return F.from_utc_timestamp(ts, zone)


def time_of_day(local: Column) -> Column:
    hour = F.hour(local)
    return (
        F.when(hour.between(5, 10), "Morning")
        .when(hour.between(11, 14), "Mid-day")
        .when(hour.between(15, 16), "Afternoon")
        .when(hour.between(17, 20), "Evening")
        .otherwise("Night")
    )
