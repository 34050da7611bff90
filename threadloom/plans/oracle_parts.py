"""Pieces of SQL that the oracle texts share (DuckDB dialect)."""

from __future__ import annotations

from threadloom import config as cfg
from threadloom.config import ChatConfig
from threadloom.sources.derived import CHANNELS_SQL, MESSAGES_SQL, USERS_SQL

# Neutral word lists, so that the tests can be read aloud.
TEST = ChatConfig(
    fuzzy_words=("badword", "blocked", "thtion", "retion", "mente"),
    exact_words=("blocked", "thing"),
    exact_picture_words=("tea",),
    owner_id=1,
)

# Letters of the test texts outside ASCII, and bytes that stand in for them
# where an SQL engine compares bytes.
ACCENTED = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü’"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = lit(" \t\n\r")
M = f"m AS ({MESSAGES_SQL})"
USERS = f"users AS ({USERS_SQL})"
CHANNELS = f"channels AS ({CHANNELS_SQL})"


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, '{flags}')"


def spoof(x: str) -> str:
    return sub(x, cfg.SPOOF_PATTERN)


def exact(x: str, mask: str = "****", words=TEST.exact_words) -> str:
    """Whole words, with letters of any script as word characters.

    The neighbours are part of the match, so words that share one need a second pass.
    """
    edge = r"[^\p{L}\p{N}_]"
    pattern = f"(^|{edge})(?:{'|'.join(words)})({edge}|$)"
    to = "\\1" + mask + "\\2"
    return sub(sub(x, pattern, to), pattern, to)


def clean(x: str) -> str:
    return sub(x, "[^a-zA-Z0-9]+")


def nz(x: str) -> str:
    """Clean user name with its fallback."""
    return f"CASE WHEN length({clean(x)}) < 1 THEN 'User' ELSE {clean(x)} END"


LINE = f"'[' || role || ']: ' || {trim(spoof('replace(content, chr(10), chr(32))'))}"
L = f"{M}, l AS (SELECT *, {LINE} AS line FROM m)"


def table_distance(s: str, t: str) -> str:
    """Weighted distance by the full table."""
    letter = lit(r"^\p{L}$")
    cost = (
        f"CASE WHEN {s}[i] = {t}[j] THEN 0 WHEN regexp_matches({s}[i], {letter}) = "
        f"regexp_matches({t}[j], {letter}) THEN 1 ELSE 2 END"
    )
    return (
        f"list_reduce(range(1, length({s}) + 1), lambda p, i: list_reduce(range(1, length({t}) + 1), "
        f"lambda r, j: list_append(r, least(r[j] + 1, p[j + 1] + 1, p[j] + {cost})), [p[1] + 1]), "
        f"range(0, length({t}) + 1))[-1]"
    )


def weighted(s: str, t: str) -> str:
    return f"CASE WHEN {s} = '' OR {t} = '' OR {s} = {t} THEN 0 ELSE {table_distance(s, t)} END"


WORDS = (
    "words(wpos, word) AS (VALUES "
    + ", ".join(f"({i}, {lit(w)})" for i, w in enumerate(TEST.fuzzy_words))
    + ")"
)


def fuzzy(source: str, key: str, text: str) -> str:
    """CTEs: toks, hits (key, pos, wpos, token, word), det (key, tokens, joined)."""
    return f"""{WORDS},
toks AS (SELECT {key}, token, pos, {clean('lower(token)')} AS c FROM
  (SELECT {key}, unnest(string_split({text}, ' ')) AS token,
          unnest(range(0, len(string_split({text}, ' ')))) AS pos FROM {source})),
cand AS (SELECT DISTINCT c FROM toks WHERE length(c) > 2),
near AS (SELECT c, word, wpos FROM
  (SELECT c, word, wpos, CASE WHEN length(c) > 6 THEN 2 WHEN length(c) > 4 THEN 1 ELSE 0 END AS t
   FROM cand CROSS JOIN words)
  WHERE abs(length(c) - length(word)) <= t AND levenshtein(c, word) <= t
    AND {weighted('c', 'word')} <= t),
hits AS (SELECT {key}, pos, wpos, token, word FROM toks JOIN near USING (c)),
det AS (SELECT {key}, list(token ORDER BY pos, wpos) AS tokens,
               string_agg(token || ' ', '' ORDER BY pos, wpos) AS joined FROM hits GROUP BY {key})"""


def masked(text: str, mask: str) -> str:
    """Mask with the tokens of ``det`` (joined from the left)."""
    w = f"trim(w, {WS})"
    step = (
        f"CASE WHEN length({w}) > 2 THEN replace(replace(s, {w}, {lit(mask)}), '  ', ' ') ELSE s END"
    )
    return (
        f"CASE WHEN tokens IS NULL THEN {text} ELSE list_reduce(tokens, lambda s, w: {step}, {text}) END"
    )


END = cfg.end_marker_pattern("Bot")


def cut(x: str) -> str:
    head = f"regexp_extract({x}, {lit('^((?s:.)*?)(?:' + END + ')')}, 1)"
    return f"CASE WHEN {head} <> '' THEN {head} ELSE {x} END"
