"""Misspelled banned words: matching, masking and reporting.

Two ways lead to the same matches.  A short list is compared inside the row, so
no message is shuffled.  A long list goes through a dictionary of distinct
tokens, an equi join on deletion signatures, and a join back on the token.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.editdistance import is_within
from threadloom.functions.text import edit_threshold, normalize_token, trim_all

# --- inside the row -----------------------------------------------------------


def _matchable_lengths(words: Iterable[str]) -> list[int]:
    """Lengths that a cleaned token can have to be near any of the words."""
    reach = {w: range(max(len(w) - 2, 3), len(w) + 3) for w in words}
    return sorted(
        {
            n
            for w, lengths in reach.items()
            for n in lengths
            if abs(n - len(w)) <= (2 if n > 6 else 1 if n > 4 else 0)
        }
    )


def fuzzy_matches(text: Column, words: Iterable[str]) -> Column:
    """Array of (pos, token, word): every token near every banned word, in order.

    The whole text is cleaned at once: blanks stay, so the cleaned tokens keep
    their places, and the text is split once for all matches.  A check of the length
    passes over most of them.
    """
    lowered = [w.lower() for w in words if w]
    listed = F.array(*[F.lit(w) for w in lowered])
    cleaned = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", ""), " ")
    tokens = F.transform(cleaned, lambda c, i: F.struct(i.alias("pos"), c.alias("clean")))
    lengths = _matchable_lengths(lowered)
    checked = F.filter(tokens, lambda t: F.length(t["clean"]).isin(lengths))

    def near(t: Column) -> Column:
        threshold = edit_threshold(t["clean"])
        return F.transform(
            F.filter(listed, lambda w: is_within(t["clean"], w, threshold)),
            lambda w: F.struct(t["pos"].alias("pos"), w.alias("word")),
        )

    def with_tokens(found: Column) -> Column:
        return _bound(
            F.split(text, " "),
            lambda raw: F.transform(
                found, lambda m: F.struct(m["pos"].alias("pos"), F.get(raw, m["pos"]).alias("token"), m["word"].alias("word"))
            ),
        )

    none = F.array().cast("array<struct<pos:int,token:string,word:string>>")
    return _bound(F.flatten(F.transform(checked, near)), lambda m: F.when(F.size(m) == 0, none).otherwise(with_tokens(m)))


def _bound(value: Column, body) -> Column:
    """``body`` of a value worked out once."""
    return F.transform(F.array(value), body)[0]


def fuzzy_banned_match(
    df: DataFrame, text: str, words: Iterable[str], keep: Iterable[str]
) -> DataFrame:
    """One row per (message, token position, banned word)."""
    found = df.select(*keep, F.explode(fuzzy_matches(F.col(text), words)).alias("_m"))
    return found.select(*keep, "_m.pos", "_m.token", "_m.word")


def detected_tokens(matches: Column) -> Column:
    return F.transform(matches, lambda m: m["token"])


def detected_words(matches: Column) -> Column:
    """Detected raw tokens, each followed by a blank."""
    return F.array_join(F.transform(matches, lambda m: F.concat(m["token"], F.lit(" "))), "")


def mask_tokens(text: Column, tokens: Column, mask: str) -> Column:
    """Replace each token wherever it occurs, also inside words, in the given order;
    double blanks are closed up once after each.

    A token that was tried before is passed over unless the text has changed since, so
    that the texts read grow with the distinct tokens and not with all of them."""
    placed = F.transform(tokens, lambda t, i: F.struct(trim_all(t).alias("word"), i.alias("at")))
    by_word = F.array_sort(F.filter(placed, lambda x: F.length(x["word"]) > 2))

    def with_last_try(s: Column) -> Column:
        def of(x: Column, j: Column) -> Column:
            before = F.get(s, F.greatest(j - 1, F.lit(0)))
            again = (j > 0) & (before["word"] == x["word"])
            return F.struct(x["at"].alias("at"), F.when(again, before["at"]).otherwise(-2).alias("tried"), x["word"].alias("word"))

        return F.array_sort(F.transform(s, of))

    def step(state: Column, x: Column) -> Column:
        hidden = F.replace(F.replace(state["text"], x["word"], F.lit(mask)), F.lit("  "), F.lit(" "))
        tried = _bound(hidden, lambda h: F.struct(h.alias("text"), F.when(h == state["text"], state["changed"]).otherwise(x["at"]).alias("changed")))
        return F.when(x["tried"] > state["changed"], state).otherwise(tried)

    start = F.struct(text.alias("text"), F.lit(-1).alias("changed"))
    return F.aggregate(_bound(by_word, with_last_try), start, step, lambda state: state["text"])


def with_mask_fuzzy(
    df: DataFrame, text: str, words: Iterable[str], mask: str, out: str | None = None
) -> DataFrame:
    """Mask misspelled banned words.  The matches are a column of their own step, so
    that they are computed once per row."""
    words = tuple(words)
    if not words:
        return df.withColumn(out or text, F.col(text))
    hits = df.withColumn("_hits", fuzzy_matches(F.col(text), words))
    tokens = detected_tokens(F.col("_hits"))
    # A detected token has more than two characters, so any hit passes the gate.
    masked = F.when(F.size("_hits") > 0, mask_tokens(F.col(text), tokens, mask)).otherwise(F.col(text))
    return hits.withColumn(out or text, masked).drop("_hits")


# --- through a token dictionary -------------------------------------------------


def _deletions(token: Column, depth: Column) -> Column:
    """The token and all it becomes by deleting up to ``depth`` (0, 1 or 2) characters."""

    def one_less(t: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
            lambda i: F.concat(F.left(t, i - 1), F.substring(t, i + 1, F.length(t))),
        )

    first = one_less(token)
    second = F.flatten(F.transform(first, one_less))
    return F.array_distinct(
        F.when(depth == 0, F.array(token))
        .when(depth == 1, F.concat(F.array(token), first))
        .otherwise(F.concat(F.array(token), first, second))
    )


def match_dictionary(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """(clean, word) pairs of a table of distinct cleaned tokens and a table of words.

    Strings within k edits share one of their deletions of up to k characters,
    and the weighted distance is never below the plain one, so none is missed.
    Tokens of a length that no word can match are dropped first.
    """
    lowered = words.select(F.lower("word").alias("word")).where("word <> ''").distinct()
    lengths = lowered.select(
        F.explode(F.sequence(F.length("word") - 2, F.length("word") + 2)).alias("_len")
    ).distinct()
    checked = (
        tokens.withColumn("_thr", edit_threshold(F.col("clean")))
        .where("_thr IS NOT NULL")
        .withColumn("_len", F.length("clean"))
        .join(lengths, "_len", "left_semi")
    )
    left = checked.select("clean", "_thr", F.explode(_deletions(F.col("clean"), F.col("_thr"))).alias("_sig"))
    depths = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("_thr")
    right = lowered.select("word", depths).select(
        "word", "_thr", F.explode(_deletions(F.col("word"), F.col("_thr"))).alias("_sig")
    )
    pairs = left.join(right, ["_thr", "_sig"]).select("clean", "word", "_thr").distinct()
    return pairs.where(is_within(F.col("clean"), F.col("word"), F.col("_thr"))).select("clean", "word")


def fuzzy_banned_match_large(
    df: DataFrame, text: str, words: DataFrame, keep: Iterable[str]
) -> DataFrame:
    """``fuzzy_banned_match`` for a list too long for the row."""
    keep = list(keep)
    tokens = (
        df.select(*keep, F.posexplode(F.split(text, " ")).alias("pos", "token"))
        .withColumn("clean", normalize_token(F.col("token")))
        .where(F.length("clean") > 2)
    )
    # The distinct is combined on the map side: a hot token is shuffled once per task.
    dictionary = match_dictionary(tokens.select("clean").distinct(), words)
    return tokens.join(dictionary, "clean").select(*keep, "pos", "token", "word")


def moderation_report(matches: DataFrame, channel: str, author: str) -> DataFrame:
    """Hits and offenders per channel and banned word."""
    return matches.groupBy(channel, "word").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct(author).alias("authors")
    )
