"""Quality rules: a table of thresholds compiled into one projection.

No user function, no shuffle, no aggregate: each document is judged from its own
row.  The costliest figure, words in repeated 8-word windows, hashes each window
once and sorts the hashes only where two of them are equal, so that it stays
below n log n in a text of any length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import SPACES, let, own_names, words

WINDOW = 8

#: Frequent small words of four languages, in lower case: prose has some of them.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "was",
    "der", "die", "das", "und", "ist", "den", "mit", "nicht", "von", "ein",
    "le", "la", "les", "de", "des", "et", "une", "est", "que", "pour",
    "el", "los", "las", "del", "y", "en", "por", "con", "se", "su",
)


@dataclass(frozen=True)
class Rule:
    """``figure`` must lie within [low, high]; None leaves a side open."""

    name: str
    figure: str
    low: float | None = None
    high: float | None = None


#: Refuses what nobody would call prose; each limit stands well away from it.
RULES = (
    Rule("word_length", "chars_per_word", 2.0, 15.0),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("stop_words", "stop_word_share", 0.02, None),
    Rule("repeated_lines", "dup_line_share", None, 0.5),
)


def repeated_window_words(w: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the array ``w``."""

    def in_repeats(hashes: Column) -> Column:
        def starts(s: Column) -> Column:
            kept = F.filter(s, lambda e, i: F.get(s, i - 1)["h"].eqNullSafe(e["h"]) | F.get(s, i + 1)["h"].eqNullSafe(e["h"]))
            return F.sort_array(F.transform(kept, lambda e: e["i"]))

        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        covered = lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )
        return let(let(by_hash, starts), covered)

    none = F.lit(0).cast("long")

    def of_hashes(h: Column) -> Column:
        # Not slice(): it copies the whole array for each window.
        windows = F.transform(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
        )
        return let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(in_repeats(g)))

    return F.when(F.size(w) <= WINDOW, none).otherwise(let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes))


def figures(text: Column, stop_words=STOP_WORDS) -> Column:
    """A struct of counts of one text (null counts as empty)."""
    text = F.coalesce(text, F.lit(""))

    def of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.char_length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(
                F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
                lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
            ).alias("lines"),
            repeated_window_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(*stop_words))).cast("long").alias("n_stop_words"),
        )

    return let(words(text), of)


def verdicts(f: Column, rules=RULES) -> Column:
    """Names of the rules that the figures ``f`` break."""
    per_word = lambda c: c / F.greatest(f["n_words"], F.lit(1))
    values = {
        "n_words": f["n_words"].cast("double"),
        "chars_per_word": per_word(f["word_chars"]),
        "symbols_per_word": per_word(f["n_symbols"]),
        "stop_word_share": per_word(f["n_stop_words"]),
        "repeat_word_share": per_word(f["n_repeat_words"]),
        "dup_line_share": f["lines"]["dup"] / F.greatest(f["lines"]["n"], F.lit(1)),
    }

    def broken(rule: Rule) -> Column:
        x = values[rule.figure]
        low = F.lit(False) if rule.low is None else x < rule.low
        high = F.lit(False) if rule.high is None else x > rule.high
        return F.when(low | high, F.lit(rule.name))

    return F.array_compact(F.array(*map(broken, rules)))


@own_names
def quality_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """All columns of ``docs`` and the counts, base_failed, broken_rules, kept.

    A null or empty text has no words and fails.  Rows are independent: ids may
    be null or repeated, an empty table gives an empty one.  Columns of ``docs`` with
    the names of the new ones give way.
    """

    def judged(f: Column) -> Column:
        base = (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])
        verdict = let(verdicts(f, rules), lambda v: F.struct(v.alias("broken_rules"), (~base & (F.size(v) == 0)).alias("kept")))
        return let(
            verdict,
            lambda v: F.struct(
                *[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")],
                f["lines"]["dup"].alias("n_dup_lines"),
                f["n_repeat_words"].alias("n_repeat_words"),
                base.alias("base_failed"),
                v["broken_rules"].alias("broken_rules"),
                v["kept"].alias("kept"),
            ),
        )

    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "broken_rules", "kept")
    # One value for figures and verdict: a filter on kept reads a field of it, and does not
    # bring a copy of the figures for each rule.
    out = docs.drop(*made)
    # What reads several fields of it gets it by way of an array, which is not taken apart.
    return out.select("*", F.inline(F.array(let(figures(F.col(text)), judged)))).select(*[f"`{c}`" for c in out.columns], *made)
