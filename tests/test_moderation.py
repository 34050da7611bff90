"""Misspelled banned words against a plain double loop."""

import random
import re

from pyspark.sql import functions as F
from test_distance import plain

from threadloom.operators import moderation


def search(text, words):
    out = []
    for pos, token in enumerate(text.split(" ")):
        c = re.sub("[^a-zA-Z0-9]+", "", token.lower())
        t = 2 if len(c) > 6 else 1 if len(c) > 4 else 0
        out += [(pos, token, w) for w in words if len(c) > 2 and plain(c, w) <= t]
    return out


def test_both_ways_match_a_double_loop(spark):
    rng = random.Random(5)
    words = ["abab", "babba", "abcabca", "ab1ab1ab", "cc1"]
    texts = [" ".join("".join(rng.choices("aAbc1.", k=rng.randint(0, 9))) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    texts += [" ".join(words), "", "abcabca " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    want = sorted((i, *m) for i, t in enumerate(texts) for m in search(t, words))
    inline = moderation.fuzzy_banned_match(df, "text", words, ["id"])
    assert sorted(map(tuple, inline.collect())) == want
    listed = spark.createDataFrame([(w,) for w in words], "word string")
    joined = moderation.fuzzy_banned_match_large(df, "text", listed, ["id"])
    assert sorted(map(tuple, joined.select("id", "pos", "token", "word").collect())) == want
    ordered = df.select("id", moderation.detected_words(moderation.fuzzy_matches(F.col("text"), words)).alias("d"))
    for r in ordered.collect():
        assert r.d == "".join(m[1] + " " for m in search(texts[r.id], words))


def test_masks_are_idempotent(spark):
    df = spark.createDataFrame([("a badword, badwordish b1ocked",), ("x  y",)], "t string")
    once = moderation.with_mask_fuzzy(df, "t", ["badword", "blocked"], "****")
    twice = moderation.with_mask_fuzzy(once, "t", ["badword", "blocked"], "****")
    rows = [r[0] for r in once.collect()]
    assert rows == [r[0] for r in twice.collect()] == ["a **** badwordish ****", "x  y"]


def test_masking_is_that_of_every_hit_in_turn(spark):
    """Repeated hits count only where the text has changed: as if each were replaced again."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        text = " " * rng.randrange(2) + "".join(rng.choices(["aab", "aba", "baa", "ab", "b", " ", "  ", "*", "abab"], k=rng.randrange(30)))
        tokens = [rng.choice(["aab", "aba", " baa ", "*ab", "ab", "abab", "**b"]) for _ in range(rng.randrange(9))]
        rows.append((i, text, tokens))
    df = spark.createDataFrame([*rows, (400, None, ["aab"]), (401, "aab", None)], "id int, t string, h array<string>")
    for mask in ("", "**", "a"):
        for r in df.select("*", moderation.mask_tokens(F.col("t"), F.col("h"), mask).alias("out")).collect():
            want = r.t
            for token in r.h or []:
                word = token.strip()
                if want is not None and len(word) > 2:
                    want = want.replace(word, mask).replace("  ", " ")
            assert r.out == (None if r.h is None else want)


def test_a_text_of_very_many_hits(spark):
    df = spark.createDataFrame([("b4dword badword " * 16_000,)], "t string")
    got = moderation.with_mask_fuzzy(df, "t", ["badword"], "****").first().t
    assert got == "**** " * 32_000
