"""Golden rows of the text functions."""

import pytest
from pyspark.sql import functions as F

from threadloom.config import ChatConfig
from threadloom.functions import jsonio
from threadloom.functions import text as tx
from threadloom.operators import gate, loops, moderation, pictures


def check(spark, fn, cases):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]
    assert got == [y for _, y in cases]


CASES = [
    (tx.strip_spoof_headers, [("[Bob]: hi", " hi"), ("[a::x", "x"), ("x :] y", "x  y"), ("[^]]", "[^]]")]),
    (
        tx.redact_links,
        [
            ("go to example.com/foo bar baz!", "go to exampl<url>!"),
            ("see example dot com slash foo ok", "see exampl<url>"),
            ("and/or, yes/no", "and/or, yes/no"),
            ("a.b/cc\nd", "<url>\nd"),
            ("a.b/c\rd", "<url>"),
        ],
    ),
    (tx.strip_tone_tag, [("(smiles) hi", " hi"), ("[happy] hi", " hi"), ("hi (there)", "hi (there)")]),
    (tx.clean_username, [("***", "User"), ("D 1!", "D1"), ("é", "User")]),
    (tx.strip_control, [("a\u0001b\nc", "abc")]),
    (
        lambda c: tx.mask_words(c, ("ass",)),
        [("ASS", "ASS"), ("ass!", "****!"), ("éass", "éass"), ("class ass", "class ****")],
    ),
    (tx.trim_all, [("  a　\n", "a"), (" ", "")]),
    (
        tx.unescape,
        [
            ("a\\nb", "a\nb"), ("\\\\n", "\\n"), ("\\u00e9", "é"), ("\\ud83d\\ude00", "😀"), ("\\ud83d x", "\\ud83d x"),
            ("\\x41\\.", "A."), ("\\q", "\\q"), ("end\\", "end\\"), ("plain", "plain"), ("\\cA\\e", "\x01\x1b"),
        ],
    ),
    # A backtick keeps its doubled backslash for good; the passes end all the same.
    (tx.soften_symbols, [("{x}", "{x}"), ("a\\\\b{c}“d”", "a\\bc'd'"), ("\\\\\\\\`", "\\\\`")]),
    (tx.escape_symbols, [('{a} "b" `c` $5 “d” ’', '\\{a\\} \\"b\\" \\`c\\` 5 \\"d\\" \'')]),
    (tx.cut_at_end_marker, [("hi\n[x", "hi"), ("]: hi", "]: hi"), ("a</s>b", "a"), ("a [b]: c", "a "), ("plain", "plain")]),
    (tx.remove_end_markers, [("hi<END>x BOT]: y", "hi>x  y")]),
    (
        lambda c: F.concat_ws("|", tx.split_at_end_marker(c)["head"], tx.split_at_end_marker(c)["tail"]),
        [("abc\n# x", "abc|\n# x"), ("ab\n# x", "ab\n# x|"), ("\n#x", "\n#|"), ("none", "none|")],
    ),
    (tx.cut_at_stop_strings, [("a</s>b", "a"), ("\n[x", ""), ("abc", "abc"), ("", "")]),
    (
        lambda c: tx.tail_message(c, "### Response:\n[Bot]:"),
        [("x### Response:\n[Bot]:hi\\n", "hi\n"), ("nothing", None), ("### Response:\n[Bot]:", None)],
    ),
    (lambda c: tx.strip_bot_callouts(c, "B.t"), [("B.t? hi B.t, x B.t", " hi  x "), ("Bat? hi", "Bat? hi")]),
    (tx.first_line, [("a\r\nb", "a"), ("", "")]),
    (tx.keyword_list_clean, [("take a nice pic tea, milk 5!", " tea, milk ")]),
    (jsonio.affirmative, [("No", False), ("Yes", True), ("any", True)]),
    (
        jsonio.extract_token,
        [('{"response":"hi \\n","done":"0"}', "hi \n"), ('{"response":"","done":"0"}', ""), ("junk", None),
         ('{"response":"open', None)],
    ),
    (lambda c: jsonio.parse_choices(c)["text"], [('{"choices":[{"text":"hi"}]}', "hi"), ("", None), ("{bad", None)]),
    (
        lambda c: jsonio.parse_candidates(c)["status"],
        [
            ('{"candidates":[{"content":{"parts":[{"text":"Yes"}]}}]}', "ok"), ('{"promptFeedback":{}}', "blocked"),
            ('{"error":1}', "malformed"), ("{bad", "malformed"),
        ],
    ),
    (pictures.picture_request, [("Take a\n nice Picture", True), ("take\\na pic", False), ("a picture", False)]),
    (lambda c: loops.degenerate_reply(c, F.lit("")), [("word", True), ("two words", False), ("", True), ("...", False)]),
    (lambda c: loops.degenerate_reply(c, F.lit("x"), True), [("...", True), ("a.", False)]),
    (
        lambda c: moderation.mask_tokens(c, F.array(F.lit("bad\n"), F.lit("bad"), F.lit("ab")), ""),
        [("so bad day, badly ab", "so day, ly ab")],
    ),
]


@pytest.mark.parametrize("fn,cases", CASES)
def test_golden(spark, fn, cases):
    check(spark, fn, cases)


def test_affixes(spark):
    rows = [
        ("lol hey there", "lol hello there", 6, 7),
        ("a", "a", 0, 0),
        ("same", "same", 3, 3),
        ("", "x", 0, 0),
        ("Hello", "help", 3, 0),
    ]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "cur string, prev string")
    got = loops.with_trimmed_affixes(df, "cur", "prev").collect()
    for g, (cur, prev, cut, tail) in zip(got, rows):
        assert g.prefix_cut == cut, cur
        expected = trimmed_by_steps(cur, prev)
        assert g.trimmed == expected, cur


def trimmed_by_steps(cur, prev):
    """Letter by letter, as a reader would do it."""
    if not cur or not prev:
        return cur
    out, first = cur, 1
    if cur[:1].lower() == prev[:1].lower():
        while first < len(cur) and first < len(prev) and cur[:first].lower() == prev[:first].lower():
            first += 1
        out = cur[first - 1 :]
    last = 0
    while last < len(cur) and last < len(prev) and cur[len(cur) - last :].lower() == prev[len(prev) - last :].lower():
        last += 1
    last -= 1
    if len(cur) - last > len(prev) - first:
        out = cur[: len(cur) - last]
    return out


def test_affixes_at_random(spark):
    import random

    rng = random.Random(1)
    pairs = [("".join(rng.choices("aAb", k=rng.randint(0, 6))), "".join(rng.choices("aAb", k=rng.randint(0, 6)))) for _ in range(400)]
    df = spark.createDataFrame(pairs, "cur string, prev string")
    got = {(r.cur, r.prev): r.trimmed for r in loops.with_trimmed_affixes(df, "cur", "prev").collect()}
    assert got == {p: trimmed_by_steps(*p) for p in pairs}


def test_time_of_day(spark):
    hours = [4, 5, 11, 15, 17, 21]
    df = spark.createDataFrame([(h, f"2024-01-01 {h:02d}:30:00") for h in hours], "h int, t string")
    got = [r[0] for r in df.orderBy("h").select(tx.time_of_day(F.col("t").cast("timestamp"))).collect()]
    assert got == ["Night", "Morning", "Mid-day", "Afternoon", "Evening", "Night"]


def test_log_filter(spark):
    rows = [("Heartbeat ok", "boom"), ("GET x", None), ("fine", "boom"), (None, "only"), (None, None)]
    got = gate.log_filter(spark.createDataFrame(rows, "message string, exception string"))
    assert sorted(r.text for r in got.collect()) == ["boom", "fine", "only"]


def test_picture_plan(spark):
    cases = [
        ("a selfie holding tea", True, ", looking into the camera, , holding "),
        ("photo of you with a cat", True, ""),
        ("photo of a dog", False, ""),
        ("pic", False, ""),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "q string")
    got = df.select(pictures.picture_intent(F.col("q"), F.lit("a cat")).alias("i")).select("i.*").collect()
    assert [(g.selfie, g.format) for g in got] == [c[1:] for c in cases]
    plan = spark.range(1).select(
        pictures.picture_plan(F.lit(True), F.lit(""), F.lit("cat"), F.lit(0), F.lit(None), F.lit(None)).alias("p")
    ).first().p
    assert (plan.width, plan.height, plan.endpoint, plan.hr_resize_y) == (688, 768, "txt2img", 1536)


def test_default_lists_do_not_catch_everything(spark):
    conf = ChatConfig()
    texts = ["h3ntai", "hentai", "hentau", "ordinary text"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    hits = [r[0] for r in df.select(F.size(moderation.fuzzy_matches(F.col("x"), conf.fuzzy_words))).collect()]
    assert hits == [1, 0, 0, 0]
