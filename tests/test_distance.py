"""Weighted edit distance against a plain table, on random texts."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import editdistance as ed


def plain(a, b):
    if not a or not b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            cost = 0 if x == y else 1 if x.isalpha() == y.isalpha() else 2
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + cost)
    return row[-1]


texts = st.text(alphabet="abé1. ", max_size=12)


@given(texts, texts)
@settings(max_examples=300, deadline=None)
def test_python_part(a, b):
    want = plain(a, b)
    assert ed.distance(a, b) == want == ed.distance(b, a)
    for limit in (1, 2, 4):
        assert (ed.distance(a, b, limit) < limit) == (want < limit)


@given(st.lists(st.tuples(texts, texts, st.integers(0, 9)), max_size=40), st.sampled_from([1, 64, ed.CELLS]))
@settings(max_examples=200, deadline=None)
def test_many_pairs_at_once(triples, cells):
    """Whatever the pairs that share an array, each gets its own distance."""
    xs, ys, limits = ([t[i] for t in triples] for i in range(3))
    whole, ed.CELLS = ed.CELLS, cells
    try:
        got, exact = ed.distances(xs, ys, limits), ed.exact_distances(xs, ys)
    finally:
        ed.CELLS = whole
    want = [plain(a, b) for a, b in zip(xs, ys)]
    assert exact.tolist() == want
    assert got.tolist() == [min(w, limit) for w, limit in zip(want, limits)]


def test_long_pairs():
    a = "the cat 1 sat. " * 150
    changed = a[:700] + "7" + a[701:1500] + a[1504:] + "zz"
    assert ed.distance(a, changed) == plain(a, changed) == ed.distance(changed, a)
    assert ed.distance(a, changed, 3) == 3 and ed.distance(a, "q" * 10) == plain(a, "q" * 10)


def test_first_closer_than(spark):
    rows = [("hello", ["jelly", "hello there", "hallo", "hello"], 2), ("x", [], 3), (None, ["x"], 2), ("x", None, 2), ("abc", ["zzz"], None), ("abc", ["", "abc"], 1), ("abc", ["abd"], 0)]
    df = spark.createDataFrame(rows, "t string, o array<string>, n int")
    got = [r.i for r in df.select(ed.first_closer_than("t", "o", "n").alias("i")).collect()]
    assert got == [2, None, None, None, None, 0, None]


@given(st.lists(st.tuples(texts, texts), min_size=20, max_size=60))
@settings(max_examples=5, deadline=None)
def test_native(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        "a", "b",
        ed.weighted_levenshtein(a, b).alias("d"),
        ed.weighted_levenshtein_long(a, b).alias("long"),
        F.levenshtein(a, b).alias("built_in"),
        *[ed.is_within(a, b, F.lit(t)).alias(f"within{t}") for t in (0, 1, 2)],
    ).collect()
    for r in rows:
        want = plain(r.a, r.b)
        assert r.d == r.long == want
        if r.a and r.b:
            assert r.built_in <= want <= 2 * r.built_in
            assert [r.within0, r.within1, r.within2] == [want <= t for t in (0, 1, 2)]


def test_golden(spark):
    pairs = [("h3ntai", "hentai", 2), ("abc", "a1c", 2), ("kitten", "sitting", 3), ("p0rn", "porn", 2), ("", "x", 0), ("ab1", "ab2", 1)]
    df = spark.createDataFrame(pairs, "a string, b string, want int")
    ed.register(spark)
    df.createOrReplaceTempView("pairs")
    for r in spark.sql("SELECT *, weighted_levenshtein(a, b) AS d FROM pairs").collect():
        assert r.d == r.want
