"""Small tables with a case each: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_catalog import base_spans

from threadloom.llm import pii
from threadloom.llm.common import join_uneven, words
from threadloom.llm.decontaminate import benchmark_overlaps, decontaminated
from threadloom.llm.licenses import BASE, TEMPLATES, Template, license_scan
from threadloom.llm.line_dedup import LEAST_BITS, MOST_BITS, filter_bits_for, line_dedup
from threadloom.llm.mixing import mix_sources
from threadloom.llm.near_dedup import components, near_dedup, shingle_set
from threadloom.llm.quality_model import BUCKETS, Features, ShapeHashes, fit, quality_scores
from threadloom.llm.quality_rules import quality_rules
from threadloom.llm.substring_dedup import substring_dedup
from threadloom.llm.url_filters import trie_of, url_filters, walk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, **ids):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and"]) if r.random() < 0.3 else f"w{r.randrange(5000)}" for _ in range(n))


ODD = [None, "", " \t\n ", "x", prose(1, 30_000), "é" * 50_000, "a " * 3000, "\x00\x1f  kept"]
OPERATORS = {
    "quality_rules": quality_rules,
    "line_dedup": line_dedup,
    "near_dedup": near_dedup,
    "license_scan": license_scan,
    "mix_sources": mix_sources,
    "substring_dedup": substring_dedup,
    "find_pii": lambda d: pii.find_pii(d, pii.fit(d)),
    "quality_scores": lambda d: quality_scores(d, fit(d, d.select("doc_id", F.lit(1).alias("label")))),
    "overlaps": lambda d: benchmark_overlaps(d, d.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 200).alias("text"))),
    "decontaminated": lambda d: decontaminated(d, d.select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 200).alias("text"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    rows = [(i, t, None, None if i % 2 else "s", None) for i, t in enumerate(ODD)]
    rows += [(None, prose(2, 50), None, "s", 1), (None, None, None, None, None), (3, "x", "en", "s", 1), (3, "other", "en", "t", 1)]
    got = OPERATORS[name](spark.createDataFrame(rows, SCHEMA)).collect()
    if name not in ("overlaps", "decontaminated"):
        assert len(got) == len(rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", ["quality_rules", "line_dedup", "license_scan", "mix_sources", "substring_dedup", "find_pii"])
def test_clashing_columns_give_way(spark, name):
    plain = docs(spark, prose(1, 60), prose(2, 60) + "\n" + prose(1, 60))
    made = [c for c in OPERATORS[name](plain).columns if c not in plain.columns]
    clashing = plain.withColumns({c: F.lit("old") for c in made}).withColumn("extra", F.lit(7))
    got = OPERATORS[name](clashing)
    assert sorted(got.columns) == sorted([*plain.columns, "extra", *made])
    assert all("old" not in [r[c] for c in made] for r in got.collect())


CLASHING = "_text _id _key _here _last _drops _hits _found _rest _base _figures _doc _item _set _bands _root _TEXT2 _p _order".split()


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_of_internal_names(spark, name):
    """Input columns with the names that operators use inside come through unchanged."""
    plain = docs(spark, prose(1, 60), prose(2, 60) + "\n" + prose(1, 60), None)
    clashing = plain.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    want = sorted(map(tuple, OPERATORS[name](plain).collect()), key=repr)
    out = OPERATORS[name](clashing)
    extra = [c for c in out.columns if c in CLASHING]
    if name not in ("near_dedup", "quality_scores", "overlaps"):
        assert extra == CLASHING
    assert sorted(map(tuple, out.drop(*CLASHING).collect()), key=repr) == want
    assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in extra)


def test_mixing_with_a_source_without_words(spark):
    rows = [(0, "a b c d", "", "s", 0), (1, None, "", "t", 0), (2, "", "", "t", 0), (3, " ", "", None, 0)]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.size, r.source_size) for r in got} == {(0, 4, 4), (1, 0, 0), (2, 0, 0), (3, 0, 0)}
    assert all(r.taken == r.target == 0 for r in got if r.doc_id) and {r.taken for r in got if r.doc_id == 0} == {4}
    for texts in ([None, ""], []):
        assert [r.taken for r in mix_sources(docs(spark, *texts)).collect()] == [0] * len(texts)


def test_mixing_prefers_long_documents_and_meets_its_targets(spark):
    """Inclusion probabilities differ within a source; the words taken stay near the target."""
    rows = [(i, "w " * (5 if i % 2 else 400), "", "s" if i % 3 else "t", 0) for i in range(6000)]
    mixed = mix_sources(spark.createDataFrame(rows, SCHEMA), weights=(1, 2), share=0.7).withColumn("long", F.col("size") > 100)
    per_source = mixed.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 400 for r in per_source)
    share = {(r.source, r.long): r.share for r in mixed.groupBy("source", "long").agg(F.avg("copies").alias("share")).collect()}
    for source in "st":
        short, long = share[source, False] % 1, share[source, True] % 1
        assert short < long < 2 * short


URL_TABLE = "page_id long, url string, _found string, _rest string, host string"


def test_url_filters_on_odd_rows(spark):
    long = "http://a.com/" + "x/" * 200_000
    rows = [(1, long, "f", "r", "old"), (1, long, "f", "r", "old"), (None, None, None, None, None), (2, "http://" + "b." * 5000 + "a.com", "f", "r", "old")]
    got = url_filters(spark.createDataFrame(rows, URL_TABLE), RULES).collect()
    assert len(got) == 4 and {r.rule for r in got} == {"a.com", None} and {r._found for r in got} == {"f", None}
    assert url_filters(spark.createDataFrame([], URL_TABLE), RULES).collect() == []


def test_longest_rule_counts_host_and_path(spark):
    rules = [("block", "com", "/verylongpath/"), ("allow", "example.com", "/"), ("block", "b.example.com", "/x"), ("allow", "example.com", "/x/y")]
    root = trie_of(rules)
    assert walk(root, "example.com", "/verylongpath/a") == ("block", "com/verylongpath/")
    assert walk(root, "example.com", "/other") == ("allow", "example.com/")
    assert walk(root, "b.example.com", "/x/y") == ("block", "b.example.com/x")  # as long, with the longer host
    assert walk(root, "b.example.com", "/") == ("allow", "example.com/")
    r = random.Random(3)
    rules = [(r.choice(["allow", "block"]), r.choice(["com", "a.com", "b.a.com", "b.com"]), r.choice(["", "/", "/a", "/a/", "/ab", "/a/b", "/abcdef"])) for _ in range(14)]
    rules = list({rule[1:]: rule for rule in rules}.values())
    root = trie_of(rules)
    for host in ("com", "a.com", "b.a.com", "b.com", "c.b.com", "org"):
        for path in ("", "/", "/a", "/a/", "/a/b", "/abc", "/abcdefg", "/a/bc/"):
            fits = [(len(h + p), len(h), (v, h + p)) for v, h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
            assert walk(root, host, path) == (max(fits)[2] if fits else None)


def test_filter_on_kept_works_figures_out_once(spark):
    """The symbol pattern stands once in the plan, however many rules read its count."""
    kept = quality_rules(docs(spark, "x")).where("kept").select("doc_id", "text")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("#*$%&|") == 1


def test_line_dedup(spark):
    d = docs(spark, "A shared line here\nown one zero zero", "  a SHARED line here \nshort\nshort", None, "short\nÀ shared line here", "own line own line\nown line own line")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(d, filter_bits=1 << 19).collect()}
    assert got == {
        0: ("A shared line here\nown one zero zero", 2, 0),
        1: ("short\nshort", 3, 1),
        2: (None, 1, 0),
        3: ("short\nÀ shared line here", 2, 0),
        4: ("own line own line\nown line own line", 2, 0),
    }


def test_filter_bits_go_by_the_number_of_lines(spark):
    assert filter_bits_for(docs(spark, None, "", "a"), "text") == LEAST_BITS == filter_bits_for(docs(spark), "text")
    many = spark.range(100).select(F.repeat(F.lit("a\n"), 30_000).alias("text"))  # 3,000,100 lines
    assert filter_bits_for(many, "text") == 1 << 25 and LEAST_BITS < 1 << 25 < MOST_BITS


def test_join_uneven(spark, tmp_path):
    """Hot keys by broadcast, the others by shuffling: the rows of a plain join."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 1500)).alias("key"), "id")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    values = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("key <> 'k7'")
    got = join_uneven(rows, values, "key", "n", F.concat("key", F.lit("#"), "id"), 100).select("key", "id", "n", "first")
    want = rows.join(values, "key").select("key", "id", "n", "first")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_line_dedup_is_exact_with_a_full_filter(spark):
    d = spark.createDataFrame([(i, "\n".join(f"line number {j} of all" for j in range(i, i + 40)), "", "s", 0) for i in range(0, 400, 20)], SCHEMA)
    small, large = (line_dedup(d.repartition(5), filter_bits=b).orderBy("doc_id").collect() for b in (1 << 19, 1 << 23))
    assert small == large and sum(r.n_dropped for r in small) == 19 * 20


def brute_components(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def test_near_dedup_on_a_star_of_edits(spark):
    """Copies of one text, each edited elsewhere: many are linked only by way of others."""
    r = random.Random(5)
    base = prose(9, 150).split()
    texts = {}
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    texts |= {200 + i: t for i, t in enumerate(["a b c", "A b  c", "a b", "", "a b c d e f", "a b c d e g"])}
    got = near_dedup(spark.createDataFrame([(i, t, "", "", 0) for i, t in texts.items()], SCHEMA)).collect()
    want = brute_components(texts)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(shingle_set(texts[r.doc_id])) for r in got)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(1, 201)} | {(501, 500)}


def test_decontamination_takes_changed_words(spark):
    item = prose(3, 40)
    w = item.split()
    changed = " ".join("other" if i % 8 == 3 else x for i, x in enumerate(w))
    d = docs(spark, prose(4, 100) + " " + item.upper() + " end", "start " + changed, prose(5, 200), " ".join(w[:11]), " ".join(w[:13]))
    items = spark.createDataFrame([(7, item), (8, "too short"), (None, item), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in benchmark_overlaps(d, items).collect()}
    assert {(a, b) for a, b, _ in got} == {(0, 7), (1, 7), (4, 7)} and (0, 7, 40) in got
    assert got == {tuple(r)[:3] for r in benchmark_overlaps(d, items, broadcast_seeds=0).collect()}
    assert {r.doc_id for r in decontaminated(d, items).collect()} == {2, 3}


def test_decontamination_of_short_items(spark):
    """Items of 6, 10 and 15 words, as they are and with one and two changed words in the middle."""
    items = {n: prose(60 + n, n).split() for n in (6, 10, 15)}
    texts = {}
    for n, w in items.items():
        for changed, at in enumerate(((), (n // 2,), (n // 2 - 1, n // 2))):
            texts[10 * n + changed] = " ".join(["before"] + ["other" if i in at else x for i, x in enumerate(w)] + ["after", prose(n, 30)])
    d = spark.createDataFrame([(i, t, "", "", 0) for i, t in texts.items()], SCHEMA)
    listed = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()] + [(8, " "), (9, None), (1, "zzz")], "item_id long, text string")
    got = {tuple(r) for r in benchmark_overlaps(d, listed).collect()}
    assert got == {(60, 6, 6, 6), (100, 10, 10, 10), (101, 10, 8, 10), (150, 15, 15, 15), (151, 15, 13, 15), (152, 15, 11, 15)}  # two changed words leave the item of 10 no seed
    assert got == {tuple(r) for r in benchmark_overlaps(d, listed, broadcast_seeds=0).collect()}


def test_license_scan(spark):
    d = docs(spark, "Licensed under CC BY-NC 4.0.", "by mit und mit License", "Permission is hereby granted, free of charge, to any person obtaining a copy", "Permission is hereby granted, free of charge.", None)
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in license_scan(d).collect()}
    assert got == {
        0: (7, 1, 2, 2, "cc-by", "cc-by,cc-by-nc"),
        1: (5, 1, 3, 3, "mit", "mit"),
        2: (13, 0, None, None, "", "mit"),
        3: (7, 0, None, None, "", "mit"),
        4: (0, 0, None, None, "", ""),
    }


def test_license_scan_against_a_search_at_every_place(spark):
    """Key phrase and share at each place of the text, with overlapping and cut notices, repeated words and keys."""
    r = random.Random(8)
    own = (Template("twice", "on and on and on it goes", "on and on", 0.5), Template("word", "permitted", "permitted"), Template("aba", "a b a c a b a", "a b a"))
    templates = (*TEMPLATES, *own)
    texts = ["Mozilla Public License 2.0", "a b c d e f g h mozilla public license y", "on and on and on and on it goes", "a b a b a c a b a"]
    for _ in range(150):
        w = []
        for _ in range(r.randrange(1, 5)):
            t = r.choice((*BASE, *templates)).all
            at = r.randrange(len(t))
            part = t[at:] if r.random() < 0.3 else t[: at + 1] if r.random() < 0.3 else list(t)
            w += [r.choice(t) if r.random() < 0.08 else x for x in part] + [r.choice(["mit", "license", "other", "the", "on"]) for _ in range(r.randrange(4))]
        texts.append(" ".join(w))

    def places(w, t):
        k = t.key_words
        for i in range(len(w)):
            if w[i : i + len(k)] == k:
                inside = [(w[i - t.key_at + j], x) for j, x in enumerate(t.all) if 0 <= i - t.key_at + j < len(w)]
                if sum(a == b for a, b in inside) / len(inside) >= t.share:
                    yield i, sum(a == b for a, b in inside) / len(inside)

    got = {x.doc_id: (x.n_base, x.first_word, x.last_word, x.labels, x.score) for x in license_scan(docs(spark, *texts), templates=templates).collect()}
    for n, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        at = [i for t in BASE for i, _ in places(w, t)]
        hits = {t.label: [s for _, s in places(w, t)] for t in BASE} | {t.label: [s for _, s in places(w, t)] for t in templates if t.label not in {b.label for b in BASE}}
        for t in templates:
            hits[t.label] = hits[t.label] + [s for _, s in places(w, t)]
        want = (len(at), min(at, default=None), max(at, default=None), ",".join(sorted(k for k, v in hits.items() if v)), max((s for v in hits.values() for s in v), default=0.0))
        assert got[n] == want, text
    assert got[0][3] == "mpl" and got[1][3] == ""


def test_mixing_reaches_its_targets(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randrange(1, 60), "", s, 0) for i, s in enumerate(r.choices(["a", "b", "c", None], [60, 10, 20, 10], k=3000))]
    d = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(d, buckets=16).collect()
    by_source = {}
    for x in got:
        t = by_source.setdefault(x.source, [0, 0, x.target, x.source_size])
        t[0] += x.size
        t[1] += x.taken
        assert x.copies in (0, 1, 2) and x.taken <= 2 * x.size
    total = sum(t[0] for t in by_source.values())
    assert sum(t[2] for t in by_source.values()) == pytest.approx(1.5 * total)
    for size, taken, target, said in by_source.values():
        assert size == said and target <= 2 * size + 1e-6 and abs(taken - target) <= 60
    again = mix_sources(d.repartition(7), buckets=4096).collect()
    assert sorted((x.doc_id, x.copies) for x in got) == sorted((x.doc_id, x.copies) for x in again)


def brute_substrings(texts, window):
    seen = {}
    split = {i: (t or "").split() for i, t in texts.items()}
    for i, w in split.items():
        for k in range(len(w) - window + 1):
            seen.setdefault(tuple(w[k : k + window]), []).append((i, k))
    gone = {(i, p) for at in seen.values() if len(at) > 1 for i, k in at for p in range(k, k + window)}
    return {i: " ".join(x for p, x in enumerate(w) if (i, p) not in gone) for i, w in split.items()}


def test_substring_dedup_against_brute_force(spark):
    r = random.Random(3)
    parts = [prose(100 + i, r.randrange(20, 90)) for i in range(25)]
    texts = {i: " ".join(r.sample(parts, 3) + [prose(1000 + i, r.randrange(0, 60))]) for i in range(80)}
    texts |= {100: "a " * 200, 101: None, 102: "", 103: "b a " * 40, 104: texts[5], 105: prose(7, 34), 106: prose(7, 34), 107: prose(8, 35), 108: prose(8, 35)}
    got = substring_dedup(spark.createDataFrame([(i, t, "", "", 0) for i, t in texts.items()], SCHEMA)).collect()
    assert {x.doc_id: x.text for x in got} == brute_substrings(texts, 35)


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "a.com", ""), ("block", "b.com", "/pre")]


def test_url_filters(spark):
    urls = ["http://WWW.Example.com/en/1?x=/fr/", "https://example.com/en/", "https://example.com/en", "http://x.a.com", "http://b.com/prefix/z", "http://b.com/p", "http://other.org/en/", None, "no host", "http:///x", "http://notexample.com/en/#a"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), RULES).collect()}
    assert got == {
        0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        1: ("example.com", "/en/", "example.com/en/", "block"),
        2: ("example.com", "/en", "com/", "allow"),
        3: ("x.a.com", "", "a.com", "block"),
        4: ("b.com", "/prefix/z", "b.com/pre", "block"),
        5: ("b.com", "/p", "com/", "allow"),
        6: ("other.org", "/en/", None, "allow"),
        7: ("", "", None, "block"),
        8: ("", "", None, "block"),
        9: ("", "/x", None, "block"),
        10: ("notexample.com", "/en/", "com/", "allow"),
    }
    assert walk(trie_of([("allow", "a", "/"), ("block", "a", "/")]), "a", "/x") == ("block", "a/")


def test_pii(spark):
    texts = [
        "x@y.z_b@c.de a@b..c", "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1.1", "4111 1111-1111 1111 and 41111111111111112", "+1 (487) 555-7209 +123 +1 2 3 4 5 6 7 8 9 0 x", None,
        "é😀 +1 (487) 555-7209", "1" * 60_000, "a" * 60_000 + "@", "12 " * 20_000, "(" * 50_000, "+1" + "(" * 50_000,
    ]
    d = docs(spark, *texts)
    got = pii.find_pii(d, pii.fit(d)).select("doc_id", pii.joined(F.col("base")).alias("b"), pii.redacted(F.coalesce("text", F.lit("")), F.col("base")).alias("r")).collect()
    for row in got:
        if len(texts[row.doc_id] or "") < 1000:
            assert row.b == ",".join(base_spans(texts[row.doc_id]))
    assert got[5].r == "é😀 <phone>"


def test_pii_thresholds_come_from_all_candidates(spark):
    """A kind that is rare beside the others is redacted whatever the size of the sample."""
    r = random.Random(8)
    many = [f"mail to user{i}@host{i % 7}.com or 999.{i % 256}.3.4 or 10.0.{i % 256}.9" for i in range(600)]
    rare = [f"tel 030 55{i} 12{i} now" for i in range(10, 18)]
    rare += ["api_key = " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36)) for _ in range(8)]
    d = docs(spark, *many, *rare).repartition(4)
    for most in (120, 20_000):
        rows = pii.find_pii(d, pii.fit(d, most=most)).where(f"doc_id >= {len(many)}").select("doc_id", pii.joined(F.col("pii")).alias("found")).collect()
        assert {x.found.split(":")[0] for x in rows if x.doc_id < len(many) + 8} == {"phone"}
        assert {x.found.split(":")[0] for x in rows if x.doc_id >= len(many) + 8} == {"secret"}


def test_quality_weights_without_labels(spark):
    d = docs(spark, "some text", None)
    w = fit(d, spark.createDataFrame([], "doc_id long, label int"))
    assert len(w) == BUCKETS and [r.score for r in quality_scores(d, w).collect()] == [0.5, 0.5]


def test_shapes_of_whole_words_in_any_order():
    long = "a" * 64
    assert ShapeHashes()[(long + "0-0").encode()] != ShapeHashes()[long.encode()]
    warm = Features()
    warm.of("é 漢 É")
    for text in ("x", "ax x0 x", "é x"):
        assert [x.tolist() for x in warm.of(text)] == [x.tolist() for x in Features().of(text)]


def test_words(spark):
    row = spark.createDataFrame([(" a\tb\x0b\x0cc d ",)], "text string").select(words(F.col("text"))).first()
    assert row[0] == ["a", "b", "c d"]
