"""License scans by a positional index of rare words.

The index holds every place of every word of the templates, and the number of all
documents that have the word.  A file is asked for the rarest words it shares with
each template whose key words it has; their postings, moved to where the template's
key would start, are intersected; where they agree, the key phrase is verified word
by word, and the share of the template's words in place is counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import let, own_names, split_words


@dataclass(frozen=True)
class Template:
    """``key`` must stand in the text, and ``share`` of all ``words`` in their places."""

    label: str
    words: str
    key: str
    share: float = 1.0

    @property
    def all(self) -> list[str]:
        return self.words.split()

    @property
    def key_words(self) -> list[str]:
        return self.key.split()

    @property
    def key_at(self) -> int:
        w, k = self.all, self.key_words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


def phrase(label: str, words: str) -> Template:
    return Template(label, words, words)


#: Fixed phrases: each is its own key.
BASE = (
    phrase("gpl", "gnu general public license"),
    phrase("apache", "apache license"),
    phrase("cc-by", "cc by"),
    phrase("mit", "mit license"),
)

#: What the licences say of themselves; most of the words must be in place.
TEMPLATES = (
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the", "free software you can redistribute it", 0.6),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license", "required by applicable law or agreed to in writing", 0.6),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", 0.6),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", 0.6),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license", 0.4),
    Template("gpl-3", "gnu general public license version 3", "gnu general public license version 3"),
    Template("apache-2", "apache license version 2 0", "apache license version 2 0"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
)

#: Words looked up for each template that a file may hold.
LOOKED_UP = 2

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def license_words(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    # lower() changes other letters too, which no template has; only the Kelvin sign becomes ASCII.
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd")))
    return split_words(plain, BETWEEN_WORDS)


def document_counts(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many of all rows each of a few dozen words stands."""
    there = F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col("_words"))
    counts = words.select(F.explode(there).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}


def positional_index(templates, n_base: int, counts: dict[str, int]) -> tuple[Column, Column]:
    """The words of all templates, rarest first, and the templates with their words' places.

    ``places`` has for each word of the key its places in the key.
    """
    by_rarity = sorted({x for t in templates for x in t.all}, key=lambda x: (counts.get(x, 0), x))
    texts = lambda xs: F.array(*map(F.lit, xs))
    rows = []
    for n, t in enumerate(templates):
        key = t.key_words
        postings = [F.struct(F.lit(x).alias("word"), F.array(*[F.lit(i) for i, y in enumerate(key) if x == y]).alias("at")) for x in dict.fromkeys(key)]
        rows.append(
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(n < n_base).alias("base"),
                texts(t.all).alias("words"),
                texts(key).alias("key"),
                F.lit(t.key_at).alias("key_at"),
                F.array(*postings).alias("places"),
                F.lit(float(t.share)).alias("least"),
            )
        )
    return texts(by_rarity), F.array(*rows)


def rarest_key_words(t: Column, present: Column) -> Column:
    """The ``LOOKED_UP`` rarest of the key's words (``present`` is in order of rarity)."""
    return F.slice(F.array_intersect(present, t["key"]), 1, LOOKED_UP)


def key_starts(t: Column, present: Column, hits: Column) -> Column:
    """Where the key would have to start, by all the words looked up for the template."""

    def starts(word: Column) -> Column:
        at = F.filter(t["places"], lambda p: p["word"] == word)[0]["at"]
        of_word = F.filter(hits, lambda h: h["word"] == word)
        return F.flatten(F.transform(of_word, lambda h: F.transform(at, lambda k: h["at"] - k)))

    each = F.transform(rarest_key_words(t, present), starts)
    return let(each, lambda e: F.aggregate(e, F.array_distinct(e[0]), F.array_intersect))


def verified(w: Column, t: Column, starts: Column) -> Column:
    """(start of the key phrase, share of the template) where key and share hold.

    The share is of those places of the template that lie inside the text, so that a
    notice of the key alone is a whole one.
    """
    stands = F.filter(starts, lambda s: F.when(s < 0, False).otherwise(F.slice(w, F.greatest(s, F.lit(0)) + 1, F.size(t["key"])) == t["key"]))

    def share(s: Column) -> Column:
        first = s - t["key_at"]
        there = F.transform(
            t["words"],
            lambda x, j: F.when((first + j >= 0) & (first + j < F.size(w)), (F.get(w, F.greatest(first + j, F.lit(0))) == x).cast("int")),
        )
        inside = F.filter(there, lambda x: x.isNotNull())
        return F.size(F.filter(inside, lambda x: x == 1)) / F.size(inside).cast("double")

    found = F.transform(stands, lambda s: F.struct(s.alias("at"), share(s).alias("share")))
    return F.filter(found, lambda x: x["share"] >= t["least"])


@own_names
def license_scan(docs: DataFrame, text: str = "text", base=BASE, templates=TEMPLATES) -> DataFrame:
    """All columns of ``docs`` and the licences found in each text.

    n_words, n_base (places of base phrases), first_word and last_word (their first
    and last start, else null), base_labels and labels (sorted, joined by commas) and
    score (the best share of a template in place, 0 without any).  A null or empty
    text has no words and no labels, an empty table gives an empty one.  Columns of
    these names give way; ids play no part, repeated rows get the same each.  Which
    words are looked up depends on how many of all documents have them, what is found
    does not: every key phrase has all its words, the rarest too.
    """
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rest = docs.drop(*made)
    all_templates = [*base, *templates]
    vocabulary = sorted({x for t in all_templates for x in t.all})
    counts = document_counts(docs.select(license_words(F.col(text)).alias("_words")), vocabulary)
    by_rarity, index = positional_index(all_templates, len(base), counts)

    def looked_up(w: Column) -> Column:
        return let(F.array_intersect(by_rarity, w), lambda present: let(possible(present), lambda ts: found_in(w, present, ts)))

    def possible(present: Column) -> Column:
        return F.filter(index, lambda t: F.size(F.array_except(t["key"], present)) == 0)

    def found_in(w: Column, present: Column, ts: Column) -> Column:
        wanted = F.array_distinct(F.flatten(F.transform(ts, lambda t: rarest_key_words(t, present))))
        at = let(wanted, lambda asked: F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(asked, x), F.struct(x.alias("word"), i.alias("at")))), lambda h: h.isNotNull()))
        each = let(at, lambda hits: F.transform(ts, lambda t: F.struct(t["label"].alias("label"), t["base"].alias("base"), verified(w, t, key_starts(t, present, hits)).alias("found"))))
        none = F.array().cast("array<struct<label:string,base:boolean,found:array<struct<at:int,share:double>>>>")
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.when(F.size(ts) > 0, F.filter(each, lambda x: F.size(x["found"]) > 0)).otherwise(none).alias("there"),
        )

    f = F.col("_found")
    of_base = F.flatten(F.transform(F.filter(f["there"], lambda x: x["base"]), lambda x: F.transform(x["found"], lambda y: y["at"])))
    labels = lambda xs: F.array_join(F.sort_array(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    out = rest.withColumn("_found", let(license_words(F.col(text)), looked_up)).withColumn("_base", of_base)
    return out.select(
        *[f"`{c}`" for c in rest.columns],
        f["n_words"].alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base").cast("long").alias("first_word"),
        F.array_max("_base").cast("long").alias("last_word"),
        labels(F.filter(f["there"], lambda x: x["base"])).alias("base_labels"),
        labels(f["there"]).alias("labels"),
        F.coalesce(F.array_max(F.flatten(F.transform(f["there"], lambda x: F.transform(x["found"], lambda y: y["share"])))), F.lit(0.0)).alias("score"),
    )
