"""Benchmark decontamination by spaced seeds.

A seed is a mask over nine consecutive words: six are hashed, three are ignored, so
that a changed word leaves some seeds of every stretch intact.  Seeds of the
benchmark and of the documents meet in a join; round each hit the words of the two
texts are compared along the hit's diagonal, and the best stretch counts, a changed
word costing as much as it would have given.  An item too short for a seed is looked
up whole, by one hash of all its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import let, own_names, words

#: Word offsets that each mask keeps.
MASKS = ((0, 1, 3, 4, 7, 8), (0, 2, 3, 5, 6, 8))
SPAN = 9
#: Equal words less changed ones that make an overlap of a long item.
LEAST_SCORE = 12
#: Share of a shorter item's words that does; an item without a seed must be there whole.
ITEM_SHARE = 0.6
#: Benchmark seeds that are broadcast (16 bytes each); more are joined by shuffling.
BROADCAST_SEEDS = 1_000_000


def word_hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def seeds(h: Column) -> Column:
    """One hash for each place and mask: place 0 mask 0, place 0 mask 1, place 1 ..."""

    def at(i: Column) -> Column:
        return F.array(*[F.xxhash64(F.lit(m), *[F.get(h, i + o) for o in mask]) for m, mask in enumerate(MASKS)])

    return F.when(F.size(h) >= SPAN, F.flatten(F.transform(F.sequence(F.lit(0), F.size(h) - SPAN), at)))


def exploded(df: DataFrame, key: str, text: str, out: str) -> DataFrame:
    hashed = df.select(F.col(key).alias(out), let(word_hashes(F.col(text)), seeds).alias("_seeds"))
    return hashed.select(out, F.posexplode("_seeds").alias("_at", "_seed")).select(
        out, (F.shiftright("_at", 1)).alias(f"_{out}_at"), "_seed"
    )


def whole_items(docs: DataFrame, items: DataFrame, broadcast_items: int) -> DataFrame:
    """(doc, item, score, item_words) of the items of fewer than ``SPAN`` words that a document has word for word.

    ``docs`` has doc and _text, ``items`` item and _text.
    """
    hashed = items.select("item", let(word_hashes(F.col("_text")), lambda h: F.struct(F.size(h).alias("n"), F.xxhash64(h).alias("whole"))).alias("_h"))
    short = hashed.select("item", F.col("_h.n").alias("item_words"), F.col("_h.whole").alias("_whole")).where(F.col("item_words").between(1, SPAN - 1)).distinct()
    counts = {r["item_words"]: r["count"] for r in short.groupBy("item_words").count().collect()}  # at most SPAN - 1 rows

    def windows(h: Column) -> Column:
        """A struct of length and hash for each run of words that is as long as some item."""

        def of(n: int) -> Column:
            starts = F.sequence(F.lit(0), F.size(h) - n)
            runs = F.transform(starts, lambda i: F.xxhash64(F.array(*[F.get(h, i + k) for k in range(n)])))
            made = F.transform(F.array_distinct(runs), lambda x: F.struct(F.lit(n).alias("n"), x.alias("whole")))
            return F.when(F.size(h) >= n, made).otherwise(F.array().cast("array<struct<n:int,whole:bigint>>"))

        return F.concat(*map(of, sorted(counts)))

    if not counts:
        return short.select(F.lit(None).cast(docs.schema["doc"].dataType).alias("doc"), "item", F.col("item_words").alias("score"), "item_words").where(F.lit(False))
    runs = docs.select("doc", F.explode(let(word_hashes(F.col("_text")), windows)).alias("_run")).select(
        "doc", F.col("_run.n").alias("item_words"), F.col("_run.whole").alias("_whole")
    )
    found = runs.join(F.broadcast(short) if sum(counts.values()) <= broadcast_items else short, ["item_words", "_whole"])
    return found.select("doc", "item", F.col("item_words").alias("score"), "item_words").distinct()


def best_stretch(doc: Column, item: Column, diagonal: Column) -> Column:
    """Score, and first and last item word, of the best stretch of one diagonal."""
    start = F.struct(*[F.lit(0).alias(n) for n in ("now", "from_", "best", "first", "last")])

    def step(a: Column, j: Column) -> Column:
        same = F.coalesce((diagonal + j >= 0) & (F.get(doc, F.greatest(diagonal + j, F.lit(0))) == F.get(item, j)), F.lit(False))
        begin = F.when(a["now"] > 0, a["from_"]).otherwise(j)
        now = F.greatest(a["now"] + F.when(same, 1).otherwise(-1), F.lit(0))
        better = now > a["best"]
        return F.struct(
            now.alias("now"),
            begin.alias("from_"),
            F.when(better, now).otherwise(a["best"]).alias("best"),
            F.when(better, begin).otherwise(a["first"]).alias("first"),
            F.when(better, j).otherwise(a["last"]).alias("last"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), start, step)


@own_names
def benchmark_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    least_score: int = LEAST_SCORE,
    broadcast_seeds: int = BROADCAST_SEEDS,
    item_share: float = ITEM_SHARE,
) -> DataFrame:
    """(doc_id, item_id, score, item_words): what the documents share with the benchmark.

    Words stand between white space and are compared in lower case.  A pair counts
    if a stretch of one diagonal has ``least_score`` more equal words than changed
    ones, or ``item_share`` of the item's words if that is less.  Items of fewer than
    9 words have no seed: they count where the document has them word for word.  Null
    texts and rows without an id are never found.  Items of one id are one item with
    several texts, the best of which counts.
    """
    of_docs = exploded(docs.where(F.col(doc_id).isNotNull()), doc_id, text, "doc")
    # An item is read wherever it is needed: the benchmark is small beside the corpus.
    numbered = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).alias("_text")).distinct()
    of_items = numbered.select(F.struct("item", "_text").alias("_key"), let(word_hashes(F.col("_text")), seeds).alias("_seeds")).select(
        F.col("_key.item").alias("item"), F.xxhash64("_key._text").alias("_which"), F.posexplode("_seeds").alias("_at", "_seed")
    ).select("item", "_which", F.shiftright("_at", 1).alias("_item_at"), "_seed")
    few = of_items.limit(broadcast_seeds + 1).count() <= broadcast_seeds
    hits = (
        of_docs.join(F.broadcast(of_items) if few else of_items, "_seed")
        .select("doc", "item", "_which", (F.col("_doc_at") - F.col("_item_at")).alias("_diagonal"))
        .distinct()
    )
    item_hashes = numbered.select("item", F.xxhash64("_text").alias("_which"), word_hashes(F.col("_text")).alias("_item"))
    per_doc = hits.join(item_hashes, ["item", "_which"]).groupBy("doc").agg(
        F.collect_list(F.struct("item", "_item", "_diagonal")).alias("_hits")
    )
    looked_at = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("_text")).join(per_doc, "doc").select(
        "doc", "_text", F.explode("_hits").alias("_hit")
    )
    scored = looked_at.select(
        F.col("doc").alias(doc_id),
        F.col("_hit.item").alias(item_id),
        # Bound once: a plain column of hashes would be worked out again for each step.
        let(
            F.struct(word_hashes(F.col("_text")).alias("doc"), F.col("_hit._item").alias("item")),
            lambda x: let(x["doc"], lambda doc: let(x["item"], lambda item: best_stretch(doc, item, F.col("_hit._diagonal"))["best"])),
        ).alias("score"),
        F.size("_hit._item").alias("item_words"),
    ).where(F.col("score") >= F.least(F.lit(least_score), F.ceil(F.col("item_words") * F.lit(item_share))))
    texts = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("_text"))
    whole = whole_items(texts, numbered, broadcast_seeds).select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "score", "item_words")
    scored = scored.unionByName(whole)
    best = F.max(F.struct("score", "item_words"))
    return scored.groupBy(doc_id, item_id).agg(best.alias("_b")).select(
        doc_id, item_id, F.col("_b.score").cast("long").alias("score"), F.col("_b.item_words").cast("long").alias("item_words")
    )


@own_names
def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without those that overlap an item; rows without an id stay."""
    found = benchmark_overlaps(docs, benchmark, doc_id, **options).select(F.col(doc_id).alias("_found")).distinct()
    return docs.join(found, F.col(doc_id) == F.col("_found"), "left_anti")
