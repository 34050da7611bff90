"""Mixing sources to target weights by Pareto order sampling.

Each source's share of the mix becomes copies per document: whole copies are
certain, and the fraction that is left is spread over the source's documents as unequal
inclusion probabilities, so that a long document is up to twice as likely to have one copy more as a
short one, and the words expected are those of the fraction.  Documents are ranked by
their random odds over their inclusion odds, and taken in that order until these words
are reached, which gives a sample of fixed size.  Ranks come from running sums over buckets of the order, so that no
task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import own_names, shared_table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2.0
#: Pieces of a source's order; one holds this part of the source's documents.
BUCKETS = 4096


def words_in(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES
) -> DataFrame:
    """(_key, source_size, _documents, target) of each source; one row per source.

    Sources weigh ``weights`` in turn, in order of code points, null last.  A target
    stops at ``most_times`` its source's size and its excess goes to the others by
    weight: each target is the lesser of its limit and weight times one level, which
    the sources in order of limit by weight give in closed form.
    """
    per_source = sizes.groupBy("_key", "_source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_documents")
    )
    in_order = Window.orderBy(F.col("_source").isNull(), "_source")
    by_limit = Window.orderBy("_ratio", "_key")
    place = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    limited = (
        per_source.withColumn("_weight", weight)
        .withColumn("_limit", F.col("source_size") * F.lit(most_times))
        .withColumn("_ratio", F.col("_limit") / F.col("_weight"))
    )
    # Level if just the sources before stop at their limits.  While one too few does
    # it rises with the next, and falls from then on: the largest is the true one.
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(share)
    levels = limited.withColumn(
        "_level", (total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_weight").over(onwards)
    )
    level = F.max("_level").over(everything)
    target = F.least(F.col("_limit"), F.col("_weight") * level)
    return levels.select("_key", "source_size", "_documents", target.cast("double").alias("target"))


def random_of(doc_id: Column, seed: int) -> Column:
    """Uniform in (0, 1), from the id alone: the same in every run and engine."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("-")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def pull_of(size: Column) -> Column:
    """How strongly a document draws its source's fraction: 500 for a short one, up to 1000 for a long one.

    A whole number, so that its sums are the same in every run.
    """
    mean = F.call_function("div", F.col("source_size"), F.col("_documents"))
    return 500 + F.call_function("div", 500 * size, F.greatest(size + mean, F.lit(1)))


def copies_of(doc_id: Column, size: Column, seed: int) -> tuple[Column, Column]:
    """Certain copies of a document, and its place in its source's order, in [0, 1].

    Reads source_size, target, _documents and _pulls, the sum of size times pull, of its source.
    """
    per_word = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    whole = F.floor(per_word)
    spread = F.try_divide((per_word - whole) * pull_of(size) * F.col("source_size"), F.col("_pulls"))
    p = F.least(spread, F.lit(1.0))
    u = random_of(doc_id, seed)
    odds = (u / (1 - u)) * (1 - p) / p
    order = F.when(p > 0, odds / (1 + odds)).otherwise(F.lit(1.0))
    return whole, order


@own_names
def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most_times: float = MOST_TIMES,
    buckets: int = BUCKETS,
    seed: int = 0,
) -> DataFrame:
    """All of ``docs`` and size, source_size, target, copies, taken.

    The size is the number of words (of a null text 0), taken is copies times size.
    Sources have one row each in a small table, which must fit one task; documents
    of one source may be any number.  A null source is a source, an empty string
    another; a source without any words has target 0 and none of it is taken.  Rows of
    one id have one random number; rows of one id and size go in or stay out together.
    Documents without an id count as one id.  New columns take the place of old ones of
    their names.  Of an empty table the result is empty.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    rest = docs.drop(*made)
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("-"))
    id_text = F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))
    # Only numbers go further; the texts stay where they are read.
    sizes = shared_table(
        rest.select(id_text.alias("_id"), key.alias("_key"), F.col(source).alias("_source"), words_in(F.col(text)).alias("size")),
        "sizes",
    )
    targets = shared_table(source_targets(sizes, weights, share, most_times), "targets")
    pulls = sizes.join(targets, "_key").groupBy("_key").agg(F.sum(F.col("size") * pull_of(F.col("size"))).alias("_pulls"))
    targets = shared_table(targets.join(pulls, "_key"), "pulls")
    whole, order = copies_of(F.col("_id"), F.col("size"), seed)
    ranked = (
        sizes.join(targets, "_key")
        .where("source_size > 0")
        .withColumn("_p", F.try_divide("target", "source_size") - whole)
        .where(F.col("_p") > 0)
        .withColumn("_order", order)
        .withColumn("_bucket", F.least(F.floor(F.col("_order") * buckets), F.lit(buckets - 1)))
    )
    sums = ranked.groupBy("_key", "_bucket").agg(F.sum("size").alias("_words"))
    earlier = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_key", "_bucket", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_key", "_bucket").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # A document goes in while more than half of it is still wanted.
    last = (
        ranked.join(offsets, ["_key", "_bucket"])
        .withColumn("_before", before)
        .where(F.col("_before") + F.col("size") / 2 < F.col("_p") * F.col("source_size"))
        .groupBy("_key")
        .agg(F.max(F.struct("_order", "_id", "size")).alias("_last"))
    )
    cuts = shared_table(targets.join(last, "_key", "left"), "cuts")
    whole, order = copies_of(id_text, F.col("size"), seed)
    mixed = (
        rest.withColumn("size", words_in(F.col(text)))
        .withColumn("_key", key)
        .join(cuts, "_key")
        .withColumn("_here", F.struct(order.alias("_order"), id_text.alias("_id"), F.col("size")))
        .withColumn("copies", whole + F.when(F.col("_here") <= F.col("_last"), 1).otherwise(0))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
    return mixed.select(*[f"`{c}`" for c in rest.columns], *made)
