"""Personal data by candidate gradient boosting.

Generators of high recall propose spans, which may overlap.  Boosted trees, fitted
here on a bounded sample of the corpus's own candidates, judge each from its format
and its context; a threshold for each generator, calibrated on all candidates of the
corpus, selects what is redacted.  Spans of the four base kinds that pass their checks are always kept.  The trees are compiled into one
column expression, so that scoring is part of the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import let, own_names, shared_table

#: Kinds in the order of equal starts.
KINDS = ("email", "ip", "card", "phone", "secret")
SPAN = "array<struct<start:int,end:int,value:string,before:string>>"


@dataclass(frozen=True)
class Generator:
    """``gate`` is a cheap pattern that every match contains; ``base`` ones have a check."""

    kind: str
    pattern: str
    gate: str
    base: bool = True


# Possessive, so that a failed match costs no more than its length; \G lets a match
# start where the last one ended, as the plain patterns do.
GENERATORS = (
    Generator("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Generator("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    Generator("card", r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){13}"),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    Generator("phone", r"(?<![0-9+(])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])", r"[0-9]{2}\)?[\x20.-][0-9]{3}", False),
    Generator("secret", r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]*+[0-9])[A-Za-z0-9_/+=-]{20,}+", r"[A-Za-z0-9_/+=-]{20}", False),
)
FEATURES = ("generator", "length", "digits", "letters", "upper", "kinds_of_chars", "digit_share", "luhn", "keyword", "assigned", "separators")
#: Distinct candidates that the trees are fitted on, in equal parts for each generator.
TRAIN_CANDIDATES = 20_000
TREES, DEPTH = 8, 3
#: Share of right ones among what a generator's threshold lets pass.
PRECISION = 0.95
CONTEXT = 24


def spans(text: Column, pattern: str, gate: str) -> Column:
    """All matches, leftmost first, with their places in code points."""
    none = F.array().cast(SPAN)

    def placed(found: Column) -> Column:
        def step(pieces: Column):
            def add(a: Column, i: Column) -> Column:
                before = F.get(pieces, i)
                start = a["at"] + F.char_length(before)
                end = start + F.char_length(F.get(found, i))
                one = F.struct(start.alias("start"), end.alias("end"), F.get(found, i).alias("value"), F.right(before, F.lit(CONTEXT)).alias("before"))
                return F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

            return add

        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        walk = lambda pieces: F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step(pieces))["out"]
        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), walk))

    there = F.contains(text, F.lit(gate)) if gate == "@" else text.rlike(gate)
    return F.when(there, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    def term(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return n - F.when(n > 9, 9).otherwise(0)

    terms = F.transform(F.split(F.reverse(F.right(digits, F.lit(32))), "(?<=.)(?=.)"), term)
    return F.when(F.length(digits).between(1, 32), F.aggregate(terms, F.lit(0), lambda a, x: a + x) % 10 == 0).otherwise(F.lit(False))


def checked(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"\A0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\z"))
    if kind == "card":
        return let(digits_of(value), lambda d: F.length(d).between(14, 19) & passes_luhn(d))
    if kind == "phone":
        return F.length(digits_of(value)).between(10, 15)
    return F.lit(True)


def features(n: int, s: Column) -> Column:
    """Format and context of one candidate of generator ``n``."""
    value, before = s["value"], s["before"]
    count = lambda cls: F.regexp_count(value, F.lit(cls)).cast("double")
    length = F.char_length(value).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.struct(
        F.lit(float(n)).alias("generator"),
        length.alias("length"),
        count("[0-9]").alias("digits"),
        count("[A-Za-z]").alias("letters"),
        count("[A-Z]").alias("upper"),
        F.size(F.array_distinct(F.split(F.substring(value, 1, 64), "(?<=.)(?=.)"))).cast("double").alias("kinds_of_chars"),
        (count("[0-9]") / length).alias("digit_share"),
        flag(passes_luhn(digits_of(value))).alias("luhn"),
        flag(before.rlike(r"(?i)token|key|secret|passw|auth|phone|tel|call|mail|card|account")).alias("keyword"),
        flag(before.rlike(r"[=:]\s*[\"']?\z")).alias("assigned"),
        count(r"[\x20().-]").alias("separators"),
    )


def weak_label(n: int, s: Column, f: Column) -> Column:
    """What the trees learn from: the checks of the base kinds; for secrets, that they are
    assigned to a keyword or as mixed as random digits; for local numbers, a keyword."""
    g = GENERATORS[n]
    if g.base:
        return checked(g.kind, s["value"])
    if g.kind == "secret":
        named = (f["keyword"] == 1) & (f["assigned"] == 1)
        mixed = (f["length"] >= 32) & (f["kinds_of_chars"] >= 12) & f["digit_share"].between(0.2, 0.8)
        return named | mixed
    return f["keyword"] == 1


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """A row per candidate of every text: generator's number, features, weak label."""

    def of(n: int) -> Column:
        g = GENERATORS[n]
        return F.transform(
            spans(F.col("_text"), g.pattern, g.gate),
            lambda s: let(features(n, s), lambda f: F.struct(f.alias("f"), weak_label(n, s, f).cast("double").alias("label"), F.xxhash64(s["value"], s["before"]).alias("hash"))),
        )

    plain = docs.select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return plain.select(F.explode(F.concat(*map(of, range(len(GENERATORS))))).alias("c")).select("c.f.*", "c.label", "c.hash")


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, threshold, left, right) or a leaf's value, with weights."""

    trees: tuple
    thresholds: tuple[float, ...]

    def score(self, f: Column) -> Column:
        def of(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, limit, left, right = node
            return F.when(f[name] <= limit, of(left)).otherwise(of(right))

        total = sum((of(tree) * weight for weight, tree in self.trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * total))


def _tree(node):
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    split = node.split()
    return FEATURES[split.featureIndex()], float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def training_sample(every: DataFrame, most: int = TRAIN_CANDIDATES) -> DataFrame:
    """About ``most`` / 6 distinct candidates of each generator, or all that it has.

    They are chosen by hashes, against a limit from their number: nothing is sorted but
    the sample, in one task, so that its order is always the same.
    """
    one = every.distinct()
    counts = {int(r["generator"]): r["count"] for r in one.groupBy("generator").count().collect()}
    each, steps = most // len(GENERATORS), 1 << 30
    # Candidates of one value in one context share a hash, and one row.
    place = F.pmod(F.xxhash64("hash", "generator"), F.lit(steps))
    wanted = [(F.col("generator") == n) & (place < F.lit(min(steps, steps * each // c))) for n, c in counts.items()]
    return one.where(reduce(or_, wanted, F.lit(False))).repartition(1).sortWithinPartitions("hash", "generator", "length")


def fit(docs: DataFrame, text: str = "text", most: int = TRAIN_CANDIDATES) -> Model:
    """Trees from about ``most`` candidates, thresholds from all candidates of all documents.

    Where the sample lacks either label nothing can be learned, and no candidate
    beyond the base kinds passes.
    """
    every = shared_table(candidates(docs, text), "pii-candidates")
    sample = training_sample(every, most).persist()
    try:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample)
        both = rows.select(F.min("label"), F.max("label")).first()
        if both[0] is None or both[0] == both[1]:
            return Model((), (2.0,) * len(GENERATORS))
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, labelCol="label", featuresCol="features").fit(rows)
    finally:
        sample.unpersist()
    trees = tuple((float(w), _tree(t._call_java("rootNode"))) for w, t in zip(model.treeWeights, model.trees))
    score = Model(trees, ()).score(F.struct(*FEATURES))
    counts = (
        every.groupBy(F.col("generator").cast("int").alias("generator"), F.floor(score * 100).cast("int").alias("at"))
        .agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("all"))
        .collect()  # at most 101 rows a generator
    )
    thresholds = []
    for n in range(len(GENERATORS)):
        right = every = 0.0
        best = 2.0
        for r in sorted((r for r in counts if r["generator"] == n), key=lambda r: -r["at"]):
            right, every = right + r["right"], every + r["all"]
            if right >= PRECISION * every:
                best = r["at"] / 100
        thresholds.append(best)
    return Model(trees, tuple(thresholds))


@own_names
def find_pii(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and base and pii: arrays of (start, kind_no, end, kind), sorted.

    base are the spans of the four base kinds that pass their checks; pii has those and
    the candidates that the trees let pass and no base span overlaps, the leftmost of
    those that overlap each other.  Places count code points, ends are exclusive.  A
    null or empty text has none.  Rows are judged one by one, whatever their ids.
    """
    rest = docs.drop("base", "pii")
    source = F.coalesce(F.col(text), F.lit(""))

    def selected(n: int, g: Generator, passes) -> Column:
        kind = KINDS.index(g.kind)
        return F.transform(
            F.filter(spans(source, g.pattern, g.gate), lambda s: passes(s)),
            lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind_no"), s["end"].alias("end"), F.lit(g.kind).alias("kind")),
        )

    def by_trees(n: int):
        return lambda s: model.score(features(n, s)) >= model.thresholds[n]

    def by_check(kind: str):
        return lambda s: checked(kind, s["value"])

    numbered = list(enumerate(GENERATORS))
    base = [selected(n, g, by_check(g.kind)) for n, g in numbered if g.base]
    more = [selected(n, g, by_trees(n)) for n, g in numbered if not g.base and model.thresholds[n] <= 1]
    out = rest.withColumn("base", F.sort_array(F.concat(*base)))
    if not more:
        return out.withColumn("pii", F.col("base"))
    kind = "array<struct<start:int,kind_no:int,end:int,kind:string>>"
    clear = F.filter(F.col("_more"), lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    leftmost = F.aggregate(
        F.sort_array(clear),
        F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("out")),
        lambda a, c: F.when(c["start"] >= a["end"], F.struct(c["end"].alias("end"), F.concat(a["out"], F.array(c)).alias("out"))).otherwise(a),
    )["out"]
    out = out.withColumn("_more", F.concat(*more))
    return out.withColumn("pii", F.when(F.size("_more") == 0, F.col("base")).otherwise(F.sort_array(F.concat("base", leftmost)))).drop("_more")


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, pii: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans give one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    return let(F.aggregate(pii, start, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
