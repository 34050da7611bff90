"""MinHash near-dedup with odd sketches.

Each text gives 256 MinHash samples of its 5-word shingles.  The first 128 make 32
bands of four; documents that agree on a band are candidates.  All samples fold into
a parity bitmap of 1024 bits, the odd sketch: the bits in which two sketches differ
tell how many samples differ, most precisely where few do, so that candidates below
the wanted similarity fall away without a look at their texts.  A second bitmap folds
the whole set: its differing bits are never more than the differing shingles, which
rules pairs out for certain, most of those just below the threshold among them.  Links
are confirmed on the full shingle sets.

Texts of equal shingle sets stand in as one.  In a band's bucket all members are
compared with a few pivots, a number of rows that grows with the bucket and not
with its square; members that this joins need no comparison with each other.  Only
those of a bucket that are still in different components are compared pair by pair,
on sketches inside the join, so that no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import WordHashes, encoded, mixed, own_names, shared_table

SHINGLE = 5
SAMPLES = 256
BANDS, ROWS = 32, 4
SKETCH_BITS = 1024
#: A link's percentage of common shingles.
PERCENT = 75
#: The sketch lets pass what is below by up to five deviations of its estimate.
SLACK = 5.0
PIVOTS = 4

_rng = np.random.default_rng(20_09)
_XOR = _rng.integers(0, 1 << 32, SAMPLES, np.uint32)
_MUL = _rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_PLACE = _rng.integers(0, 1 << 63, SAMPLES, np.uint64) | np.uint64(1)
_TERM = _rng.integers(0, 1 << 63, SHINGLE, np.uint64) | np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased."""
    return encoded(text).lower().split()


def shingle_set(text: str | None) -> frozenset:
    """5-word shingles; with fewer words all of them as one."""
    w = words_of(text)
    if len(w) < SHINGLE:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(zip(*(w[i:] for i in range(SHINGLE))))


def shingle_hashes(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    h = hashes.of(words)
    n = max(1, len(h) - SHINGLE + 1)
    total = np.full(n, min(len(h), SHINGLE), np.uint64)
    for i in range(min(SHINGLE, len(h))):
        total += h[i : i + n] * _TERM[i]
    return np.unique(mixed(total))


def samples_of(shingles: np.ndarray) -> np.ndarray:
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)[:, None]
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 2048):
        best = np.minimum(best, ((low[start : start + 2048] ^ _XOR) * _MUL).min(axis=0))
    return best


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bitmap of the places that an odd number of hashes fall on."""
    counts = np.bincount((hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        sizes, sets, bands, sketches = [], [], [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            if not words:
                sizes.append(0)
                sets.append(None)
                bands.append([])
                sketches.append(None)
                continue
            s = shingle_hashes(words, hashes)
            best = samples_of(s).astype(np.uint64)
            with np.errstate(over="ignore"):
                sizes.append(len(s))
                sets.append(np.array([mixed(s).sum(dtype=np.uint64), (mixed(s ^ np.uint64(0x5BF0)) * _TERM[0]).sum(dtype=np.uint64)]).tobytes())
                quads = best[: BANDS * ROWS].reshape(BANDS, ROWS)
                keys = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    keys = mixed(keys * np.uint64(0x100000001B3) + quads[:, r])
                bands.append(keys.view(np.int64))
                of_samples = parity(mixed((best + np.uint64(1)) * _PLACE))
            sketches.append(np.concatenate([of_samples, parity(s)]))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(sets, pa.binary()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(sketches, pa.list_(pa.int64())),
            ],
            ["doc_id", "n_shingles", "_set", "_bands", "_sketch"],
        )


def most_differing(percent: int) -> int:
    """Differing sketch bits of a pair at the threshold, with slack for chance."""
    j = percent / 100
    differing = 2 * SAMPLES * (1 - (j - SLACK * math.sqrt(j * (1 - j) / SAMPLES)))
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differing / SKETCH_BITS)) + SLACK * math.sqrt(SKETCH_BITS) / 4)


def look_alike(a: str, b: str, percent: int) -> Column:
    """Whether the sketches and sizes of two rows leave a link possible."""
    words = SKETCH_BITS // 64

    def apart(first: int) -> Column:
        bits = [F.bit_count(F.get(f"{a}_sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}_sketch", F.lit(i)))) for i in range(first, first + words)]
        return sum(bits[1:], bits[0])

    smaller, larger = F.least(f"{a}_n", f"{b}_n"), F.greatest(f"{a}_n", f"{b}_n")
    # Bits of the sets' bitmaps differ in no more places than the sets do: a bound without
    # chance, and a close one while the sets are not much larger than the bitmap.
    possible = apart(words) * (100 + percent) <= (100 - percent) * (smaller + larger)
    return (100 * smaller >= percent * larger) & (apart(0) <= most_differing(percent)) & possible


def linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, of_left = None, frozenset()
            for a, b in zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist()):
                if a != left:
                    left, of_left = a, shingle_set(a)
                other = shingle_set(b)
                common = len(of_left & other)
                keep.append(100 * common >= percent * (len(of_left) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"{x}_text"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "b_text")
    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(linked(percent), f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links reach, for every linked node but the roots.

    Large-star and small-star steps in turn, each on a table of at most as many
    rows as there are links, until nothing changes.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct()
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(least, "hi").where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        # A node's own least neighbour, where that is smaller, is an edge too.
        large = large.unionByName(least.where("m < hi").select("hi", F.col("m").alias("lo"))).distinct()
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(roots, "hi")
        small = small.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(
            roots.select("hi", F.col("m").alias("lo"))
        )
        edges = shared_table(small.distinct(), "components")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = state


@own_names
def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``.

    Documents whose sets of 5-word shingles have ``percent`` of their union in common
    are linked; component_id is the smallest id that links reach, kept says whether
    that is the document's own.  Without words or text the set is empty and linked
    with nothing.  Ids tell documents apart: of one id's different texts the
    least is looked at for links.  A row without an id has no component and is kept.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    features = shared_table(
        source.mapInArrow(signatures, f"doc_id {id_type}, n_shingles long, _set binary, _bands array<long>, _sketch array<long>"),
        "signatures",
    )
    known = features.where(F.col("doc_id").isNotNull() & F.col("_set").isNotNull())
    # One representative of each shingle set.
    classes = known.groupBy("_set", "n_shingles").agg(
        F.min(F.struct("doc_id", "_bands", "_sketch")).alias("_rep")
    )
    members = classes.select(F.col("_rep.doc_id").alias("_id"), F.explode("_rep._bands").alias("band"))
    shared_bands = members.groupBy("band").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > 1).select("band")
    crowded = shared_table(members.join(shared_bands, "band"), "candidates")
    # Sketches and texts of candidates only; neither travels with the bands.
    of_reps = classes.select(F.col("_rep.doc_id").alias("doc_id"), F.col("n_shingles").alias("_n"), F.col("_rep._sketch").alias("_sketch"))
    wanted = of_reps.join(crowded.select(F.col("_id").alias("doc_id")).distinct(), "doc_id")
    some = shared_table(
        source.join(wanted, "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "_n", "_sketch")).alias("_c")).select("doc_id", "_c.*"),
        "candidate-texts",
    )
    sketch = lambda x: some.select(F.col("doc_id").alias(x), F.col("_n").alias(f"{x}_n"), F.col("_sketch").alias(f"{x}_sketch"))
    # A few pivots of each bucket: the smallest id of each share of it.
    share = F.pmod(F.xxhash64("_id"), F.lit(PIVOTS))
    pivots = crowded.groupBy("band").agg(
        F.array_compact(F.array(*[F.min(F.when(share == i, F.col("_id"))) for i in range(PIVOTS)])).alias("_pivots")
    )
    near_pivots = (
        crowded.join(pivots, "band")
        .select(F.col("_id"), F.explode("_pivots").alias("_pivot"))
        .where(F.col("_id") != F.col("_pivot"))
        .select(F.least("_id", "_pivot").alias("a"), F.greatest("_id", "_pivot").alias("b"))
        .distinct()
    )
    near_pivots = shared_table(
        near_pivots.join(sketch("b"), "b").join(sketch("a"), "a").where(look_alike("a", "b", percent)).select("a", "b"), "pivot-pairs"
    )
    links = shared_table(confirmed(near_pivots, some, percent), "links")
    roots = components(links)
    # What is still apart inside a bucket.
    placed = (
        crowded.join(roots, F.col("_id") == F.col("node"), "left")
        .withColumn("_root", F.coalesce("root", "_id"))
        .drop("node", "root")
    )
    split = placed.groupBy("band").agg(F.min("_root").alias("_least"), F.max("_root").alias("_most")).where("_least < _most").select("band")
    apart = placed.join(split, "band")
    side = lambda x: apart.select("band", F.col("_id").alias(x), F.col("_root").alias(f"{x}_root")).join(sketch(x), x)
    others = (
        side("a")
        .join(side("b"), "band")
        .where((F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & look_alike("a", "b", percent))
        .select("a", "b")
        .distinct()
    )
    # Pivots have been looked at.
    others = others.join(near_pivots, ["a", "b"], "left_anti")
    links = links.unionByName(shared_table(confirmed(others, some, percent), "more-links"))
    roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    labels = classes.select("_set", "n_shingles", F.col("_rep.doc_id").alias("_id")).join(roots, F.col("_id") == F.col("node"), "left").select("_set", "n_shingles", F.coalesce("root", "_id").alias("component_id"))
    return (
        features.select("doc_id", "n_shingles", "_set")
        .join(labels, ["_set", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
