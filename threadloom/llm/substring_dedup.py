"""Substring dedup: Rabin-Karp hashes of every window of 35 words, counted in Spark.

Windows are dealt by an anchor that their words alone decide: the 16-word run of the
smallest hash inside the window.  Equal windows have equal anchors, so

* a window whose anchor occurs once in all documents occurs once itself;
* the windows round one occurrence of an anchor form a span, and if the whole span
  occurs again, each of its windows does;
* only the windows of the spans that are left, and one copy of each repeated span of
  the same anchor, go out as single window hashes, and are counted exactly.

Anchors are about a tenth of the words, so that little moves; every window of every
text is hashed and judged, and the result is that of counting them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import WordHashes, encoded, mixed, own_names, shared_table

WINDOW = 35
ANCHOR = 16
BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(BASE, -1, 1 << 64)


class RabinKarp:
    """Polynomial hashes of runs of words, modulo 2 ** 64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, BASE, np.uint64)], dtype=np.uint64)
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE_INVERSE, np.uint64)], dtype=np.uint64)

    def prefixes(self, h: np.ndarray) -> np.ndarray:
        """Sums of h[i] * BASE ** -i."""
        self._powers(len(h) + 1)
        return np.r_[np.uint64(0), np.cumsum(h * self.down[: len(h)], dtype=np.uint64)]

    def runs(self, prefixes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of words [start, end), the same wherever the run stands."""
        return mixed((prefixes[ends] - prefixes[starts]) * self.up[starts])


def anchors_of(h: np.ndarray, rk: RabinKarp, window: int, anchor: int):
    """(hashes of anchors, first and last window start of each occurrence), by place."""
    sums = rk.prefixes(h)
    starts = np.arange(len(h) - anchor + 1)
    runs = rk.runs(sums, starts, starts + anchor)
    views = np.lib.stride_tricks.sliding_window_view(runs, window - anchor + 1)
    at = views.argmin(axis=1) + np.arange(len(views))  # the leftmost of equal ones
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    return runs[at[first]], first, last, sums


def spans_of_task(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rk = WordHashes(), RabinKarp()
        for batch in batches:
            found = []
            for n, text in enumerate(batch.column(1).to_pylist()):
                words = encoded(text).split()
                if len(words) >= window:
                    keys, first, last, sums = anchors_of(hashes.of(words), rk, window, anchor)
                    found.append((np.full(len(keys), n), keys, rk.runs(sums, first, last + window), first, last))
            if found:
                n, keys, spans, first, last = map(np.concatenate, zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(n)),
                        pa.array(keys.view(np.int64)),
                        pa.array(spans.view(np.int64)),
                        pa.array(first.astype(np.int32)),
                        pa.array(last.astype(np.int32)),
                    ],
                    ["doc_id", "anchor", "span", "first", "last"],
                )

    return run


def windows_of_task(window: int):
    """A row per window of the listed spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rk = WordHashes(), RabinKarp()
        for batch in batches:
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                sums = rk.prefixes(hashes.of(encoded(text).split()))
                at = [np.arange(s["first"], s["last"] + 1) for s in spans]
                sizes = [len(a) for a in at]
                starts = np.concatenate(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc] * len(starts), batch.schema.field("doc_id").type),
                        pa.array(np.repeat([s["anchor"] for s in spans], sizes).astype(np.int64)),
                        pa.array(rk.runs(sums, starts, starts + window).view(np.int64)),
                        pa.array(starts.astype(np.int32)),
                        pa.array(np.repeat([s["weight"] for s in spans], sizes).astype(np.int32)),
                    ],
                    ["doc_id", "anchor", "hash", "start", "weight"],
                )

    return run


def without_windows(window: int):
    """Words outside the removal intervals, joined by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, removed = [], [], []
            for text, hits in zip(batch.column("_text").to_pylist(), batch.column("_hits").to_pylist()):
                words = encoded(text).split()
                if hits:
                    edges = np.zeros(len(words) + 1, np.int64)
                    for a, b in ((x["first"], x["last"] + window) for x in hits):
                        edges[a] += 1
                        edges[b] -= 1
                    keep = np.cumsum(edges)[:-1] == 0
                    kept = [w for w, k in zip(words, keep) if k]
                else:
                    kept = words
                texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
                total.append(len(words))
                removed.append(len(words) - len(kept))
            names = [n for n in batch.schema.names if n not in ("_text", "_hits")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                [*names, "_text", "n_words", "n_removed"],
            )

    return run


@own_names
def substring_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR
) -> DataFrame:
    """``docs`` without the words that a window occurring twice or more covers.

    A window is ``window`` consecutive words of one document; it is repeated if its
    words also start anywhere else, in the same document or another.  Overlapping
    repeated windows merge into one interval.  The text becomes the kept words,
    joined by one blank (of a null text, an empty one); n_words and n_removed are
    added and take the place of old columns of these names.  Ids must be unique to
    tell documents apart: rows of one id lose the windows of each other's places.
    Rows without an id lose nothing and count for nothing.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    source = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spans = source.mapInArrow(
        spans_of_task(window, anchor), f"doc_id {id_type}, anchor long, span long, first int, last int"
    )
    often = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("_all")).where(F.col("_all") > 1).select("anchor")
    spans = shared_table(spans.join(often, "anchor"), "repeated-anchors")
    by_span = spans.groupBy("anchor", "span").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "first", "last")).alias("at")
    )
    some_alone = by_span.where(F.col("n") == 1).select("anchor").distinct()
    whole = by_span.where(F.col("n") > 1).select("anchor", "span")
    single = by_span.join(some_alone, "anchor")
    # Spans to look into: those that stand alone, and one copy of each repeated one beside them.
    open_spans = single.select(
        F.col("at.doc_id").alias("doc_id"),
        F.struct("anchor", F.col("at.first").alias("first"), F.col("at.last").alias("last"), F.least("n", F.lit(2)).cast("int").alias("weight")).alias("_span"),
    )
    asked = open_spans.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("_span").alias("spans"))
    windows = (
        source.join(asked, F.col("doc_id") == F.col("_id"))
        .select("doc_id", "text", "spans")
        .mapInArrow(windows_of_task(window), f"doc_id {id_type}, anchor long, hash long, start int, weight int")
    )
    repeated = windows.groupBy("anchor", "hash").agg(F.sum("weight").alias("_n")).where(F.col("_n") > 1).drop("_n")
    hits = windows.where(F.col("weight") == 1).join(repeated, ["anchor", "hash"]).select("doc_id", F.col("start").alias("first"), F.col("start").alias("last"))
    hits = hits.unionByName(spans.join(whole, ["anchor", "span"]).select("doc_id", "first", "last"))
    per_doc = hits.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("first", "last")).alias("_hits"))
    rest = docs.drop("n_words", "n_removed")
    joined = rest.withColumnRenamed(text, "_text").join(per_doc, F.col(doc_id) == F.col("_id"), "left").drop("_id")
    kept = [f for f in joined.schema.fields if f.name not in ("_text", "_hits")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "_text string, n_words long, n_removed long"])
    out = joined.mapInArrow(without_windows(window), schema).withColumnRenamed("_text", text)
    return out.select(*[f"`{c}`" for c in rest.columns], "n_words", "n_removed")
