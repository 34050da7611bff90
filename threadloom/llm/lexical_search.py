"""Ranked lexical search over hashed max-sketches.

The index has a row for each document: its terms with their frequencies, and a sketch.
Terms hash to coordinates, and each coordinate keeps the largest frequency of its terms.
A document's impact rises with the frequency, so that this gives the largest impact of the
coordinate for whatever document count and mean length the corpus has by now: the index
needs no statistics of the corpus, and takes in new documents without a change to old rows.

A batch of queries is one matrix of term weights by coordinate; sketches times it are upper
bounds of all scores of a block of documents.  For each query a task rescores exactly,
in order of falling bound, until the bound is below the task's own k-th score; few
documents are ever scored.  Each task hands on its k best, and these meet in two steps.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from threadloom.llm.common import WordHashes, encoded, own_names, shared_table

TOP = 20
#: A sketch has from LOAD up to twice LOAD coordinates for each term, within these sizes.
LOAD, FEWEST, MOST = 4, 256, 1 << 14
#: Distinct (item, term) pairs of a batch of queries, and queries, which tasks hold at once.
BATCH_PAIRS, BATCH_ITEMS = 200_000, 512
#: Cells of a block of sketches, and documents whose bounds are sorted together.
CELLS, PART_ROWS = 1 << 20, 2048
#: Terms whose hashes a task remembers.
KNOWN_TERMS = 100_000
#: Rows in which what tasks have found meets first, for each query.
MEETINGS = 16

_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and other than ASCII characters, A-Z lower-cased."""
    return encoded(text).translate(_BYTES).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """In whole numbers, rounded down: what a term of this frequency adds for each unit of weight."""
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


# --- index -------------------------------------------------------------------


def size_of_sketch(n_terms: int) -> int:
    return min(MOST, max(FEWEST, 1 << (LOAD * n_terms - 1).bit_length()))


def max_sketch(hashes: np.ndarray, tfs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates that have terms, and the largest frequency in each."""
    at = (hashes & np.uint64(size - 1)).astype(np.int32)
    order = np.lexsort((-tfs, at))
    at, tfs = at[order], tfs[order]
    first = np.concatenate(([True], at[1:] != at[:-1])) if len(at) else np.zeros(0, bool)
    return at[first], tfs[first]


def indexing(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(KNOWN_TERMS)
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    words = terms_of(text)
                    counts = Counter(words)
                    tfs = np.fromiter(counts.values(), np.int32, len(counts))
                    at, top = max_sketch(hashes.of(counts), tfs, size_of_sketch(len(counts)))
                    rows.append((len(words), b" ".join(counts), tfs.tobytes(), at.tobytes(), top.tobytes()))
                n, terms, tfs, at, top = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (terms, tfs, at, top))],
                    ["doc", "n", "terms", "tfs", "at", "top"],
                )

    return run


@own_names
def lexical_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, terms, tfs, at, top) of each row of ``docs``, written as a table.

    A null or empty text, or one without terms, has n = 0.  Other columns are not read.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc"].dataType
    schema = f"doc {kind.simpleString()}, n long, terms binary, tfs binary, at binary, top binary"
    return shared_table(rows.mapInArrow(indexing(arrow_type(rows, "doc")), schema), "lexical-index")


def arrow_type(rows: DataFrame, column: str) -> pa.DataType:
    kind = StructType([StructField("k", rows.schema[column].dataType)])
    return rows.sparkSession.createDataFrame([], kind).toArrow().schema.field("k").type


# --- queries -----------------------------------------------------------------


@dataclass
class Batch:
    """Queries that are looked up at once."""

    items: list
    terms: dict[bytes, int]  # number of each distinct term
    item_terms: list[np.ndarray]  # by item, numbers of its distinct terms
    repeats: list[np.ndarray]  # and how often it has each
    hashes: np.ndarray
    documents: int = 0
    words: int = 0
    weights: np.ndarray | None = None

    @classmethod
    def of(cls, queries: list[tuple]) -> Batch:
        terms: dict[bytes, int] = {}
        item_terms, repeats = [], []
        for _, text in queries:
            counts = Counter(terms_of(text))
            item_terms.append(np.array([terms.setdefault(t, len(terms)) for t in counts], np.int64))
            repeats.append(np.array(list(counts.values()), np.int64))
        return cls([i for i, _ in queries], terms, item_terms, repeats, WordHashes().of(terms))

    def weigh(self, documents: int, words: int, document_counts: dict[int, int]) -> None:
        self.documents, self.words = documents, words
        self.weights = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * document_counts.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64
        )

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents of n terms.  Whole numbers may grow past 64 bits on the way."""
        if self.documents * 25 * int(n.max(initial=0)) < 2**63:
            return 75 + (25 * n * self.documents) // self.words
        return np.array([75 + 25 * int(x) * self.documents // self.words for x in n], np.int64)

    def by_coordinate(self, size: int) -> np.ndarray:
        """Summed weights of the terms that hash to each coordinate, by item."""
        table = np.zeros((size, len(self.items)))
        at = (self.hashes & np.uint64(size - 1)).astype(np.int64)
        for i, (t, r) in enumerate(zip(self.item_terms, self.repeats)):
            np.add.at(table[:, i], at[t], self.weights[t] * r)
        return table


def batches_of(queries: DataFrame) -> Iterator[Batch]:
    """The queries (item, text) in batches of bounded size, by hash of the item.

    One item's terms are held whole; an item of more than ``BATCH_PAIRS`` terms makes its
    batch that much larger.
    """
    size = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    listed = shared_table(queries.withColumn("size", F.coalesce(size, F.lit(0))), "queries")
    items, pairs = listed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # Half of what a batch may hold is the mean, so that chance makes none too large.
    parts = max(1, -(-2 * items // BATCH_ITEMS) if items > BATCH_ITEMS else 1, -(-2 * pairs // BATCH_PAIRS) if pairs > BATCH_PAIRS else 1)
    for p in range(parts):
        rows = listed.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == p).select("item", "text").collect()
        if rows:
            yield Batch.of([tuple(r) for r in rows])


def counting(known: dict[bytes, int]):
    """Documents that hold each term of the batch, counted within the task."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for part in rows:
            for terms in part.column(0):
                counts.update(known.keys() & terms.as_py().split())
        found = [(known[t], c) for t, c in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([c for _, c in found], pa.int64())], ["term", "c"])

    return run


# --- search ------------------------------------------------------------------


class Best:
    """The k best (score, smaller id) of a query so far; a heap with the worst on top."""

    def __init__(self, k: int):
        self.k, self.heap, self.least = k, [], 1

    def add(self, score: int, key: Descending) -> None:
        if score < self.least:
            return
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, key))
        else:
            heapq.heappushpop(self.heap, (score, key))
        if len(self.heap) == self.k:
            self.least = self.heap[0][0]


class Descending:
    """An id whose order is turned round: a smaller id is better; none is worst."""

    __slots__ = ("id",)

    def __init__(self, id):  # noqa: A002
        self.id = id

    def __lt__(self, other: Descending) -> bool:
        if self.id is None or other.id is None:
            return self.id is None and other.id is not None
        return self.id > other.id


def searching(q: Batch, id_type: pa.DataType, k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        best = [Best(k) for _ in q.items]
        for batch in rows:
            for start in range(0, len(batch), PART_ROWS):
                part = batch.slice(start, PART_ROWS)
                part = part.filter(pc.greater(part.column("n"), 0))
                if len(part):
                    search_part(q, part, tables, best)
        found = [(i, key.id, score) for i, b in enumerate(best) for score, key in b.heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], id_type), pa.array([f[2] for f in found], pa.int64())],
            ["query", "doc", "score"],
        )

    return run


def search_part(q: Batch, part: pa.RecordBatch, tables: dict[int, np.ndarray], best: list[Best]) -> None:
    """Bounds of all queries for the documents of ``part``, and exact scores where they matter."""
    m = q.lengths(part.column("n").to_numpy(zero_copy_only=False))
    tfs = [np.frombuffer(b.as_buffer(), np.int32) for b in part.column("tfs")]
    at = [np.frombuffer(b.as_buffer(), np.int32) for b in part.column("at")]
    top = [np.frombuffer(b.as_buffer(), np.int32) for b in part.column("top")]
    sizes = np.array([size_of_sketch(len(t)) for t in tfs])
    bounds = np.empty((len(part), len(q.items)))
    for size in np.unique(sizes).tolist():
        if size not in tables:
            tables[size] = q.by_coordinate(size)
        of_size = np.flatnonzero(sizes == size)
        step = max(1, CELLS // size)
        for s in range(0, len(of_size), step):
            docs = of_size[s : s + step]
            block = np.zeros((len(docs), size))
            for row, d in enumerate(docs.tolist()):
                block[row, at[d]] = impacts(top[d], m[d])
            # Whole numbers below 2^53: sums are exact.
            bounds[docs] = block @ tables[size]
    # Of a document only its terms in the batch, worked out once; a row of zeros lends the rest.
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    row = np.zeros(len(q.terms), np.int64)

    def score(i: int, d: int) -> int:
        if d not in held:
            numbers = [(t, tf) for t, tf in zip(map(q.terms.get, part.column("terms")[d].as_py().split()), tfs[d].tolist()) if t is not None]
            t, tf = np.array(numbers, np.int64).reshape(-1, 2).T
            held[d] = t, impacts(tf, m[d]) * q.weights[t]
        t, values = held[d]
        row[t] = values
        total = int(row[q.item_terms[i]] @ q.repeats[i])
        row[t] = 0
        return total

    ids = part.column("doc").to_pylist()
    for i, b in enumerate(best):
        mine = bounds[:, i]
        worth = np.flatnonzero(mine >= b.least)
        for d in worth[np.argsort(-mine[worth], kind="stable")].tolist():
            if mine[d] < b.least:
                break
            b.add(score(i, d), Descending(ids[d]))


def lexical_search(index: DataFrame, queries: DataFrame, item_id: str = "item_id", text: str = "text", k: int = TOP) -> DataFrame:
    """(item, rank, doc, score): the ``k`` documents of ``index`` with the highest scores above 0.

    Equal scores stand by ascending id, documents without an id last; documents of one id
    are ranked each.  Queries of null or without terms find nothing; queries of one item and
    different texts are ranked together, equal rows of ``queries`` count once.  Tasks hold a
    batch of queries and k results for each; the collected queries are the stated query set, in
    batches of at most about ``BATCH_ITEMS`` items and ``BATCH_PAIRS`` terms.
    """
    asked = queries.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("text")).distinct()
    item_kind, doc_kind = asked.schema["item"].dataType.simpleString(), index.schema["doc"].dataType.simpleString()
    documents, words = index.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    results = index.sparkSession.createDataFrame([], f"item {item_kind}, doc {doc_kind}, score long")
    for batch in batches_of(asked) if documents else ():
        counts = index.select("terms").mapInArrow(counting(batch.terms), "term long, c long").groupBy("term").agg(F.sum("c").alias("c"))
        batch.weigh(documents, words, {r.term: r.c for r in counts.collect()})
        rows = index.mapInArrow(searching(batch, arrow_type(index, "doc"), k), f"query int, doc {doc_kind}, score long")
        names = index.sparkSession.createDataFrame(list(enumerate(batch.items)), f"query int, item {item_kind}")
        results = results.unionByName(rows.join(F.broadcast(names), "query").select("item", "doc", "score"))
    better = [F.desc("score"), F.asc_nulls_last("doc")]
    meeting = F.pmod(F.xxhash64("doc"), F.lit(MEETINGS))
    first = results.withColumn("_m", meeting).withColumn("_r", F.row_number().over(Window.partitionBy("item", "_m").orderBy(*better))).where(F.col("_r") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*better))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_id), "rank", "doc", "score")
