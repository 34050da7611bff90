"""Quality classifier: logistic regression on hashed word n-grams.

Training follows the regularised leader, coordinate by coordinate, over a bounded
sample of labelled rows in one task; the weights are an array of fixed size, which
every task gets, and scoring is a sparse dot product per text, with no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import WordHashes, encoded, mixed, own_names

#: Weights; as float32 they are 1 MB.
BUCKETS = 1 << 18
#: Labelled rows that training reads at most: those of the smallest hashes of their ids.
TRAIN_ROWS = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5

_CLASSES = bytes.maketrans(
    bytes(range(256)),
    bytes(
        ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 else ord("0") if 48 <= c <= 57 else ord("x") if c > 127 else c
        for c in range(256)
    ),
)


class ShapeHashes(WordHashes):
    """Hash of a word's shape: its kinds of characters, without repeats."""

    def __init__(self):
        super().__init__()
        # Apart from the words: a shape, such as x, may be a word of another shape.
        self.by_shape = WordHashes()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.by_shape[re.sub(rb"(.)\1+", rb"\1", word.translate(_CLASSES), flags=re.S)]
        return value


class Features:
    """Buckets and values of a text: 1- and 2-grams of words, 1- to 3-grams of shapes and repeats."""

    def __init__(self):
        self.words, self.shapes = WordHashes(), ShapeHashes()

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        w = encoded(text).split()
        if not w:
            return np.zeros(1, np.int64), np.ones(1, np.float32)
        h, s = self.words.of([x.lower() for x in w]), self.shapes.of(w)
        same = np.r_[False, h[1:] == h[:-1]].astype(np.uint64)
        grams = [h]
        with np.errstate(over="ignore"):
            grams.append(h[:-1] * np.uint64(3) + h[1:])
            for stream, salt in ((s, 0x51), (same, 0xA7)):
                gram = stream + np.uint64(salt)
                grams.append(mixed(gram))
                for n in (1, 2):
                    if len(stream) > n:
                        gram = mixed(gram[: len(stream) - n]) + stream[n:]
                        grams.append(mixed(gram + np.uint64(n)))
            at = (mixed(np.concatenate(grams)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
        at, counts = np.unique(at, return_counts=True)
        values = np.sqrt(counts.astype(np.float32))
        values /= np.sqrt(counts.sum())
        # Bucket 0 is the intercept.
        return np.r_[0, at], np.r_[np.float32(1), values]


class Leader:
    """Follow the regularised leader, with a learning rate for each coordinate."""

    def __init__(self):
        self.z, self.n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features, leader, rows = Features(), Leader(), []
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            at, values = features.of(text)
            rows.append((at.astype(np.int32), values, label))  # some 10 KB a row
    for _ in range(EPOCHS):
        for row in rows:
            leader.learn(*row)
    weights = leader.weights(slice(None)).astype(np.float32)
    yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()]})


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label", most_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Weights from ``labels`` (doc_id, label 0/1) of at most ``most_rows`` ids.

    Null ids and labels teach nothing; of several labels of an id the largest counts.
    Without any labelled text all weights are 0, and so each score is 0.5.
    """
    chosen = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(label).cast("int").alias("label"))
        .withColumn("_hash", F.xxhash64("_id"))
        .orderBy("_hash", "_id")
        .limit(most_rows)
    )
    # At most ``most_rows`` rows of three numbers: a broadcast of known size.
    rows = (
        docs.select(doc_id, F.col(text).alias("text"))
        .join(F.broadcast(chosen), F.col(doc_id) == F.col("_id"))
        .select("_hash", "_id", "text", "label")
        .repartition(1)
        .sortWithinPartitions("_hash", "_id", "text")
    )
    model = rows.mapInArrow(train, "weights binary").first()
    return np.frombuffer(model["weights"], np.float32) if model else np.zeros(BUCKETS, np.float32)


def scores_of_task(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, features = np.frombuffer(shared.value, np.float32), Features()
        for batch in batches:
            scores = []
            for text in batch.column("_text").to_pylist():
                at, values = features.of(text)
                scores.append(float(1 / (1 + np.exp(-np.clip(np.float64(weights[at] @ values), -30, 30)))))
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(scores, pa.float64())], [*names, "score"])

    return run


@own_names
def quality_scores(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and score of every row; a null or empty text has the intercept's."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.tobytes())
    kept = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "score double"])
    return docs.select(*[f"`{f.name}`" for f in kept], F.col(text).alias("_text")).mapInArrow(scores_of_task(shared), schema)
