"""Line dedup by two Bloom filters.

One pass over the documents marks, in filters of a fixed size, the hashes of lines
seen once and of lines seen twice; the filters of all tasks meet chunk by chunk, and
what two tasks saw once each counts as seen twice.  A second pass shuffles only the
digests of lines in the "twice" filter, where their documents are counted exactly:
a false alarm of the filter costs a row, never a line.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import encoded, join_uneven, own_names, shared_table

#: White space that bytes.strip() takes off: \\x20 and \\x09-\\x0D.
LEAST_CHARS = 10
#: Bits of each filter for a line of the input, rounded up to a power of two: 2 probes then
#: fill a fifth of it at most.  A task holds two filters, the driver one.
BITS_PER_LINE = 8
#: 1 MB at least and 64 MB at most; the most is enough for 67 million lines (and for 270 million
#: fills two thirds: then about 4 lines in 10 shuffle without need).
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 29
PROBES = 2
CHUNK_BYTES = 1 << 16


def filter_bits_for(docs: DataFrame, text: str) -> int:
    """Bits of a filter for as many lines as ``docs`` has."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    wanted = BITS_PER_LINE * (docs.select(F.sum(lines.cast("long"))).first()[0] or 0)
    return min(max(1 << max(wanted - 1, 1).bit_length(), LEAST_BITS), MOST_BITS)


def keys_of(text: str | None, least_chars: int) -> list[bytes | None]:
    """The key of each line; None for one that is too short to count."""
    found = []
    for line in encoded(text).split(b"\n"):
        key = line.strip().lower()
        # Code points: bytes that do not continue one.
        long_enough = len(key) >= least_chars and (
            key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= least_chars
        )
        found.append(key if long_enough else None)
    return found


def probes_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places in the filter, a row for each probe."""
    step = hashes >> np.uint64(32) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) % np.uint64(bits) for k in range(PROBES)])


def has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.all(bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8) & 1, axis=0).astype(bool)


def add(bitmap: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, places.ravel() >> np.uint64(3), np.uint8(1) << (places.ravel() & np.uint64(7)).astype(np.uint8))


def filters_of_task(bits: int, least_chars: int):
    """Per task: chunks of its two filters, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            found: list[int] = []
            for text in batch.column(0).to_pylist():
                found += {xxhash.xxh3_64_intdigest(k) for k in keys_of(text, least_chars) if k is not None}
            hashes, counts = np.unique(np.array(found, np.uint64), return_counts=True)
            places = probes_of(hashes, bits)
            again = has(once, places) | (counts > 1)
            add(twice, places[:, again])
            add(once, places)
        for start in range(0, bits // 8, CHUNK_BYTES):
            a, b = (x[start : start + CHUNK_BYTES] for x in (once, twice))
            if a.any():
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([start // CHUNK_BYTES], pa.int32()),
                        "once": [zlib.compress(a.tobytes(), 1)],
                        "twice": [zlib.compress(b.tobytes(), 1)],
                    }
                )

    return run


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by chunk: fold them, keeping one chunk in memory."""
    at, once, twice = None, None, None

    def done():
        return pa.RecordBatch.from_pydict({"chunk": pa.array([at], pa.int32()), "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)]})

    for batch in batches:
        for chunk, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if chunk != at:
                if at is not None:
                    yield done()
                at, once, twice = chunk, a.copy(), b.copy()
            else:
                twice |= b | (once & a)
                once |= a
    if at is not None:
        yield done()


def repeated_filter(docs: DataFrame, text: str, bits: int, least_chars: int) -> np.ndarray:
    """The "twice" filter of all documents: ``bits`` / 8 bytes, whatever the input."""
    schema = "chunk int, once binary, twice binary"
    parts = docs.select(text).mapInArrow(filters_of_task(bits, least_chars), schema)
    # Two levels, so that no task folds more than a share of the tasks' filters.
    for keys in ([F.col("chunk"), F.pmod(F.spark_partition_id(), F.lit(64))], [F.col("chunk")]):
        parts = parts.withColumn("_share", keys[-1]).repartition("chunk", "_share")
        parts = parts.sortWithinPartitions("chunk").drop("_share").mapInArrow(merged, schema)
    whole = np.zeros(bits // 8, np.uint8)
    for row in parts.select("chunk", "twice").toLocalIterator():
        piece = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
        start = row["chunk"] * CHUNK_BYTES
        whole[start : start + len(piece)] |= piece
    return whole


def suspects(shared, bits: int, least_chars: int):
    """(digest, doc_id) of each line that the filter has seen twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            keys: list[bytes] = []
            owners: list[int] = []
            for n, text in enumerate(batch.column(1).to_pylist()):
                own = {k for k in keys_of(text, least_chars) if k is not None}
                keys += own
                owners += [n] * len(own)
            hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
            at = np.flatnonzero(has(twice, probes_of(hashes, bits)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_digest(keys[i]) for i in at], pa.binary()),
                    batch.column(0).take(pa.array([owners[i] for i in at], pa.int32())),
                ],
                ["digest", "doc_id"],
            )

    return run


def without_lines(least_chars: int):
    """Text without the lines whose digests the row lists; counts of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, dropped = [], [], []
            for text, drops in zip(batch.column("_text").to_pylist(), batch.column("_drops").to_pylist()):
                parts = ("" if text is None else text).split("\n")
                lines.append(len(parts))
                if not drops:
                    texts.append(text)
                    dropped.append(0)
                    continue
                drops = set(drops)
                keep = [p for p, k in zip(parts, keys_of(text, least_chars)) if k is None or xxhash.xxh3_128_digest(k) not in drops]
                dropped.append(len(parts) - len(keep))
                texts.append("\n".join(keep))
            yield pa.RecordBatch.from_arrays(
                [
                    *[c for c, n in zip(batch.columns, batch.schema.names) if n not in ("_text", "_drops")],
                    pa.array(texts, pa.string()),
                    pa.array(lines, pa.int64()),
                    pa.array(dropped, pa.int64()),
                ],
                [*[n for n in batch.schema.names if n not in ("_text", "_drops")], "_text", "n_lines", "n_dropped"],
            )

    return run


@own_names
def line_dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    least_chars: int = LEAST_CHARS,
    filter_bits: int | None = None,
) -> DataFrame:
    """``docs`` with repeated lines left only in their first document.

    A line's key is the line without white space at its ends, A-Z lower-cased.  A
    key of ``least_chars`` code points or more that two documents hold stays in the
    one of the smallest id, there with all its repeats.  Adds n_lines (before) and
    n_dropped; columns of these names give way.  A null text counts as one empty
    line and stays null.  Rows of one id are one document; rows without an id
    neither lose lines nor take any from others.  ``filter_bits`` goes by the number
    of lines where it is not given; with more lines than it can tell apart, more rows
    shuffle and the result is the same.  Of an empty table the result is empty.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(doc_id).isNotNull())
    filter_bits = filter_bits or filter_bits_for(known, text)
    if filter_bits % (8 * CHUNK_BYTES):
        raise ValueError(f"filter_bits must be a multiple of {8 * CHUNK_BYTES}")
    shared = spark.sparkContext.broadcast(repeated_filter(known, text, filter_bits, least_chars).tobytes())
    id_type = docs.schema[doc_id].dataType.simpleString()
    found = shared_table(
        known.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
            suspects(shared, filter_bits, least_chars), f"digest binary, doc_id {id_type}"
        ),
        "suspect-lines",
    )
    firsts = shared_table(
        found.groupBy("digest")
        .agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_first") < F.col("_last")),
        "repeated-lines",
    )
    drops = (
        # A digest and an id are longer than a digest, and equal none.
        join_uneven(found, firsts, "digest", "_n", F.concat("digest", F.encode(F.col("doc_id").cast("string"), "utf-8")))
        .where(F.col("doc_id") > F.col("_first"))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.collect_set("digest").alias("_drops"))
    )
    rest = docs.drop("n_lines", "n_dropped")
    joined = rest.withColumnRenamed(text, "_text").join(drops, F.col(doc_id) == F.col("_id"), "left").drop("_id")
    kept = [f for f in joined.schema.fields if f.name not in ("_text", "_drops")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "_text string, n_lines long, n_dropped long"])
    out = joined.mapInArrow(without_lines(least_chars), schema).withColumnRenamed("_text", text)
    return out.select(*[f"`{c}`" for c in rest.columns], "n_lines", "n_dropped")
