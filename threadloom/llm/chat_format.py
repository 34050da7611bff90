"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, encoded once with character offsets, and the
sorted spans of its turns meet the sorted spans of its tokens by binary search, which
gives each token its place in the loss mask.

The template is

    <|im_start|>role<|im_sep|>text<|im_end|>

with its three marks as single tokens, so that no token reaches over the edge of a text
and the mask covers texts to the character.  ``<|`` never stands inside a role or text:
a backslash goes between the two characters, and one more where there are some already,
which ``unescape`` takes back.

Rows are dealt by ranges of (conversation, turn) and read in order as a stream: a
conversation of more than ``SEGMENT_CHARS`` characters continues in further segments, and
one that holds a large part of all rows lies in several tasks.  As marks are single tokens,
the tokens of the segments in a row are those of the whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from threadloom.llm.common import own_names, shared_table

START, SEP, END = MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
LEARNT = "assistant"
SEGMENT_CHARS = 1 << 18
#: A text is encoded in pieces of about so many characters.
PIECE_CHARS = 1 << 16

_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_TURN = re.compile("(?s)" + re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END))
#: Between a character and the white space after it, where no token of byte-level BPE reaches over.
_CUT = re.compile(r"(?<=\S)(?=\s)")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation or segment."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


# --- tokens ------------------------------------------------------------------


def tokenizer_of(file: str):
    """Tokenizer from the content of its file, with our marks and whole offsets."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_str(file)
    t.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])
    # A space before a word belongs to the word's token, in offsets too.
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """The text in pieces that are encoded apart as they are together."""
    found, start = [], 0
    while len(text) - start > most:
        cut = _CUT.search(text, start + most)
        if cut is None:
            break
        found.append(text[start : cut.start()])
        start = cut.start()
    return [*found, text[start:]]


def encoded_spans(tokenizer, formatted: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the tokens, and where each starts and ends in the text."""
    ids, starts, ends, at = [], [], [], 0
    for piece in pieces(formatted):
        e = tokenizer.encode(piece, add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2) + at
        ids.append(np.array(e.ids, np.int32))
        starts.append(spans[:, 0])
        ends.append(spans[:, 1])
        at += len(piece)
    return np.concatenate(ids), np.concatenate(starts), np.concatenate(ends)


def mask_of(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens have a character in one of the sorted ``spans``."""
    mask = np.zeros(len(starts), np.int8)
    if spans:
        begin, end = np.array(spans, np.int64).T
        first = np.searchsorted(ends, begin, side="right")
        last = np.searchsorted(starts, end, side="left")
        for a, b in zip(first.tolist(), last.tolist()):
            mask[a:b] = 1
    return mask


# --- formatting --------------------------------------------------------------


class Segment:
    """Turns of one conversation, being rendered."""

    def __init__(self, key):
        self.key, self.parts, self.chars, self.turns, self.spans = key, [], 0, 0, []

    def add(self, role: str | None, text: str | None) -> None:
        head, body = f"{START}{escape(role or '')}{SEP}", escape(text or "")
        begin = self.chars + len(head)
        if role == LEARNT and body:
            self.spans.append((begin, begin + len(body)))
        self.parts += (head, body, END)
        self.chars = begin + len(body) + len(END)
        self.turns += 1


def formatting(file: Broadcast, key_type: pa.DataType, segment_chars: int):
    """Rows (part, conversation, role, text) in order, as segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(file.value)
        done, current, part, number = [], None, 0, 0

        def close(s: Segment) -> None:
            nonlocal number
            formatted = "".join(s.parts)
            ids, starts, ends = encoded_spans(tokenizer, formatted)
            done.append((s.key, part, number, s.turns, formatted, ids, mask_of(starts, ends, s.spans)))
            number += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done))
            arrays = [
                pa.array(columns[0], key_type),
                pa.array(columns[1], pa.int32()),
                pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.int64()),
                pa.array(columns[4], pa.string()),
                pa.array(columns[5], pa.list_(pa.int32())),
                pa.array(columns[6], pa.list_(pa.int8())),
            ]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, ["_key", "part", "segment", "turns", "formatted", "tokens", "loss_mask"])

        ready = 0
        for rows in batches:
            for p, key, role, text in zip(*(c.to_pylist() for c in rows.columns)):
                part = p
                if current is None or current.key != key or current.chars >= segment_chars:
                    if current is not None:
                        close(current)
                        ready += current.chars
                    current = Segment(key)
                    if ready > 4 * SEGMENT_CHARS:
                        yield batch()
                        ready = 0
                current.add(role, text)
        if current is not None:
            close(current)
        if done:
            yield batch()

    return run


def format_chats(
    turns: DataFrame,
    tokenizer: str,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """(conversation, part, segment, turns, formatted, tokens, loss_mask): training examples.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library, which
    only the driver reads.  Turns stand in order of ``turn``, nulls first; those of one
    number in an order that role and text settle.  Null roles and texts count as empty, rows without a
    conversation are one of their own; repeated rows are turns like others.  A conversation
    longer than ``segment_chars`` has several segments, in order of (part, segment), and
    their texts and tokens in a row are those of the conversation.  loss_mask is 1 for
    each token of an assistant's text.  An empty table gives an empty one; other columns
    of ``turns`` are not read.
    """
    spark = turns.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())
    rows = turns.select(*[F.col(f"`{c}`").alias(a) for c, a in zip((conversation, turn, role, text), ("_key", "_turn", "_role", "_text"))])
    order = ["_key", "_turn", "_role", "_text"]
    # By the hash of the text, not the text: range bounds are held by the driver.
    dealt = rows.withColumn("_hash", F.xxhash64("_text")).repartitionByRange("_key", "_turn", "_role", "_hash")
    # Texts of one place and role in order of the hash: the same in every task.
    ordered = dealt.sortWithinPartitions("_key", "_turn", "_role", "_hash", "_text")
    sample = spark.createDataFrame([], StructType([StructField("k", rows.schema["_key"].dataType)])).toArrow()
    schema = f"_key {rows.schema['_key'].dataType.simpleString()}, part int, segment long, turns long, formatted string, tokens array<int>, loss_mask array<tinyint>"
    made = ordered.select(F.spark_partition_id().alias("_part"), "_key", "_role", "_text").mapInArrow(
        formatting(file, sample.schema.field("k").type, segment_chars), schema
    )
    return made.withColumnRenamed("_key", conversation)


# --- reading back ------------------------------------------------------------


def reading(file: Broadcast, key_type: pa.DataType):
    """Figures of conversations from their segments in order, a hash state at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(file.value)
        done, key, state = [], None, None

        def close() -> tuple:
            turns, loss, n, loss_chars, chars = state
            return key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        def batch() -> pa.RecordBatch:
            kinds = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, ["_key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for rows in batches:
            for k, formatted, ids, mask in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), rows.column(3)):
                if state is None or k != key:
                    if state is not None:
                        done.append(close())
                    key, state = k, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, text in turns_of(formatted):
                    state[0].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    state[2] += 1
                for run_ in masked_runs(ids.values.to_numpy(), mask.values.to_numpy()):
                    text = unescape(tokenizer.decode(run_.tolist(), skip_special_tokens=False))
                    state[1].update(text.encode("utf-8", "surrogatepass"))
                    state[3] += len(text)
                state[4] += len(formatted)
            if len(done) > 10_000:
                yield batch()
        if state is not None:
            done.append(close())
        if done:
            yield batch()

    return run


def masked_runs(ids: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    """Tokens of each unbroken stretch under the mask: an assistant's text each."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0]))))
    return [ids[a:b] for a, b in edges.reshape(-1, 2).tolist()]


def read_back(formatted: DataFrame, tokenizer: str, conversation: str = "conv_id") -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    All from the output of ``format_chats``: turns are parsed from the text, the loss text is
    what the tokens under the mask decode to.  A digest runs over a conversation in
    order, so that a long one is read by one task, as a stream of its segments.
    """
    sc: SparkContext = formatted.sparkSession.sparkContext
    with open(tokenizer, encoding="utf-8") as f:
        file = sc.broadcast(f.read())
    kind = formatted.schema[conversation].dataType
    key_type = formatted.sparkSession.createDataFrame([], StructType([StructField("k", kind)])).toArrow().schema.field("k").type
    rows = (
        formatted.withColumnRenamed(conversation, "_key")
        .repartition("_key")
        .sortWithinPartitions("_key", "part", "segment")
        .select("_key", "formatted", "tokens", "loss_mask")
    )
    schema = f"_key {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(reading(file, key_type), schema).withColumnRenamed("_key", conversation)
