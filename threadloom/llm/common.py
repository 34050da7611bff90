"""What several operators share: words, hashes, tables in the shared folder."""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words, as a class and as a list.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the folder that ``spark.checkpoint.dir`` names, and read it.

    This cuts lineage: what reads the table later survives a lost executor
    without the steps before.  Where the setting is unset, as in tests, the table
    goes beside those of the warehouse, which executors reach too.
    """
    spark = df.sparkSession
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    )
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_names(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let the operator's input have columns of any name.

    Operators name what they make on the way with a leading underscore.  Input columns
    of such names are called otherwise meanwhile, and get their names back in the result.
    """

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        theirs = [c for c in docs.columns if c.startswith("_")]
        taken = {c.lower() for c in docs.columns}
        free = (n for n in (f"theirs {i}" for i in itertools.count()) if n not in taken)
        meanwhile = dict(zip(theirs, free))

        def asked(v):
            if isinstance(v, tuple):
                return tuple(map(asked, v))
            return meanwhile.get(v, v) if isinstance(v, str) else v

        out = operator(docs.withColumnsRenamed(meanwhile), *map(asked, args), **{k: asked(v) for k, v in kwargs.items()})
        return out.withColumnsRenamed({v: k for k, v in meanwhile.items()})

    return run


def join_uneven(rows: DataFrame, values: DataFrame, key: str, n: str, elsewhere: Column, most_hot: int = 1000) -> DataFrame:
    """``rows`` (a written table) inner-joined with ``values`` by ``key``, where few keys may hold most rows.

    ``values`` has each key once, with the number ``n`` of its rows.  Keys that hold at least
    one in ``most_hot`` of all rows are no more than ``most_hot``: their values are broadcast, and
    their rows go by ``elsewhere``, which differs from row to row and equals no other key.  All
    others meet by shuffling, in the same pass.
    """
    names = [c for c in values.columns if c != key]
    least = max(rows.count() // most_hot, 2)
    found = F.struct(*names).alias("_found")
    hot = F.broadcast(values.where(F.col(n) >= least).select(key, found.alias("_hot")))
    even = values.where(F.col(n) < least).select(F.col(key).alias("_where"), found)
    marked = rows.join(hot, key, "left").withColumn("_where", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(elsewhere))
    joined = marked.join(even, "_where", "left").withColumn("_found", F.coalesce("_hot", "_found"))
    return joined.where(F.col("_found").isNotNull()).select(*rows.columns, *[F.col(f"_found.{c}").alias(c) for c in names])


# --- columns -----------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` worked out once, also where lambdas read it often."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column, between: str) -> Column:
    """What stands between matches of ``between``; of no or empty text, an empty array."""
    outer = lambda w: (F.get(w, F.lit(0)) == "") | (F.element_at(w, -1) == "")
    return let(
        F.split(F.coalesce(text, F.lit("")), between),
        lambda w: F.when(outer(w), F.filter(w, lambda x: x != "")).otherwise(w),
    )


def words(text: Column) -> Column:
    """Words between white space."""
    return split_words(text, SPACE)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


# --- inside tasks ------------------------------------------------------------


class WordHashes(dict):
    """64-bit hash by word; forgets all when it holds ``most`` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of the 64 over all of them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def encoded(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
