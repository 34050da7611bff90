"""Ordered windows that survive a hot conversation.

A window partitioned by conversation puts the whole conversation into one task.
Here a conversation is cut into blocks of ``block_rows`` consecutive positions,
and windows run per (conversation, block):

* a bounded look-back (the last n rows) gets the last rows of the block before
  as a *halo*: they take part in the window and are dropped afterwards;
* an unbounded running value (sum, maximum, last value) gets what the blocks
  before amount to, from a summary of one row per block of the long conversations.

Either way the result is that of the plain window, whatever the block size.
Positions must be dense (0, 1, 2, ...) within a conversation; where a table has
none, ``number_rows`` makes them under the same rule.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
HALO = "_halo"


def shared_folder(spark) -> str:
    """A folder that driver and executors share.

    The one that ``spark.checkpoint.dir`` names; where that is unset, one beside the
    tables of the warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or spark.conf.get("spark.sql.warehouse.dir") + "/_shared"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table that several branches of a plan read, and read it back.

    Each branch then reads just its columns, nothing upstream runs twice, and a
    lost executor costs no more than its own tasks.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def number_rows(
    df: DataFrame, key: str, order: list[str], chunk: Column, out: str = "pos"
) -> DataFrame:
    """Dense positions from 0 per key.

    ``chunk`` must rise with the order (for example hours since the epoch, or an
    id divided by some thousands); one chunk of one key is one window.
    """
    marked = df.withColumn("_chunk", chunk)
    sizes = marked.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        key, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    return (
        marked.join(offsets, [key, "_chunk"])
        .withColumn(out, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_chunk", "_offset")
    )


def block_of(pos: str, block_rows: int) -> Column:
    return F.call_function("div", F.col(pos), F.lit(block_rows))


def with_blocks(df: DataFrame, pos: str, block_rows: int) -> DataFrame:
    """Assign blocks once, so that several running values share one shuffle."""
    return df if BLOCK in df.columns else df.withColumn(BLOCK, block_of(pos, block_rows))


def with_halo(df: DataFrame, pos: str, lookback: int, block_rows: int) -> DataFrame:
    """Assign blocks; the last ``lookback`` rows of a block also go to the next one."""
    block_rows = max(block_rows, lookback, 1)
    own = block_of(pos, block_rows)
    near_end = F.col(pos) % block_rows >= block_rows - lookback
    return df.withColumn(
        BLOCK, F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own)))
    ).withColumn(HALO, F.col(BLOCK) != own)


def block_window(key: str, pos: str):
    """Window over one block of one conversation, in order of position."""
    return Window.partitionBy(key, BLOCK).orderBy(pos)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(BLOCK, HALO)


def look_back(
    df: DataFrame, key: str, pos: str, columns: dict, lookback: int, block_rows: int
) -> DataFrame:
    """Add window columns that look at most ``lookback`` rows back.

    ``columns`` maps a name to a function from a window to a column.
    """
    out = with_halo(df, pos, lookback, block_rows)
    window = block_window(key, pos)
    out = out.select("*", *[make(window).alias(name) for name, make in columns.items()])
    return drop_halo(out)


def running(
    df: DataFrame,
    key: str,
    pos: str,
    value: Column,
    out: str,
    how: str = "sum",
    block_rows: int = 100_000,
    before: bool = False,
) -> DataFrame:
    """Running sum or maximum of ``value`` per key, over all rows so far.

    With ``before`` the row itself does not count.  The value may be a struct
    when ``how`` is "max".
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    own_blocks = BLOCK not in df.columns
    marked = with_blocks(df, pos, block_rows).withColumn("_value", value)
    # Only conversations of more than one block have anything to carry.  They are
    # few, so that the summary is small and joining it needs no shuffle of the rows.
    long_ones = marked.where(F.col(pos) >= block_rows).select(key).distinct()
    spanning = marked.select(key, BLOCK, "_value").join(long_ones, key, "left_semi")
    summary = spanning.groupBy(key, BLOCK).agg(fold("_value").alias("_total"))
    earlier = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(key, BLOCK, fold("_total").over(earlier).alias("_carry"))
    end = -1 if before else Window.currentRow
    here = block_window(key, pos).rowsBetween(Window.unboundedPreceding, end)
    joined = marked.join(carry, [key, BLOCK], "left").withColumn("_here", fold("_value").over(here))
    if how == "sum":
        total = F.coalesce("_carry", F.lit(0)) + F.coalesce("_here", F.lit(0))
    else:
        total = F.greatest("_carry", "_here")
    done = joined.withColumn(out, total).drop("_value", "_carry", "_here")
    return done.drop(BLOCK) if own_blocks else done


def last_value(
    df: DataFrame,
    key: str,
    pos: str,
    value: Column,
    out: str,
    block_rows: int = 100_000,
    before: bool = False,
) -> DataFrame:
    """Latest non-null ``value`` per key so far (with ``before``: not this row's)."""
    seen = F.when(value.isNotNull(), F.struct(F.col(pos).alias("at"), value.alias("value")))
    found = running(df, key, pos, seen, "_latest", "max", block_rows, before)
    return found.withColumn(out, F.col("_latest.value")).drop("_latest")
