"""Writers for replies, requests and pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from threadloom.functions.jsonio import decode_image


def write_replies(df: DataFrame, path: str, mode: str = "append") -> None:
    """Replies linked to their messages."""
    df.write.mode(mode).parquet(path)


def stream_replies(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def write_requests(df: DataFrame, path: str, column: str = "request", mode: str = "overwrite") -> None:
    """One JSON document per line, for offline inference."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def image_rows(df: DataFrame, images: str = "images", selfie: str = "selfie") -> DataFrame:
    """One row per picture with its bytes and the file name that the selfie flag picks."""
    rest = [c for c in df.columns if c != images]
    return (
        df.select(*rest, F.posexplode(images).alias("image_no", "encoded"))
        .withColumn("content", decode_image(F.col("encoded")))
        .withColumn("file_name", F.when(F.col(selfie), "cutepic.png").otherwise("pic.png"))
        .drop("encoded")
    )


def write_images(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).partitionBy("selfie").parquet(path)
