"""Running streams into tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

BatchFn = Callable[[DataFrame, int], DataFrame]


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Append a stream to a parquet table until its input is used up."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def epoch_path(path: str, epoch: int) -> str:
    return f"{path}/epoch={epoch}"


def in_batches(
    stream: DataFrame, work: BatchFn, path: str, checkpoint: str, mode: str = "append"
) -> None:
    """Write ``work(batch, epoch)`` of each micro-batch.

    An epoch overwrites its own folder, so a repeated epoch leaves no duplicates.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        work(batch, epoch).write.mode("overwrite").parquet(epoch_path(path, epoch))

    query = (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

