"""Readers, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.jsonio import encode_image

_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(),
          "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _schema(**fields) -> T.StructType:
    return T.StructType(
        [T.StructField(n, _TYPES[t] if isinstance(t, str) else t) for n, t in fields.items()]
    )


ATTACHMENT = _schema(url="string", width="int", height="int")
MESSAGE_SCHEMA = _schema(
    msg_id="long", channel_id="long", conv_id="long", turn="long", ts="timestamp", author_id="long",
    author_name="string", is_bot="boolean", content="string", ref_msg_id="long",
    mentioned_ids=T.ArrayType(T.LongType()), attachments=T.ArrayType(ATTACHMENT),
)
TOKEN_SCHEMA = _schema(request_id="long", seq="long", ts="timestamp", raw="string")
RESPONSE_SCHEMA = _schema(request_id="long", body="string")
LOG_SCHEMA = _schema(ts="timestamp", source="string", message="string", exception="string")
USER_SCHEMA = _schema(user_id="long", username="string", nickname="string", display_name="string")
CHANNEL_SCHEMA = _schema(channel_id="long", name="string")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, cast to its types; a missing one is null."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema) if fmt == "json" else spark.read
    return conform(reader.format(fmt).load(path), schema)


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, MESSAGE_SCHEMA)


def read_dims(
    spark: SparkSession, users_path: str, channels_path: str, fmt: str = "parquet"
) -> tuple[DataFrame, DataFrame]:
    """Member and channel tables.  No broadcast hint: they grow with the data, and
    Spark broadcasts them by itself when they are small enough."""
    return (
        _read(spark, users_path, fmt, USER_SCHEMA),
        _read(spark, channels_path, fmt, CHANNEL_SCHEMA),
    )


def read_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Raw response bodies; as "text", one body per line and no request id."""
    if fmt == "text":
        return spark.read.text(path).select(
            F.lit(None).cast("bigint").alias("request_id"), F.col("value").alias("body")
        )
    return _read(spark, path, fmt, RESPONSE_SCHEMA)


def read_logs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, fmt, LOG_SCHEMA)


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Attachment files as base64 text."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", encode_image(F.col("content")).alias("image"))


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Files of a folder as a stream."""
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def read_messages_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return read_stream(spark, path, MESSAGE_SCHEMA, fmt, **options)


def read_tokens_stream(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    return read_stream(spark, path, TOKEN_SCHEMA, fmt, **options)
