"""Encoding of a folder of frames as it fills. Frames are independent, so there is no state, and a checkpoint gives each frame once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.codec import Config, encode

SCHEMA = "frame int, planes array<array<int>>"


def encode_stream(spark: SparkSession, folder: str, cfg: Config) -> DataFrame:
    """A streaming DataFrame of frame, jpeg over the Parquet files that come into a folder."""
    return encode(spark.readStream.schema(SCHEMA).parquet(folder), cfg)


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, cfg: Config):
    """Encodes what is there and ends."""
    query = encode_stream(spark, folder, cfg).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
