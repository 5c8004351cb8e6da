"""Blocks, rasters, byte strings and names derived from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block_id, frame, px: 64 samples."""
    sample = lambda e: F.least(F.greatest(F.floor(e.cast("double") * 256 + 128), F.lit(0)), F.lit(255)).cast("int")
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block_id"), F.col("label").alias("frame"), F.transform("embedding", sample).alias("px"))


def ras1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, v: a raster 150 wide."""
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(F.floor(k / 150).cast("int").alias("y"), (k % 150).cast("int").alias("x"), (F.floor(F.col("o_totalprice").cast("double")) % 256).cast("int").alias("v"))


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y, x, r, g, b: a raster 100 wide."""
    k = F.col("event_id")
    g = F.regexp_extract("props", r'"k": ([0-9]+)', 1).cast("int") % 256
    return _table(spark, sf_dir, "events").select(F.floor(k / 100).cast("int").alias("y"), (k % 100).cast("int").alias("x"), (F.floor("value") % 256).cast("int").alias("r"), g.alias("g"), (F.col("user_id") % 256).cast("int").alias("b"))


def hex_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("hex"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    chroma = F.element_at(F.array(F.lit("420"), F.lit("422"), F.lit("444")), (k % 3 + 1).cast("int"))
    depth = F.element_at(F.array(F.lit("8"), F.lit("10"), F.lit("12")), (F.floor(k / 3) % 3 + 1).cast("int"))
    path = F.concat(F.lit("clip_"), (F.col("p_size") * 16).cast("string"), F.lit("x"), (F.col("p_size") * 9).cast("string"), F.lit("_cf"), chroma, F.lit("_"), depth, F.lit("bps.yuv"))
    return _table(spark, sf_dir, "part").select(k.alias("id"), path.alias("path"))


#: The same views for the SQL twins.
SQL = {
    "blk": "blk AS (SELECT vec_id AS block_id, label AS frame, list_transform(embedding, lambda e: CAST(least(greatest(floor(CAST(e AS DOUBLE) * 256 + 128), 0), 255) AS INTEGER)) AS px FROM embeddings)",
    "ras1": "ras1 AS (SELECT CAST(o_orderkey // 150 AS INTEGER) AS y, CAST(o_orderkey % 150 AS INTEGER) AS x, CAST(CAST(floor(CAST(o_totalprice AS DOUBLE)) AS BIGINT) % 256 AS INTEGER) AS v FROM orders)",
    "rgb": "rgb AS (SELECT CAST(event_id // 100 AS INTEGER) AS y, CAST(event_id % 100 AS INTEGER) AS x, CAST(CAST(floor(value) AS BIGINT) % 256 AS INTEGER) AS r, CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS INTEGER) % 256 AS g, CAST(user_id % 256 AS INTEGER) AS b FROM events)",
    "bytes": "bytes AS (SELECT doc_id AS id, md5(text) AS hex FROM documents)",
    "names": "names AS (SELECT p_partkey AS id, 'clip_' || (p_size * 16) || 'x' || (p_size * 9) || '_cf' || (CASE p_partkey % 3 WHEN 0 THEN '420' WHEN 1 THEN '422' ELSE '444' END) || '_' || (CASE (p_partkey // 3) % 3 WHEN 0 THEN '8' WHEN 1 THEN '10' ELSE '12' END) || 'bps.yuv' AS path FROM part)",
}
