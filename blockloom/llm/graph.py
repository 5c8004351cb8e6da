"""Connected components of an edge table by alternating large and small stars; all of it stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Large star: each node's larger neighbours go to the smallest of its neighbourhood. Small star: a node and its smaller neighbours do."""
    around = edges if small else edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    if small:
        return joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """edges: two bigint columns. Returns u, root for each node that isn't its component's smallest. A hot node's edges meet in a partial aggregate and a join that can be split."""
    a, b = edges.columns
    now = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        n = now.agg(F.count("*").alias("n"), F.countDistinct("u").alias("u")).first()
        if n.n == n.u and not now.select("v").distinct().join(now.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return now.withColumnRenamed("v", "root")
        now = stored(_star(_star(now, False).distinct(), True).distinct(), "edges")
