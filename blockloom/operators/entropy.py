"""Entropy model over rows (frame, block_id, k, v), k in scan order: prediction, run lengths, symbols, histograms, bit costs, rate and lambda. Relational throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import EXACT, canonical, standard

ZRL, EOB = 0xF0, 0


def long(df: DataFrame, zz: str, keys: tuple[str, ...] = ("frame", "block_id")) -> DataFrame:
    return df.select(*keys, F.posexplode(zz).alias("k", "v"))


def category(v: Column) -> Column:
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("bigint")))).cast("int")


def remainder(v: Column) -> Column:
    return F.when(v > 0, v).when(v < 0, v - 1 + F.pow(F.lit(2), category(v))).otherwise(0).cast("int")


def dc_delta(q: DataFrame, slice_: Column | None = None) -> DataFrame:
    keys = ["frame"] + ([slice_] if slice_ is not None else [])
    return q.where("k = 0").withColumn("delta", F.col("v") - F.lag("v", 1, 0).over(Window.partitionBy(*keys).orderBy("block_id")))


def dc_undelta(d: DataFrame) -> DataFrame:
    return d.withColumn("restored", F.sum("delta").over(Window.partitionBy("frame").orderBy("block_id").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def runs(q: DataFrame) -> DataFrame:
    before = F.lag("k", 1, 0).over(Window.partitionBy("frame", "block_id").orderBy("k"))
    return q.where("k > 0 and v <> 0").withColumn("run", F.col("k") - before - 1)


def symbols(q: DataFrame) -> DataFrame:
    """frame, block_id, class, symbol, nbits: DC categories, AC (run, category) pairs, runs of 16 zeros, ends of blocks."""
    n = category(F.col("v"))
    ac = runs(q)
    d = category(F.col("delta"))
    dc = dc_delta(q).select("frame", "block_id", F.lit("DC").alias("class"), d.alias("symbol"), d.alias("nbits"))
    pairs = ac.select("frame", "block_id", F.lit("AC").alias("class"), ((F.col("run") % 16) * 16 + n).cast("int").alias("symbol"), n.alias("nbits"))
    wide = ac.where("run >= 16").select("frame", "block_id", F.lit("AC").alias("class"), F.lit(ZRL).alias("symbol"), F.lit(0).alias("nbits"), F.explode(F.sequence(F.lit(1), F.floor(F.col("run") / 16).cast("int")))).drop("col")
    ends = q.groupBy("frame", "block_id").agg(F.max(F.when(F.col("v") != 0, F.col("k")).otherwise(0)).alias("last")).where("last < 63")
    ends = ends.select("frame", "block_id", F.lit("AC").alias("class"), F.lit(EOB).alias("symbol"), F.lit(0).alias("nbits"))
    return dc.unionByName(pairs).unionByName(wide).unionByName(ends)


def histogram(s: DataFrame) -> DataFrame:
    return s.groupBy("frame", "class", "symbol").agg(F.count("*").alias("n"))


def code_table(df: DataFrame, table: int = 0) -> DataFrame:
    rows = [(kind, s, n, c) for kind in ("DC", "AC") for s, (n, c) in canonical(*standard(kind, table)).items()]
    return df.sparkSession.createDataFrame(rows, "class string, symbol int, len int, code int")


def bit_cost(s: DataFrame, codes: DataFrame, keys: tuple[str, ...] = ("frame",)) -> DataFrame:
    """Bits by key; a symbol without a code counts 16. A code table has at most 2 x 256 rows and is broadcast."""
    return s.join(F.broadcast(codes), ["class", "symbol"], "left").groupBy(*keys).agg(F.sum(F.coalesce("len", F.lit(16)) + F.col("nbits")).cast("bigint").alias("bits"))


def average_length(h: DataFrame, codes: DataFrame) -> DataFrame:
    both = h.join(F.broadcast(codes), ["class", "symbol"], "left")
    return both.groupBy("frame", "class").agg(F.round(F.sum(F.col("n") * F.coalesce("len", F.lit(16))) / F.sum("n"), 6).alias("avg_len"))


def lambda_exact(bits: Column, ssd: Column, area: Column, quality: int, layout: str = "Default", chroma: bool = False) -> Column:
    """Log-domain regression in quality, bits a sample and mean squared error; chroma takes half."""
    a, b, c, d, e, f = EXACT[layout][chroma]
    q = F.log(F.lit(float(min(max(quality, 1), 100))))
    lb, lm = F.log(bits / area), F.log(F.greatest(ssd / area, F.lit(0.001)))
    return F.exp(a + b * q + c * lb + d * lm + e * q * lb + f * q * q) / (2.0 if chroma else 1.0)
