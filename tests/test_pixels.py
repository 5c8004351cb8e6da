"""Pixel operators beside their plain definitions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from blockloom import catalog
from blockloom.operators import pixels as P


@pytest.mark.parametrize("mode", ["Nearest", "Reflect", "Mirror"])
@pytest.mark.parametrize("size, margin", [(1, 0), (5, 0), (5, 4), (6, 2), (1, 1)])
def test_margins_are_what_their_index_says(spark, mode, size, margin):
    df = spark.range(size * 3).select(F.floor(F.col("id") / 3).cast("int").alias("y"), (F.col("id") % 3).cast("int").alias("x"), F.col("id").cast("int").alias("v"))
    places = spark.range(-margin, size + margin).select(F.col("id").cast("int").alias("i"), P.margin_index(F.col("id").cast("int"), size, mode).alias("from"))
    taken = {r["i"]: r["from"] for r in places.collect()}
    across = {r["i"]: r["from"] for r in spark.range(-margin, 3 + margin).select(F.col("id").cast("int").alias("i"), P.margin_index(F.col("id").cast("int"), 3, mode).alias("from")).collect()}
    expected = sorted((y, x, 3 * a + b) for y, a in taken.items() for x, b in across.items() if 0 <= a < size and 0 <= b < 3)
    found = P.extend(df, 3, size, margin, mode)
    assert found.schema["y"].dataType.simpleString() == found.schema["x"].dataType.simpleString() == "int"
    assert sorted(map(tuple, found.collect())) == expected


@pytest.mark.parametrize("mode, last", [("Nearest", 5), ("Reflect", 2), ("Mirror", 1)])
def test_margins_of_a_raster_of_any_height(spark, mode, last):
    """No array as long as the raster is high."""
    height = 2**31 - 10
    df = spark.createDataFrame([(0, 0, 7), (height // 2, 0, 8), (height - 1, 0, 9)], "y int, x int, v int")
    rows = P.extend(df, 1, height, 4, mode).where("x = 0").collect()
    assert sum(r.v == 8 for r in rows) == 1 and sum(r.v == 7 for r in rows) == sum(r.v == 9 for r in rows) == last


@pytest.mark.parametrize("limited", [True, False])
def test_float_colours_round_as_their_sql(spark, limited):
    """The first colours fell on the other side of a half when scaled before the factors."""
    colours = [(2, 248, 9), (14, 20, 141), (17, 19, 26), (17, 63, 24), (18, 252, 171), (21, 141, 61), (0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 0, 255)]
    rows = [(0, x, *c) for x, c in enumerate(colours)]
    spans = (True, False) if limited else None
    df = spark.createDataFrame(rows, "y int, x int, r int, g int, b int")
    ycc = df.select("y", "x", *[c.alias(n) for c, n in zip(P.rgb_to_ycc_float(F.col("r"), F.col("g"), F.col("b"), limited=spans), ("yy", "cb", "cr"))])
    back = ycc.select("y", "x", *[c.alias(n) for c, n in zip(P.ycc_to_rgb_float(F.col("yy"), F.col("cb"), F.col("cr"), limited=spans), "rgb")])
    db = duckdb.connect()
    db.execute("CREATE TABLE rgb (y INTEGER, x INTEGER, r INTEGER, g INTEGER, b INTEGER)")
    db.executemany("INSERT INTO rgb VALUES (?, ?, ?, ?, ?)", rows)
    for ours, sql in ((ycc, catalog._float_ycc_sql(limited)), (back, catalog._float_rgb_sql(limited))):
        assert sorted(map(tuple, ours.collect())) == sorted(db.execute(sql).fetchall())
