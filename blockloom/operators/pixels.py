"""Raster operators over rows (y, x, v): checks, concealment, colour, margins, resampling, blocks and their reassembly. All are column expressions, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import matrices


def range_check(df: DataFrame, depth: int, keys: list[str], v: str = "v") -> DataFrame:
    return df.groupBy(*keys).agg(F.bool_and(F.lit(depth >= 16) | (F.col(v) <= (1 << depth) - 1)).alias("ok"), F.count_if(F.col(v) > (1 << depth) - 1).alias("n_bad"))


def out_of_range(df: DataFrame, depth: int, v: str = "v") -> DataFrame:
    return df.where(F.col(v) > (1 << depth) - 1)


def conceal(v: Column | str, depth: int) -> Column:
    return F.least(F.col(v) if isinstance(v, str) else v, F.lit((1 << depth) - 1))


def _clip(v: Column, most: int) -> Column:
    return F.least(F.greatest(v, F.lit(0).cast("bigint")), F.lit(most).cast("bigint"))


def rgb_to_ycc(r: Column, g: Column, b: Column, space: str = "BT601", depth: int = 8) -> list[Column]:
    rows, most, mid = matrices(space)[0], (1 << depth) - 1, 1 << (depth - 1)
    r, g, b = (c.cast("bigint") for c in (r, g, b))
    sums = [F.shiftright(m[0] * r + m[1] * g + m[2] * b + (1 << 15), 16) for m in rows]
    return [_clip(s if i == 0 else s + mid, most) for i, s in enumerate(sums)]


def ycc_to_rgb(y: Column, u: Column, v: Column, space: str = "BT601", depth: int = 8) -> list[Column]:
    rows, most, mid = matrices(space)[1], (1 << depth) - 1, 1 << (depth - 1)
    y, u, v = y.cast("bigint"), u.cast("bigint") - mid, v.cast("bigint") - mid
    return [_clip(F.shiftright(y * 65536 + (1 << 15) + m[1] * u + m[2] * v, 16), most) for m in rows]


def _span(depth: int, limited: bool, chroma: bool = False) -> tuple[int, int]:
    """Least value of a signal and how many values it has: all, or 16 to 235 (chroma 240) at 8 bits."""
    step = 1 << (depth - 8)
    low, high = (16 * step, (240 if chroma else 235) * step) if limited else (0, (1 << depth) - 1)
    return low, high - low + 1


def _float(v: float) -> Column:
    return F.lit(v).cast("float")


def _rounded(v: Column) -> Column:
    """Half away from zero, to an integer."""
    return F.when(v < 0, v - _float(0.5)).otherwise(v + _float(0.5)).cast("int")


def _within(v: Column, depth: int, limited: bool) -> Column:
    """Clips to all values; a limited signal leaves the first and the last step free."""
    step, most = 1 << (depth - 8), (1 << depth) - 1
    return F.least(F.greatest(v, F.lit(step if limited else 0)), F.lit(most - step if limited else most))


def _dot(row: list[float], parts: list[Column], scales: list[Column] | None = None) -> Column:
    """Products are of the factor and the part, then of the scale, as in the SQL twins: another order rounds a few colours otherwise."""
    terms = [_float(m) * p for m, p in zip(row, parts)]
    if scales:
        terms = [t * s for t, s in zip(terms, scales)]
    return terms[0] + terms[1] + terms[2]


def rgb_to_ycc_float(r: Column, g: Column, b: Column, space: str = "BT601", depth: int = 8, limited: tuple[bool, bool] | None = None) -> list[Column]:
    """In 32-bit floats. limited: of (YCbCr, RGB), which are of limited range; signals are then scaled between their spans. None: no scaling."""
    most, mid = (1 << depth) - 1, 1 << (depth - 1)
    rows, parts = matrices(space, 4)[0], [r, g, b]
    if limited is None:
        sums = [_rounded(_dot(m, [c.cast("float") for c in parts])) for m in rows]
        return [_within(s + (mid if i else 0), depth, False) for i, s in enumerate(sums)]
    low, n = _span(depth, limited[1])
    parts, scales = [(c.cast("int") - low).cast("float") for c in parts], [(_float(most) / _float(n)).cast("float")] * 3
    out = []
    for i, m in enumerate(rows):
        low, n = _span(depth, limited[0], i > 0)
        scaled = _rounded(_dot(m, parts, scales) * (_float(n) / _float(most)).cast("float"))
        out.append(_within(scaled + (low + (mid if i else 0)), depth, limited[0]))
    return out


def ycc_to_rgb_float(y: Column, u: Column, v: Column, space: str = "BT601", depth: int = 8, limited: tuple[bool, bool] | None = None) -> list[Column]:
    """The inverse of rgb_to_ycc_float."""
    most, mid = (1 << depth) - 1, 1 << (depth - 1)
    rows, parts = matrices(space, 4)[1], [y.cast("int"), u.cast("int") - mid, v.cast("int") - mid]
    if limited is None:
        return [_within(_rounded(_dot(m, [c.cast("float") for c in parts])), depth, False) for m in rows]
    spans = [_span(depth, limited[0], i > 0) for i in range(3)]
    parts, scales = [(c - low).cast("float") for c, (low, _) in zip(parts, spans)], [(_float(most) / _float(n)).cast("float") for _, n in spans]
    low, n = _span(depth, limited[1])
    return [_within(_rounded(_dot(m, parts, scales) * (_float(n) / _float(most)).cast("float")) + low, depth, limited[1]) for m in rows]


def margin_index(i: Column, size: int, mode: str) -> Column:
    """The sample that a position outside takes: Nearest, Reflect (edge twice) or Mirror (edge once)."""
    if mode == "Nearest":
        return F.least(F.greatest(i, F.lit(0)), F.lit(size - 1))
    edge = 1 if mode == "Reflect" else 0
    return F.when(i < 0, -i - edge).when(i >= size, 2 * size - 2 + edge - i).otherwise(i)


def _places(i: Column, size: int, margin: int, mode: str) -> Column:
    """The positions whose margin_index() is i: itself and its images beyond either edge. Work a sample depends on the margin, not on the size."""
    if mode == "Nearest":
        before = F.when(i == 0, F.sequence(F.lit(-margin), F.lit(-1)))
        after = F.when(i == size - 1, F.sequence(F.lit(size), F.lit(size + margin - 1)))
    else:
        edge = 1 if mode == "Reflect" else 0
        low, high = -i - edge, 2 * size - 2 + edge - i
        before = F.when(low.between(-margin, -1), F.array(low))
        after = F.when(high.between(size, size + margin - 1), F.array(high.cast("int")))
    none = F.array().cast("array<int>")
    own = F.when(i.between(0, size - 1), F.array(i))
    return F.concat(*[F.coalesce(part, none) for part in ((before, own, after) if margin > 0 else (own,))])


def extend(df: DataFrame, width: int, height: int, margin: int, mode: str, value: int = 0) -> DataFrame:
    """Each sample is copied to the places that take it; Constant and Zero have a value there. Needs margin < size."""
    taken = mode if mode not in ("Constant", "Zero") else "Nearest"
    out = df.select(F.explode(_places(F.col("y"), height, margin, taken)).alias("y"), "x", "v").select("y", F.explode(_places(F.col("x"), width, margin, taken)).alias("x"), "v")
    if mode in ("Constant", "Zero"):
        inside = F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)
        out = out.withColumn("v", F.when(inside, F.col("v")).otherwise(F.lit(value if mode == "Constant" else 0)))
    return out


def downsample(df: DataFrame, both: bool = True) -> DataFrame:
    """2 x 2 (4:2:0) or 2 x 1 (4:2:2) means, rounded half up."""
    y = F.shiftright("y", 1) if both else F.col("y")
    n, add = (2, 2) if both else (1, 1)
    return df.groupBy(y.alias("y"), F.shiftright("x", 1).alias("x")).agg(F.shiftright(F.sum("v") + add, n).cast("int").alias("v"))


def upsample(df: DataFrame, both: bool = True) -> DataFrame:
    pair = lambda c: F.explode(F.array(2 * F.col(c), 2 * F.col(c) + 1)).alias(c)
    out = df.select("y", pair("x"), "v")
    return out.select(pair("y"), "x", "v") if both else out


def to_blocks(df: DataFrame, width: int, height: int, h: int = 1, v: int = 1) -> DataFrame:
    """mcu, sub, i, v in coding order: groups of h x v blocks by rows; partial blocks repeat the last column and row, blocks wholly outside are zero."""
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    whole_w, whole_h = across * 8 * h, down * 8 * v
    seen_w, seen_h = -(-width // 8) * 8, -(-height // 8) * 8
    images = lambda c, n, seen: F.when(F.col(c) == n - 1, F.sequence(F.col(c), F.lit(seen - 1))).otherwise(F.array(F.col(c)))
    px = df.select(F.explode(images("y", height, seen_h)).alias("y"), "x", "v").select("y", F.explode(images("x", width, seen_w)).alias("x"), "v")
    if (whole_w, whole_h) != (seen_w, seen_h):
        grid = df.sparkSession.range(whole_w * whole_h).select(F.floor(F.col("id") / whole_w).cast("int").alias("y"), (F.col("id") % whole_w).cast("int").alias("x"), F.lit(0).alias("v"))
        px = px.unionByName(grid.where((F.col("x") >= seen_w) | (F.col("y") >= seen_h)))
    at = lambda c, n: F.floor(F.col(c) / n)
    mcu = at("y", 8 * v) * across + at("x", 8 * h)
    sub = (at("y", 8) % v) * h + at("x", 8) % h
    return px.select(mcu.cast("int").alias("mcu"), sub.cast("int").alias("sub"), ((F.col("y") % 8) * 8 + F.col("x") % 8).cast("int").alias("i"), "v")


def from_blocks(df: DataFrame, width: int, height: int, h: int = 1, v: int = 1) -> DataFrame:
    """The inverse: what lies outside is cropped."""
    across = -(-width // (8 * h))
    y = F.floor(F.col("mcu") / across) * 8 * v + F.floor(F.col("sub") / h) * 8 + F.floor(F.col("i") / 8)
    x = (F.col("mcu") % across) * 8 * h + (F.col("sub") % h) * 8 + F.col("i") % 8
    return df.select(y.cast("int").alias("y"), x.cast("int").alias("x"), "v").where((F.col("y") < height) & (F.col("x") < width))
