"""The registered queries of the block-transform operators and their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .functions import kernels as K
from .functions import tables as T
from .operators import entropy as E
from .operators import pixels as P
from .plans import codec
from .sources import formats, views

Q = 50
LUMA = T.quant_table(Q)
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join(str(tuple(r)) for r in rows)})"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# SQL twins share these steps.
V = views.SQL
BASIS = _values("basis", "u, x, m", [(u, x, int(T.BASIS[u, x])) for u in range(8) for x in range(8)])
SCAN = _values("scan", "k, r", enumerate(T.ZIGZAG))
PX = "px AS (SELECT block_id, frame, unnest(range(64)) AS i, unnest(px) AS v FROM blk)"
ROWS = "t1 AS (SELECT block_id, frame, i // 8 AS y, u, (CAST(sum(v * m) AS BIGINT) + 2048) >> 12 AS t FROM px JOIN basis ON x = i % 8 GROUP BY ALL)"
COEF = "coef AS (SELECT block_id, frame, basis.u * 8 + t1.u AS i, ((CAST(sum(t * m) AS BIGINT) + 16384) >> 15) - CASE WHEN basis.u + t1.u = 0 THEN 16384 ELSE 0 END AS v FROM t1 JOIN basis ON x = y GROUP BY block_id, frame, basis.u, t1.u)"


def _qtab(quality: int = Q, name: str = "qtab") -> str:
    return _values(name, "k, q", enumerate(T.quant_table(quality)))


def _qz(name: str = "qz", table: str = "qtab") -> str:
    return f"{name} AS (SELECT block_id, frame, k, sign(v) * ((2 * abs(v) + 16 * q) // (32 * q)) AS v FROM coef JOIN scan ON i = r JOIN {table} USING (k))"


CAT = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin(abs(CAST({0} AS BIGINT)))) END"


def _symbols(name: str = "sym", q: str = "qz") -> str:
    run = "k - coalesce(lag(k) OVER (PARTITION BY frame, block_id ORDER BY k), 0) - 1"
    return f"""{name} AS (
      SELECT frame, block_id, 'DC' AS class, {CAT.format('d')} AS symbol, {CAT.format('d')} AS nbits FROM (SELECT frame, block_id, v - coalesce(lag(v) OVER (PARTITION BY frame ORDER BY block_id), 0) AS d FROM {q} WHERE k = 0)
      UNION ALL SELECT frame, block_id, 'AC', (run % 16) * 16 + {CAT.format('v')}, {CAT.format('v')} FROM (SELECT *, {run} AS run FROM {q} WHERE k > 0 AND v <> 0)
      UNION ALL SELECT frame, block_id, 'AC', 240, 0 FROM (SELECT frame, block_id, unnest(range(run // 16)) FROM (SELECT *, {run} AS run FROM {q} WHERE k > 0 AND v <> 0))
      UNION ALL SELECT frame, block_id, 'AC', 0, 0 FROM {q} GROUP BY frame, block_id HAVING max(CASE WHEN v <> 0 THEN k ELSE 0 END) < 63)"""


CODES = _values("codes", "class, symbol, len, code", [(kind, s, n, c) for kind in ("DC", "AC") for s, (n, c) in T.canonical(*T.standard(kind, 0)).items()])


def _cost(q: str, table: str, name: str) -> str:
    """Per block: squared error of coefficients, rounded by block."""
    return f"{name} AS (SELECT z.frame, z.block_id, (CAST(sum(pow(z.v * q * 16 - c.v, 2)) AS BIGINT) + 128) >> 8 AS ssd FROM {q} z JOIN {table} USING (k) JOIN scan s ON s.k = z.k JOIN coef c ON c.block_id = z.block_id AND c.i = s.r GROUP BY z.frame, z.block_id)"


REC = """dq AS (SELECT block_id, frame, r // 8 AS a, r % 8 AS b, v * q + CASE WHEN r = 0 THEN 1024 ELSE 0 END AS v FROM qz JOIN qtab USING (k) JOIN scan USING (k)),
i1 AS (SELECT block_id, frame, x AS y, b, (CAST(sum(v * m) AS BIGINT) + 4096) >> 13 AS t FROM dq JOIN basis ON u = a GROUP BY ALL),
rec AS (SELECT block_id, frame, y * 8 + x AS i, least(greatest((CAST(sum(t * m) AS BIGINT) + 131072) >> 18, 0), 65535) AS v FROM i1 JOIN basis ON u = b GROUP BY block_id, frame, y, x)"""
CODED = [V["blk"], PX, BASIS, SCAN, _qtab(), ROWS, COEF, _qz()]


def coded(spark, sf_dir, quality: int = Q):
    q = T.quant_table(quality)
    df = views.blk(spark, sf_dir).withColumn("coeff", K.dct("px"))
    return df.withColumn("zz", K.quant_scan("coeff", q))


def levels(spark, sf_dir):
    return E.long(coded(spark, sf_dir), "zz")


def reconstructed(spark, sf_dir, most: int = 65535):
    return coded(spark, sf_dir).withColumn("rec", K.idct(K.unquant_scan("zz", LUMA), most))


# ---- scans, names, selection
@query("o7_parse", _with(V["names"]) + r"SELECT id, CAST(regexp_extract(s, '^([0-9]+)x([0-9]+)$', 1) AS INTEGER) AS w, CAST(regexp_extract(s, '^([0-9]+)x([0-9]+)$', 2) AS INTEGER) AS h FROM (SELECT id, regexp_extract(path, '([0-9]+x[0-9]+)', 1) AS s FROM names)")
def o7(spark, sf):
    s = F.regexp_extract("path", "([0-9]+x[0-9]+)", 1)
    return formats.parse_size(views.names(spark, sf).select("id", s.alias("s")), "s").select("id", "w", "h")


@query("o8_filename", _with(V["names"]) + r"SELECT id, CAST(regexp_extract(path, '([0-9]+)[xX]([0-9]+)', 1) AS INTEGER) AS w, CAST(regexp_extract(path, '([0-9]+)[xX]([0-9]+)', 2) AS INTEGER) AS h, CAST(regexp_extract(path, 'cf(400|420|422|444)_', 1) AS INTEGER) AS chroma, CAST(regexp_extract(path, '_(8|9|10|12|14|16)bps', 1) AS INTEGER) AS depth FROM names")
def o8(spark, sf):
    return formats.infer(views.names(spark, sf), "path").select("id", "w", "h", "chroma", "depth")


@query("o9_frames", _with(V["ras1"]) + "SELECT f AS frame, count(*) AS n FROM (SELECT y // 10 AS f FROM ras1) WHERE f >= 2 AND f < 5 GROUP BY f")
def o9(spark, sf):
    return formats.select_frames(views.ras1(spark, sf).withColumn("frame", F.floor(F.col("y") / 10).cast("int")), 2, 3).groupBy("frame").agg(F.count("*").alias("n"))


# ---- pixels
@query("o10_range_check", _with(V["ras1"]) + "SELECT y, bool_and(v <= 127) AS ok, count(*) FILTER (v > 127) AS n_bad FROM ras1 GROUP BY y")
def o10(spark, sf):
    return P.range_check(views.ras1(spark, sf), 7, ["y"])


@query("o11_out_of_range", _with(V["ras1"]) + "SELECT y, x, v FROM ras1 WHERE v > 127")
def o11(spark, sf):
    return P.out_of_range(views.ras1(spark, sf), 7)


@query("o12_conceal", _with(V["ras1"]) + "SELECT y, x, least(v, 127) AS v FROM ras1")
def o12(spark, sf):
    return views.ras1(spark, sf).withColumn("v", P.conceal("v", 7))


@query("o13_width", _with(V["ras1"]) + "SELECT y, x, least(v * 3, 255) AS v FROM ras1")
def o13(spark, sf):
    return views.ras1(spark, sf).withColumn("v", P.conceal(F.col("v") * 3, 8))


def _ycc_sql(space: str) -> str:
    f = T.matrices(space)[0]
    s = [f"(({m[0]} * CAST(r AS BIGINT) + {m[1]} * CAST(g AS BIGINT) + {m[2]} * CAST(b AS BIGINT) + 32768) >> 16)" for m in f]
    return f"SELECT y, x, least(greatest({s[0]}, 0), 255) AS yy, least(greatest({s[1]} + 128, 0), 255) AS cb, least(greatest({s[2]} + 128, 0), 255) AS cr FROM rgb"


def _rgb_sql(space: str, source: str) -> str:
    s = [f"((yy * 65536 + 32768 + {m[1]} * (cb - 128) + {m[2]} * (cr - 128)) >> 16)" for m in T.matrices(space)[1]]
    return "SELECT y, x, " + ", ".join(f"least(greatest({e}, 0), 255) AS {n}" for e, n in zip(s, "rgb")) + f" FROM ({source})"


def ycc(spark, sf, space):
    return views.rgb(spark, sf).select("y", "x", *[c.alias(n) for c, n in zip(P.rgb_to_ycc(F.col("r"), F.col("g"), F.col("b"), space), ("yy", "cb", "cr"))])


for _space in T.SPACES:
    query("o14_rgb2ycbcr" + ("" if _space == "BT601" else f"_{_space.lower()}"), _with(V["rgb"]) + _ycc_sql(_space))(lambda spark, sf, s=_space: ycc(spark, sf, s))
    query("o15_ycbcr2rgb" + ("" if _space == "BT601" else f"_{_space.lower()}"), _with(V["rgb"]) + _rgb_sql(_space, _ycc_sql(_space)))(
        lambda spark, sf, s=_space: ycc(spark, sf, s).select("y", "x", *[c.alias(n) for c, n in zip(P.ycc_to_rgb(F.col("yy"), F.col("cb"), F.col("cr"), s), "rgb")])
    )


def _f(v: float) -> str:
    return f"CAST({v} AS FLOAT)"


def _dot_sql(row: list[float], parts: list[str]) -> str:
    return "(" + " + ".join(f"{_f(m)} * {p}" for m, p in zip(row, parts)) + ")"


def _round_sql(e: str) -> str:
    return f"CAST(trunc(CASE WHEN {e} < 0 THEN {e} - {_f(0.5)} ELSE {e} + {_f(0.5)} END) AS INTEGER)"


def _float_ycc_sql(limited: bool) -> str:
    """8 bits, BT.601; limited: YCbCr in its span, RGB in all values."""
    parts = [f"CAST({c} AS FLOAT)" + (f" * CAST({_f(255)} / {_f(256)} AS FLOAT)" if limited else "") for c in "rgb"]
    out = []
    for i, (m, n) in enumerate(zip(T.matrices("BT601", 4)[0], ("yy", "cb", "cr"))):
        e = _dot_sql(m, parts) + (f" * CAST({_f(225 if i else 220)} / {_f(255)} AS FLOAT)" if limited else "")
        out.append(f"least(greatest({_round_sql(e)} + {(16 if limited else 0) + (128 if i else 0)}, {int(limited)}), {255 - int(limited)}) AS {n}")
    return "SELECT y, x, " + ", ".join(out) + " FROM rgb"


def _float_rgb_sql(limited: bool) -> str:
    parts = [f"CAST({c} - {(16 if limited else 0) + (128 if i else 0)} AS FLOAT)" + (f" * CAST({_f(255)} / {_f(225 if i else 220)} AS FLOAT)" if limited else "") for i, c in enumerate(("yy", "cb", "cr"))]
    out = []
    for m, n in zip(T.matrices("BT601", 4)[1], "rgb"):
        e = _dot_sql(m, parts) + (f" * CAST({_f(256)} / {_f(255)} AS FLOAT)" if limited else "")
        out.append(f"least(greatest({_round_sql(e)}, 0), 255) AS {n}")
    return "SELECT y, x, " + ", ".join(out) + f" FROM ({_float_ycc_sql(limited)})"


def float_ycc(spark, sf, limited):
    return views.rgb(spark, sf).select("y", "x", *[c.alias(n) for c, n in zip(P.rgb_to_ycc_float(F.col("r"), F.col("g"), F.col("b"), limited=limited), ("yy", "cb", "cr"))])


for _name, _limited in (("o16_{}_float", None), ("o17_{}_limited", (True, False))):
    query(_name.format("rgb2ycbcr"), _with(V["rgb"]) + _float_ycc_sql(bool(_limited)))(lambda spark, sf, s=_limited: float_ycc(spark, sf, s))
    query(_name.format("ycbcr2rgb"), _with(V["rgb"]) + _float_rgb_sql(bool(_limited)))(
        lambda spark, sf, s=_limited: float_ycc(spark, sf, s).select("y", "x", *[c.alias(n) for c, n in zip(P.ycc_to_rgb_float(F.col("yy"), F.col("cb"), F.col("cr"), limited=s), "rgb")])
    )


@query("o19_reorder", _with(V["rgb"]) + "SELECT y, x, b AS r, g, r AS b FROM rgb")
def o19(spark, sf):
    return views.rgb(spark, sf).select("y", "x", F.col("b").alias("r"), "g", F.col("r").alias("b"))


@query("o20_interleave", _with(V["rgb"]) + "SELECT y, list(r ORDER BY x) AS r, list(g ORDER BY x) AS g FROM rgb GROUP BY y")
def o20(spark, sf):
    aos = views.rgb(spark, sf).groupBy("y").agg(F.array_sort(F.collect_list(F.struct("x", "r", "g", "b"))).alias("p"))
    return aos.select("y", F.col("p.r").alias("r"), F.col("p.g").alias("g"))


_SIZE = "(SELECT max(y) + 1 AS h FROM ras1)"
for _mode, _y, _x in (
    ("Nearest", "least(greatest(i, 0), h - 1)", "least(greatest(j, 0), 149)"),
    ("Reflect", "CASE WHEN i < 0 THEN -i - 1 WHEN i >= h THEN 2 * h - 1 - i ELSE i END", "CASE WHEN j < 0 THEN -j - 1 WHEN j >= 150 THEN 299 - j ELSE j END"),
    ("Mirror", "CASE WHEN i < 0 THEN -i WHEN i >= h THEN 2 * h - 2 - i ELSE i END", "CASE WHEN j < 0 THEN -j WHEN j >= 150 THEN 298 - j ELSE j END"),
):
    query(f"o21_margin_{_mode.lower()}", _with(V["ras1"], f"g AS (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {_y} AS sy, {_x} AS sx FROM {_SIZE}, range(-4, h + 4) a(i), range(-4, 154) b(j))") + "SELECT i AS y, j AS x, v FROM g JOIN ras1 ON ras1.y = sy AND ras1.x = sx")(
        lambda spark, sf, m=_mode: P.extend(views.ras1(spark, sf), 150, views.ras1(spark, sf).agg(F.max("y")).first()[0] + 1, 4, m)
    )


# ---- resampling and blocks
_G = "g AS (SELECT y, x, g AS v FROM rgb)"


def green(spark, sf):
    return views.rgb(spark, sf).select("y", "x", F.col("g").alias("v"))


@query("o23_down420", _with(V["rgb"], _G) + "SELECT y // 2 AS y, x // 2 AS x, CAST((CAST(sum(v) AS BIGINT) + 2) >> 2 AS INTEGER) AS v FROM g GROUP BY ALL")
def o23(spark, sf):
    return P.downsample(green(spark, sf))


@query("o24_down422", _with(V["rgb"], _G) + "SELECT y, x // 2 AS x, CAST((CAST(sum(v) AS BIGINT) + 1) >> 1 AS INTEGER) AS v FROM g GROUP BY ALL")
def o24(spark, sf):
    return P.downsample(green(spark, sf), both=False)


@query("o25_up420", _with(V["rgb"], _G) + "SELECT 2 * y + a AS y, 2 * x + b AS x, v FROM g, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b)")
def o25(spark, sf):
    return P.upsample(green(spark, sf))


@query("o26_geometry", "SELECT p_partkey AS id, p_size * 16 AS w, p_size * 9 AS h, CAST(ceil(p_size * 16 / 16.0) AS INTEGER) AS mcus_x, CAST(ceil(p_size * 9 / 16.0) AS INTEGER) AS mcus_y, CAST(ceil(p_size * 16 / 2.0) AS INTEGER) AS chroma_w, CAST(ceil(p_size * 9 / 2.0) AS INTEGER) AS chroma_h FROM part")
def o26(spark, sf):
    return codec.geometry(spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 16).alias("w"), (F.col("p_size") * 9).alias("h")), 2, 2)


_BLOCKS = """g AS (SELECT CAST(i AS INTEGER) AS y, CAST(j AS INTEGER) AS x, h FROM (SELECT max(y) + 1 AS h FROM ras1), range(CAST(ceil(h / 16.0) * 16 AS BIGINT)) a(i), range(160) b(j)),
blocks AS (SELECT (g.y // 16) * 10 + g.x // 16 AS mcu, ((g.y // 8) % 2) * 2 + (g.x // 8) % 2 AS sub, (g.y % 8) * 8 + g.x % 8 AS i, CASE WHEN g.y >= ceil(h / 8.0) * 8 OR g.x >= 152 THEN 0 ELSE v END AS v FROM g JOIN ras1 r ON r.y = least(g.y, h - 1) AND r.x = least(g.x, 149))"""


def ras_blocks(spark, sf):
    r = views.ras1(spark, sf)
    height = r.agg(F.max("y")).first()[0] + 1
    return P.to_blocks(r, 150, height, 2, 2), height


@query("o27_blocks", _with(V["ras1"], _BLOCKS) + "SELECT mcu, sub, i, v FROM blocks")
def o27(spark, sf):
    return ras_blocks(spark, sf)[0]


@query("o28_reassembly", _with(V["ras1"]) + "SELECT y, x, v FROM ras1")
def o28(spark, sf):
    b, height = ras_blocks(spark, sf)
    return P.from_blocks(b, 150, height, 2, 2)


# ---- transform, quantisation, scan
def flat(df, c, name="v"):
    return df.select("block_id", "frame", F.posexplode(c).alias("i", name))


@query("o29_fdct", _with(V["blk"], PX, BASIS, ROWS, COEF) + "SELECT block_id, frame, CAST(i AS INTEGER) AS i, CAST(v AS INTEGER) AS v FROM coef")
def o29(spark, sf):
    return flat(coded(spark, sf), "coeff")


BASIS13 = _values("basis13", "u, x, m", [(u, x, int(T.BASIS13[u, x])) for u in range(8) for x in range(8)])
BASISF = _values("basisf", "u, x, m", [(u, x, float(T.EXACT_BASIS[u, x])) for u in range(8) for x in range(8)])
_FORMS = {
    "float": _with(V["blk"], PX, BASISF, "t1 AS (SELECT block_id, frame, i // 8 AS y, u, sum(v * CAST(m AS DOUBLE)) AS t FROM px JOIN basisf ON x = i % 8 GROUP BY ALL)", "c AS (SELECT block_id, frame, basisf.u * 8 + t1.u AS i, 2 * sum(t * CAST(m AS DOUBLE)) AS v FROM t1 JOIN basisf ON x = y GROUP BY block_id, frame, basisf.u, t1.u)")
    + "SELECT block_id, frame, CAST(i AS INTEGER) AS i, CAST(round(v) AS INTEGER) - CASE WHEN i = 0 THEN 16384 ELSE 0 END AS v FROM c",
    "int13_folded": _with(V["blk"], PX, BASIS13, "t1 AS (SELECT block_id, frame, i // 8 AS y, u, (CAST(sum(v * m) AS BIGINT) + 1024) >> 11 AS t FROM px JOIN basis13 ON x = i % 8 GROUP BY ALL)", "c AS (SELECT block_id, frame, basis13.u * 8 + t1.u AS i, (CAST(sum(t * m) AS BIGINT) + 8192) >> 14 AS v FROM t1 JOIN basis13 ON x = y GROUP BY block_id, frame, basis13.u, t1.u)")
    + "SELECT block_id, frame, CAST(i AS INTEGER) AS i, CAST(v AS INTEGER) - CASE WHEN i = 0 THEN 16384 ELSE 0 END AS v FROM c",
}
_FORMS["float_folded"] = _FORMS["float"]
for _form in K.FORMS:
    query(f"o31_fdct_{_form}", _FORMS[_form])(lambda spark, sf, f=_form: flat(views.blk(spark, sf).withColumn("coeff", K.dct_as(f, "px")), "coeff"))


@query("o30_idct", _with(*CODED, REC) + "SELECT block_id, frame, CAST(i AS INTEGER) AS i, CAST(v AS INTEGER) AS v FROM rec")
def o30(spark, sf):
    return flat(reconstructed(spark, sf), "rec")


def table_rows(spark, layout):
    rows = [(q, c, k, v) for q in range(0, 101, 5) for c in (0, 1) for k, v in enumerate(T.quant_table(q, c, layout))]
    return spark.createDataFrame(rows, "quality int, cmp int, k int, q int")


_BASE = _values("base", "cmp, k, b", [(c, k, t[r]) for c, t in ((0, T.LUMA), (1, T.CHROMA)) for k, r in enumerate(T.ZIGZAG)])
_TABS = _with(_BASE, "s AS (SELECT a AS quality, CASE WHEN greatest(a, 1) < 50 THEN 5000 // greatest(a, 1) ELSE 200 - 2 * a END AS s FROM range(0, 101, 5) t(a))", "d AS (SELECT quality, cmp, k, least(greatest((b * s + 50) // 100, 1), 255) AS q FROM base, s)", "m AS (SELECT quality, cmp, (CAST(sum(q) AS BIGINT) + 32) >> 6 AS m FROM d GROUP BY ALL)")
for _name, _layout, _e in (("default", "Default", "q"), ("flat", "Flat", "m"), ("semi", "SemiFlat", "(q + m + 1) >> 1")):
    query(f"o32_qtab_{_name}" if _name == "default" else f"o33_qtab_{_name}", _TABS + f"SELECT CAST(quality AS INTEGER) AS quality, cmp, k, CAST({_e} AS INTEGER) AS q FROM d JOIN m USING (quality, cmp)")(lambda spark, sf, l=_layout: table_rows(spark, l))


@query("o34_estimate_q", _TABS + """, p AS (SELECT quality, cmp, avg(100.0 * q / b) AS p, bool_and(q = 1) AS ones FROM d JOIN base USING (cmp, k) GROUP BY ALL),
e AS (SELECT quality, cmp, ones, round(CASE WHEN p <= 100 THEN (200 - p) / 2 ELSE 5000 / p END) AS e FROM p)
SELECT CAST(quality AS INTEGER) AS quality, CAST(CASE WHEN bool_and(ones) THEN 100 WHEN min(e) = max(e) THEN min(e) ELSE -1 END AS INTEGER) AS estimate FROM e GROUP BY quality""")
def o34(spark, sf):
    return codec.estimate_quality(table_rows(spark, "Default"))


@query("o35_quant", _with(*CODED) + "SELECT block_id, frame, CAST(k AS INTEGER) AS k, CAST(v AS INTEGER) AS v FROM qz")
def o35(spark, sf):
    return levels(spark, sf).select("block_id", "frame", "k", "v")


@query("o36_dequant", _with(*CODED) + "SELECT block_id, frame, CAST(r AS INTEGER) AS i, CAST(v * q AS INTEGER) AS v FROM qz JOIN qtab USING (k) JOIN scan USING (k)")
def o36(spark, sf):
    return flat(coded(spark, sf).withColumn("c", K.unquant_scan("zz", LUMA)), "c")


@query("o37_zigzag", _with(V["blk"], SCAN) + "SELECT block_id, CAST(k AS INTEGER) AS k, px[r + 1] AS v FROM blk, scan")
def o37(spark, sf):
    order = F.array(*map(F.lit, T.ZIGZAG))
    return views.blk(spark, sf).select("block_id", F.posexplode(F.transform(order, lambda r: F.get("px", r))).alias("k", "v"))


# ---- entropy model
@query("o39_last_nz", _with(*CODED) + "SELECT block_id, CAST(max(CASE WHEN v <> 0 THEN k ELSE 0 END) AS INTEGER) AS last FROM qz GROUP BY block_id")
def o39(spark, sf):
    return levels(spark, sf).groupBy("block_id").agg(F.coalesce(F.max(F.when(F.col("v") != 0, F.col("k"))), F.lit(0)).alias("last"))


_DC = "dc AS (SELECT frame, block_id, v, v - coalesce(lag(v) OVER (PARTITION BY frame ORDER BY block_id), 0) AS delta FROM qz WHERE k = 0)"


@query("o40_dc_delta", _with(*CODED, _DC) + "SELECT frame, block_id, CAST(delta AS INTEGER) AS delta FROM dc")
def o40(spark, sf):
    return E.dc_delta(levels(spark, sf)).select("frame", "block_id", "delta")


@query("o41_dc_undelta", _with(*CODED) + "SELECT frame, block_id, CAST(v AS INTEGER) AS restored FROM qz WHERE k = 0")
def o41(spark, sf):
    return E.dc_undelta(E.dc_delta(levels(spark, sf))).select("frame", "block_id", "restored")


@query("o42_category", _with(*CODED) + f"SELECT block_id, CAST(k AS INTEGER) AS k, CAST({CAT.format('v')} AS INTEGER) AS category, CAST(CASE WHEN v > 0 THEN v WHEN v < 0 THEN v - 1 + (1 << length(bin(abs(CAST(v AS BIGINT))))) ELSE 0 END AS INTEGER) AS remainder FROM qz")
def o42(spark, sf):
    return levels(spark, sf).select("block_id", "k", E.category(F.col("v")).alias("category"), E.remainder(F.col("v")).alias("remainder"))


SYM = [*CODED, _symbols()]


@query("o43_ac_symbols", _with(*SYM) + "SELECT block_id, CAST(symbol AS INTEGER) AS symbol, CAST(nbits AS INTEGER) AS nbits FROM sym WHERE class = 'AC'")
def o43(spark, sf):
    return E.symbols(levels(spark, sf)).where("class = 'AC'").select("block_id", "symbol", "nbits")


@query("o44_histogram", _with(*SYM) + "SELECT frame, class, CAST(symbol AS INTEGER) AS symbol, count(*) AS n FROM sym GROUP BY ALL")
def o44(spark, sf):
    return E.histogram(E.symbols(levels(spark, sf)))


BITS = "bits AS (SELECT frame, CAST(sum(coalesce(len, 16) + nbits) AS BIGINT) AS bits FROM sym LEFT JOIN codes USING (class, symbol) GROUP BY frame)"


@query("o45_bit_cost", _with(*SYM, CODES) + "SELECT block_id, CAST(sum(coalesce(len, 16) + nbits) AS BIGINT) AS bits FROM sym LEFT JOIN codes USING (class, symbol) GROUP BY block_id")
def o45(spark, sf):
    return E.bit_cost(E.symbols(levels(spark, sf)), E.code_table(spark.range(0)), ("block_id",))


@query("o46_avg_len", _with(*SYM, CODES) + "SELECT frame, class, round(sum(coalesce(len, 16)) / count(*), 6) AS avg_len FROM sym LEFT JOIN codes USING (class, symbol) GROUP BY ALL")
def o46(spark, sf):
    return E.average_length(E.histogram(E.symbols(levels(spark, sf))), E.code_table(spark.range(0)))


_LENGTHS = _values("l", "class, cmp, rank, symbol, len", [(kind, c, i, s, next(n for n in range(1, 17) if sum(b[:n]) > i)) for kind, c in T.BITS for b, syms in [T.standard(kind, c)] for i, s in enumerate(syms)])


@query("o48_canonical_codes", _with(_LENGTHS) + "SELECT a.class, a.cmp, a.symbol, a.len, CAST(coalesce(sum(1 << (a.len - b.len)), 0) AS INTEGER) AS code FROM l a LEFT JOIN l b ON a.class = b.class AND a.cmp = b.cmp AND b.rank < a.rank GROUP BY ALL")
def o48(spark, sf):
    rows = [(kind, c, s, n, code) for kind, c in T.BITS for s, (n, code) in T.canonical(*T.standard(kind, c)).items()]
    return spark.createDataFrame(rows, "class string, cmp int, symbol int, len int, code int")


@query("o49_huff_lengths")
def o49(spark, sf):
    return codec.design_codes(E.histogram(E.symbols(levels(spark, sf))))


@query("o55_stuffing", _with(V["bytes"]) + "SELECT id, regexp_replace(regexp_replace(hex, '(..)', '\\1 ', 'g'), 'ff ', 'ff 00 ', 'g') AS stuffed FROM bytes")
def o55(spark, sf):
    spaced = F.regexp_replace("hex", "(..)", "$1 ")
    return views.hex_strings(spark, sf).select("id", F.regexp_replace(spaced, "ff ", "ff 00 ").alias("stuffed"))


@query("o63_find_marker", _with(V["bytes"]) + "SELECT id, CAST(coalesce(min(i), CASE WHEN any_value(substr(hex, 31, 2)) = 'ff' THEN -2 ELSE -1 END) AS INTEGER) AS at FROM (SELECT id, hex, i, substr(hex, 2 * i + 1, 2) = 'ff' AND substr(hex, 2 * i + 3, 2) NOT IN ('00', 'ff') AS hit FROM bytes, range(15) t(i)) x LEFT JOIN (SELECT true AS hit) USING (hit) WHERE true GROUP BY id".replace("min(i)", "min(i) FILTER (hit)"))
def o63(spark, sf):
    return formats.find_marker(views.hex_strings(spark, sf), "hex").select("id", "at")


# ---- metrics
PAIRS = "d AS (SELECT px.frame, px.block_id, px.i, rec.v - px.v AS d, px.v AS org, rec.v AS rec FROM px JOIN rec USING (block_id, i))"


def pairs(spark, sf, most: int = 65535):
    df = reconstructed(spark, sf, most).select("frame", "block_id", F.posexplode(F.arrays_zip("px", "rec")).alias("i", "p"))
    return df.select("frame", "block_id", "i", F.col("p.px").cast("bigint").alias("org"), F.col("p.rec").cast("bigint").alias("rec"), (F.col("p.rec") - F.col("p.px")).cast("bigint").alias("d"))


@query("o66_ssd", _with(*CODED, REC, PAIRS) + "SELECT frame, CAST(sum(d) AS BIGINT) AS sd, CAST(sum(abs(d)) AS BIGINT) AS sad, CAST(sum(d * d) AS BIGINT) AS ssd FROM d GROUP BY frame")
def o66(spark, sf):
    return pairs(spark, sf).groupBy("frame").agg(F.sum("d").alias("sd"), F.sum(F.abs("d")).alias("sad"), F.sum(F.col("d") * F.col("d")).alias("ssd"))


@query("o67_weighted_ssd", _with(*CODED, REC, PAIRS) + "SELECT frame, CAST(sum(d * (i % 2)) AS BIGINT) AS wsd, CAST(sum(d * d * (i % 2)) AS BIGINT) AS wssd FROM d GROUP BY frame")
def o67(spark, sf):
    m = F.col("i") % 2
    return pairs(spark, sf).groupBy("frame").agg(F.sum(F.col("d") * m).alias("wsd"), F.sum(F.col("d") * F.col("d") * m).alias("wssd"))


@query("o68_counts", _with(*CODED, REC, PAIRS) + "SELECT frame, count(*) FILTER (rec <> 0) AS nonzero, count(*) FILTER (d = 0) AS equal, count(*) FILTER (d = 0 AND i % 2 = 1) AS masked_equal, bool_and(d = 0) AS all_equal FROM d GROUP BY frame")
def o68(spark, sf):
    return pairs(spark, sf).groupBy("frame").agg(F.count_if(F.col("rec") != 0).alias("nonzero"), F.count_if(F.col("d") == 0).alias("equal"), F.count_if((F.col("d") == 0) & (F.col("i") % 2 == 1)).alias("masked_equal"), F.bool_and(F.col("d") == 0).alias("all_equal"))


def block_costs(df, q):
    """Coefficient-domain squared error by block."""
    z = df.withColumn("c", K.unquant_scan("zz", q))
    return z.select("frame", "block_id", F.shiftright(F.aggregate(F.zip_with("c", "coeff", lambda a, b: ((a * 16 - b).cast("bigint") * (a * 16 - b).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a + b) + 128, 8).alias("ssd"))


@query("o69_coeff_ssd", _with(*CODED, _cost("qz", "qtab", "bc")) + "SELECT frame, CAST(sum(ssd) AS BIGINT) AS ssd FROM bc GROUP BY frame")
def o69(spark, sf):
    return block_costs(coded(spark, sf), LUMA).groupBy("frame").agg(F.sum("ssd").alias("ssd"))


@query("o70_model_error", "SELECT CAST(q AS INTEGER) AS quality, round(CASE WHEN q <= 80 THEN 0.000323 * q + 0.0040 ELSE 0.00425 * (exp(0.203 * (q - 80.0)) - 1.0) + 0.0298 END, 6) AS error FROM range(101) t(q)")
def o70(spark, sf):
    q = F.col("id")
    e = F.when(q <= 80, 0.000323 * q + 0.0040).otherwise(0.00425 * (F.exp(0.203 * (q - 80.0)) - 1.0) + 0.0298)
    return spark.range(101).select(q.cast("int").alias("quality"), F.round(e, 6).alias("error"))


@query("o71_psnr", _with(*CODED, REC, "d AS (SELECT px.frame, least(rec.v, 255) - px.v AS d FROM px JOIN rec USING (block_id, i))") + "SELECT frame, CAST(sum(d * d) AS BIGINT) AS ssd, round(10 * log10(count(*) * 65025.0 / greatest(sum(d * d), 1)), 6) AS psnr FROM d GROUP BY frame")
def o71(spark, sf):
    return codec.psnr(pairs(spark, sf, 255))


STATS = "f AS (SELECT frame, bits, (bits + 7) // 8 AS bytes, n * 64 AS area FROM bits JOIN (SELECT frame, count(*) AS n FROM blk GROUP BY frame) USING (frame))"


@query("o73_stats", _with(*SYM, CODES, BITS, STATS) + "SELECT round(avg(bytes), 6) AS mean_bytes, round(sum(bytes) * 8 * 25.0 / count(*), 6) AS bitrate, round(sum(bytes) * 8.0 / sum(area), 6) AS bits_per_pixel, round(sum(bytes) * 1.0 / sum(area), 6) AS ratio FROM f")
def o73(spark, sf):
    return codec.statistics(frame_rates(spark, sf), 25.0)


def frame_rates(spark, sf, quality: int = Q):
    df = coded(spark, sf, quality)
    bits = E.bit_cost(E.symbols(E.long(df, "zz")), E.code_table(spark.range(0)))
    ssd = block_costs(df, T.quant_table(quality)).groupBy("frame").agg(F.sum("ssd").alias("ssd"), (F.count("*") * 64).alias("area"))
    return bits.join(ssd, "frame").withColumn("bytes", F.floor((F.col("bits") + 7) / 8))


# ---- rate and distortion
@query("o75_rate", _with(*SYM, CODES, BITS) + "SELECT frame, bits FROM bits")
def o75(spark, sf):
    return frame_rates(spark, sf).select("frame", "bits")


@query("o76_distortion", _with(*CODED, REC, PAIRS, _cost("qz", "qtab", "bc")) + "SELECT frame, exact, approx FROM (SELECT frame, CAST(sum(d * d) AS BIGINT) AS exact FROM d GROUP BY frame) JOIN (SELECT frame, CAST(sum(ssd) AS BIGINT) AS approx FROM bc GROUP BY frame) USING (frame)")
def o76(spark, sf):
    exact = pairs(spark, sf).groupBy("frame").agg(F.sum(F.col("d") * F.col("d")).alias("exact"))
    return exact.join(o69(spark, sf).withColumnRenamed("ssd", "approx"), "frame")


def _fast(c):
    return f"exp({c[0]} * pow(ln(greatest(q, 1)), 3) + {c[1]} * pow(ln(greatest(q, 1)), 2) + {c[2]} * ln(greatest(q, 1)) + {c[3]})"


@query("o77_lambda_fast", " UNION ALL ".join(f"SELECT '{n}' AS layout, CAST(q AS INTEGER) AS quality, round({_fast(l)}, 6) AS luma, round({_fast(c)}, 6) AS chroma FROM range(0, 101, 10) t(q)" for n, (l, c) in T.FAST.items()))
def o77(spark, sf):
    q = F.log(F.greatest(F.col("id"), F.lit(1)).cast("double"))
    fit = lambda c: F.round(F.exp(c[0] * q * q * q + c[1] * q * q + c[2] * q + c[3]), 6)
    out = [spark.range(0, 101, 10).select(F.lit(n).alias("layout"), F.col("id").cast("int").alias("quality"), fit(l).alias("luma"), fit(c).alias("chroma")) for n, (l, c) in T.FAST.items()]
    return out[0].union(out[1]).union(out[2])


def _exact(c):
    return f"exp({c[0]} + {c[1]} * {math.log(Q)} + {c[2]} * lb + {c[3]} * lm + {c[4]} * {math.log(Q)} * lb + {c[5]} * {math.log(Q) ** 2})"


@query("o78_lambda_exact", _with(*SYM, CODES, BITS, _cost("qz", "qtab", "bc"), "a AS (SELECT frame, ln(bits / (n * 64.0)) AS lb, ln(greatest(s / (n * 64.0), 0.001)) AS lm FROM bits JOIN (SELECT frame, count(*) AS n, sum(ssd) AS s FROM bc GROUP BY frame) USING (frame))") + f"SELECT frame, round({_exact(T.EXACT['Default'][0])}, 6) AS luma, round({_exact(T.EXACT['Default'][1])} / 2, 6) AS chroma FROM a")
def o78(spark, sf):
    f = frame_rates(spark, sf)
    fit = lambda chroma: F.round(E.lambda_exact(F.col("bits"), F.col("ssd"), F.col("area"), Q, chroma=chroma), 6)
    return f.select("frame", fit(False).alias("luma"), fit(True).alias("chroma"))


def _at(q: int) -> list[str]:
    return [_qtab(q, f"qt{q}"), _qz(f"z{q}", f"qt{q}"), _symbols(f"s{q}", f"z{q}"), _cost(f"z{q}", f"qt{q}", f"c{q}"), f"r{q} AS (SELECT frame, b, s FROM (SELECT frame, CAST(sum(coalesce(len, 16) + nbits) AS BIGINT) AS b FROM s{q} LEFT JOIN codes USING (class, symbol) GROUP BY frame) JOIN (SELECT frame, CAST(sum(ssd) AS BIGINT) AS s FROM c{q} GROUP BY frame) USING (frame))"]


@query("o79_lambda_exhaustive", _with(V["blk"], PX, BASIS, SCAN, ROWS, COEF, CODES, *_at(Q - 2), *_at(Q), *_at(Q + 2)) + f"SELECT m.frame, round((-(m.s - d.s) / (m.b - d.b) - (m.s - i.s) / (m.b - i.b)) / 2.0, 6) AS lambda FROM r{Q} m JOIN r{Q - 2} d USING (frame) JOIN r{Q + 2} i USING (frame)")
def o79(spark, sf):
    low, mid, high = (frame_rates(spark, sf, q).select("frame", F.col("bits").alias(f"b{i}"), F.col("ssd").alias(f"s{i}")) for i, q in enumerate((Q - 2, Q, Q + 2)))
    slope = lambda i: -(F.col("s1") - F.col(f"s{i}")) / (F.col("b1") - F.col(f"b{i}"))
    return mid.join(low, "frame").join(high, "frame").select("frame", F.round((slope(0) + slope(2)) / 2, 6).alias("lambda"))


@query("o80_rdoq")
def o80(spark, sf):
    lam = frame_rates(spark, sf).select("frame", E.lambda_exact(F.col("bits"), F.col("ssd"), F.col("area"), Q).alias("lam"))
    return codec.optimise(coded(spark, sf).join(lam, "frame"), LUMA).select("block_id", "frame", "cost_before", "cost_after", "nonzero_before", "nonzero_after")


# ---- codecs: frames of blocks to streams and back
@query("o52_decode", _with(*CODED) + "SELECT frame, CAST(k AS INTEGER) AS k, CAST(sum(v) AS BIGINT) AS total, CAST(sum(abs(v)) AS BIGINT) AS magnitude FROM qz GROUP BY ALL")
def o52(spark, sf):
    slices = codec.encode_slices(coded(spark, sf).select("frame", "block_id", "zz"), restart=16)
    z = codec.decode_slices(slices).select("frame", F.posexplode("zz").alias("k", "v"))
    return z.groupBy("frame", "k").agg(F.sum("v").cast("bigint").alias("total"), F.sum(F.abs("v")).cast("bigint").alias("magnitude"))


@query("o85_advanced")
def o85(spark, sf):
    return codec.encode(codec.raster_frames(views.ras1(spark, sf), 10), codec.Config(150, 10, quality=Q, optimise_coefficients=True, optimise_tables=True)).select("frame", F.octet_length("jpeg").alias("n_bytes"), F.sha2("jpeg", 256).alias("sha256"))


from . import catalog_streams  # noqa: E402, F401  (registers further queries)
