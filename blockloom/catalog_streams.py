"""Registered queries of constants, buffers, bit streams, segments and whole codecs, with SQL twins that build the same bytes."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from .catalog import BASIS, CAT, CODED, CODES, COEF, LUMA, PAIRS, PX, Q, REC, ROWS, SCAN, _cost, _qtab, _qz, _values, _with, block_costs, coded, pairs, query
from .catalog import V as VIEWS
from .functions import kernels as K
from .functions import tables as T
from .plans import codec
from .sources import formats, views

WIDTH, ROWS_A_FRAME = 150, 10


# ---- constants and buffers
_CELLS = {
    "forward": ["kr", "kg", "kb", "-kr / (2 * (1 - kb))", "-kg / (2 * (1 - kb))", "0.5", "0.5", "-kg / (2 * (1 - kr))", "-kb / (2 * (1 - kr))"],
    "backward": ["1", "0", "2 * (1 - kr)", "1", "-2 * kb * (1 - kb) / kg", "-2 * kr * (1 - kr) / kg", "1", "2 * (1 - kb)", "0"],
}


@query("o18_matrices", _with(_values("s", "space, kr, kb", [(n, *k) for n, k in T.SPACES.items()]), "w AS (SELECT space, CAST(kr AS DOUBLE) AS kr, CAST(kb AS DOUBLE) AS kb, 1 - CAST(kr AS DOUBLE) - CAST(kb AS DOUBLE) AS kg FROM s)") + " UNION ALL ".join(f"SELECT space, '{d}' AS direction, {i // 3} AS row, {i % 3} AS col, CAST(round(({e}) * 65536) AS INTEGER) AS m FROM w" for d, cells in _CELLS.items() for i, e in enumerate(cells)))
def o18(spark, sf):
    rows = [(n, d, r, c, m) for n in T.SPACES for d, whole in zip(_CELLS, T.matrices(n)) for r, line in enumerate(whole) for c, m in enumerate(line)]
    return spark.createDataFrame(rows, "space string, direction string, row int, col int, m int")


@query("o22_buffers", _with(VIEWS["rgb"]) + "SELECT y, x, CASE WHEN x BETWEEN 10 AND 19 THEN b ELSE r END AS part, b AS swapped_r, r AS swapped_b, 0 AS zero, 128 AS filled, r = b AS same FROM rgb")
def o22(spark, sf):
    part = F.when(F.col("x").between(10, 19), F.col("b")).otherwise(F.col("r"))
    return views.rgb(spark, sf).select("y", "x", part.alias("part"), F.col("b").alias("swapped_r"), F.col("r").alias("swapped_b"), F.lit(0).alias("zero"), F.lit(128).alias("filled"), (F.col("r") == F.col("b")).alias("same"))


@query("o38_quant_scan", _with(*CODED) + "SELECT qz.block_id, CAST(k AS INTEGER) AS k, CAST(r AS INTEGER) AS i, CAST(v AS INTEGER) AS level, CAST(v * q AS INTEGER) AS coeff FROM qz JOIN qtab USING (k) JOIN scan USING (k)")
def o38(spark, sf):
    back = F.posexplode(F.arrays_zip("zz", F.transform(F.array(*map(F.lit, T.ZIGZAG)), lambda r: F.col("back")[r]).alias("c"))).alias("k", "x")
    df = coded(spark, sf).withColumn("back", K.unquant_scan("zz", LUMA)).select("block_id", back)
    place = F.array(*map(F.lit, T.ZIGZAG))
    return df.select("block_id", "k", F.get(place, F.col("k")).alias("i"), F.col("x.zz").cast("int").alias("level"), F.col("x.c").cast("int").alias("coeff"))


@query("o47_default_tables", _with(CODES) + "SELECT class, CAST(len AS INTEGER) AS len, count(*) AS n, min(symbol) AS least, max(symbol) AS most FROM codes GROUP BY ALL")
def o47(spark, sf):
    rows = [(kind, s, n) for kind in ("DC", "AC") for s, (n, _) in T.canonical(*T.standard(kind, 0)).items()]
    return spark.createDataFrame(rows, "class string, symbol int, len int").groupBy("class", "len").agg(F.count("*").alias("n"), F.min("symbol").alias("least"), F.max("symbol").alias("most"))


@query("o72_mean", "SELECT user_id % 10 AS k, round(favg(value), 6) AS mean, count(*) AS n FROM events GROUP BY k")
def o72(spark, sf):
    return codec.exact_mean(views._table(spark, sf, "events").withColumn("k", F.col("user_id") % 10), "k", "value")


@query("o81_block_distortion", _with(*CODED, REC, PAIRS, _cost("qz", "qtab", "bc")) + "SELECT block_id, exact, ssd AS approx FROM (SELECT block_id, CAST(sum(d * d) AS BIGINT) AS exact FROM d GROUP BY block_id) JOIN bc USING (block_id)")
def o81(spark, sf):
    exact = pairs(spark, sf).groupBy("block_id").agg(F.sum(F.col("d") * F.col("d")).alias("exact"))
    return exact.join(block_costs(coded(spark, sf), LUMA).select("block_id", F.col("ssd").alias("approx")), "block_id")


# ---- bit streams in SQL: codes and remainders as text of 0 and 1, joined in coding order
def _bits(blocks: str) -> list[str]:
    """blocks: qz's rows with slice and place b. The last table is str(frame, slice, s)."""
    return [
        f"q AS ({blocks})",
        "dc AS (SELECT frame, slice, b, v - coalesce(lag(v) OVER (PARTITION BY frame, slice ORDER BY b), 0) AS d FROM q WHERE k = 0)",
        "ac AS (SELECT frame, slice, b, k, v, k - coalesce(lag(k) OVER (PARTITION BY frame, b ORDER BY k), 0) - 1 AS run FROM q WHERE k > 0 AND v <> 0)",
        f"""tok AS (SELECT frame, slice, b, 0 AS k, 0 AS o, 'DC' AS class, {CAT.format('d')} AS symbol, d AS v FROM dc
          UNION ALL SELECT frame, slice, b, k, 0, 'AC', 240, 0 FROM (SELECT *, unnest(range(run // 16)) FROM ac)
          UNION ALL SELECT frame, slice, b, k, 1, 'AC', (run % 16) * 16 + {CAT.format('v')}, v FROM ac
          UNION ALL SELECT frame, slice, b, 64, 0, 'AC', 0, 0 FROM q GROUP BY frame, slice, b HAVING max(CASE WHEN v <> 0 THEN k ELSE 0 END) < 63)""",
        CODES,
        "word AS (SELECT frame, slice, b, k, o, lpad(bin(CAST(code AS BIGINT)), len, '0') || CASE WHEN symbol % 16 = 0 THEN '' ELSE lpad(bin(CAST(CASE WHEN v > 0 THEN v ELSE v - 1 + (1 << (symbol % 16)) END AS BIGINT)), CAST(symbol % 16 AS INTEGER), '0') END AS s FROM tok JOIN codes USING (class, symbol))",
        "str AS (SELECT frame, slice, string_agg(s, '' ORDER BY b, k, o) AS s FROM word GROUP BY frame, slice)",
        "nib AS (SELECT frame, slice, s, rpad(s, CAST((length(s) + 7) // 8 * 8 AS INTEGER), '1') AS p FROM str)",
        """hexed AS (SELECT frame, slice, s, array_to_string(list_transform(range(length(p) // 4), lambda i: substr('0123456789ABCDEF', 1 + 8 * CAST(substr(p, 4 * i + 1, 1) AS INTEGER) + 4 * CAST(substr(p, 4 * i + 2, 1) AS INTEGER) + 2 * CAST(substr(p, 4 * i + 3, 1) AS INTEGER) + CAST(substr(p, 4 * i + 4, 1) AS INTEGER), 1)), '') AS h FROM nib)""",
        r"stuffed AS (SELECT frame, slice, length(s) AS nbits, replace(regexp_replace(regexp_replace(h, '(..)', '\1 ', 'g'), 'FF ', 'FF00 ', 'g'), ' ', '') AS data FROM hexed)",
    ]


_DEALT = "SELECT frame, place // 16 AS slice, place AS b, k, CAST(v AS BIGINT) AS v FROM qz JOIN (SELECT block_id, frame, row_number() OVER (PARTITION BY frame ORDER BY block_id) - 1 AS place FROM blk) USING (block_id, frame)"
SLICES = _with(*CODED, *_bits(_DEALT))


def _sliced(spark, sf):
    return codec.encode_slices(coded(spark, sf).select("frame", "block_id", "zz"), restart=16)


@query("o51_encode", SLICES + "SELECT frame, CAST(slice AS INTEGER) AS slice, nbits, data FROM stuffed")
def o51(spark, sf):
    return _sliced(spark, sf).select("frame", "slice", "nbits", F.hex("data").alias("data"))


@query("o53_bits", SLICES + "SELECT frame, CAST(slice AS INTEGER) AS slice, length(s) AS nbits, h AS data FROM hexed")
def o53(spark, sf):
    """The bit writer's bytes before stuffing."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.hex("data"), "(..)", "$1 "), "FF 00 ", "FF "), " ", "")
    return _sliced(spark, sf).select("frame", "slice", "nbits", plain.alias("data"))


@query("o54_concat", SLICES + "SELECT frame, sum(length(s)) AS nbits, md5(string_agg(s, '' ORDER BY slice)) AS md5 FROM hexed GROUP BY frame".replace("sum(length(s))", "CAST(sum(length(s)) AS BIGINT)"))
def o54(spark, sf):
    """Chunks joined at the bit, without what aligns them."""
    return codec.join_chunks(_sliced(spark, sf)).select("frame", "nbits", F.md5("bits").alias("md5"))


# ---- whole frames: rasters of ten lines in SQL, with partial blocks padded by their last column and row
_COLS, _LINES = -(-WIDTH // 8), -(-ROWS_A_FRAME // 8)
_N = _COLS * _LINES


def _framed(quality: int) -> list[str]:
    px = f"""whole AS (SELECT y // {ROWS_A_FRAME} AS frame FROM ras1 GROUP BY y // {ROWS_A_FRAME} HAVING count(DISTINCT y) = {ROWS_A_FRAME}),
px AS (SELECT frame * {_N} + m AS block_id, frame, i, v FROM whole, range({_N}) a(m), range(64) c(i) JOIN ras1 ON y = frame * {ROWS_A_FRAME} + least({ROWS_A_FRAME - 1}, m // {_COLS} * 8 + i // 8) AND x = least({WIDTH - 1}, m % {_COLS} * 8 + i % 8))"""
    return [VIEWS["ras1"], px, BASIS, SCAN, _qtab(quality), ROWS, COEF, _qz()]


def _hex(*values: int) -> str:
    return "".join(f"{v:02X}" for v in values)


def _heads(quality: int, restart: int = 0) -> list[tuple[str, str]]:
    """Marker and payload of a grey frame's segments, as hex text."""
    size = _hex(ROWS_A_FRAME >> 8, ROWS_A_FRAME & 255, WIDTH >> 8, WIDTH & 255)
    tables = [("C4", _hex(16 * (kind == "AC"), *T.standard(kind, 0)[0], *T.standard(kind, 0)[1])) for kind in ("DC", "AC")]
    return [("E0", "4A464946000101000001000100" + "00"), ("DB", _hex(0, *T.quant_table(quality))), *([("DD", _hex(restart >> 8, restart & 255))] if restart else []), ("C0", "08" + size + "01011100"), *tables, ("DA", "010100003F00")]


def _head(quality: int) -> str:
    return "FFD8" + "".join(f"FF{m}{len(p) // 2 + 2:04X}{p}" for m, p in _heads(quality))


def _frames(spark, sf):
    return codec.raster_frames(views.ras1(spark, sf), ROWS_A_FRAME)


_FILE = _with(*_framed(Q), *_bits(f"SELECT frame, 0 AS slice, block_id % {_N} AS b, k, CAST(v AS BIGINT) AS v FROM qz"), f"f AS (SELECT frame, unhex('{_head(Q)}' || data || 'FFD9') AS jpeg FROM stuffed)")
_OUT = "SELECT CAST(frame AS INTEGER) AS frame, CAST(octet_length(jpeg) AS INTEGER) AS n_bytes, sha256(jpeg) AS sha256 FROM f"


@query("o84_simple", _FILE + _OUT)
def o84(spark, sf):
    return codec.encode(_frames(spark, sf), codec.Config(WIDTH, ROWS_A_FRAME, quality=Q)).select("frame", F.octet_length("jpeg").alias("n_bytes"), F.sha2("jpeg", 256).alias("sha256"))


@query("o6_stream", _FILE + "SELECT count(*) AS frames, CAST(sum(octet_length(jpeg)) AS BIGINT) AS n_bytes, md5(string_agg(hex(jpeg), '' ORDER BY frame)) AS md5 FROM f")
def o6(spark, sf):
    """Frames' bytes in one stream, in order. The digest is of all bytes as hex text."""
    jpeg = codec.encode(_frames(spark, sf), codec.Config(WIDTH, ROWS_A_FRAME, quality=Q))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", F.hex("jpeg").alias("h")))), lambda x: x["h"]), "")
    return jpeg.agg(F.count("*").alias("frames"), F.sum(F.octet_length("jpeg")).cast("bigint").alias("n_bytes"), F.md5(whole).alias("md5"))


#: Decoded samples of a frame, clipped and cropped.
_DECODED = "SELECT CAST(frame AS INTEGER) AS frame, {w} AS width, {h} AS height, CAST(count(*) AS INTEGER) AS n, CAST(sum(least(v, 255)) AS BIGINT) AS total FROM rec WHERE block_id % {n} // {c} * 8 + i // 8 < {h} AND block_id % {c0} % {c} * 8 + i % 8 < {w} GROUP BY frame".format(w=WIDTH, h=ROWS_A_FRAME, n=_N, c0=_N, c=_COLS)


@query("o86_decoder", _with(*_framed(90), REC) + _DECODED)
def o86(spark, sf):
    jpeg = codec.encode(_frames(spark, sf), codec.Config(WIDTH, ROWS_A_FRAME, quality=90, restart=5))
    return codec.decode(jpeg).select("frame", "width", "height", F.size("px").alias("n"), F.aggregate("px", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"))


# ---- files: written by tasks into the shared folder and scanned again
_WHOLE = f"whole AS (SELECT y // {ROWS_A_FRAME} AS frame FROM ras1 GROUP BY y // {ROWS_A_FRAME} HAVING count(DISTINCT y) = {ROWS_A_FRAME})"


@query("o1_raw_scan", _with(VIEWS["ras1"], _WHOLE) + f"SELECT CAST(frame AS INTEGER) AS frame, CAST(count(*) AS INTEGER) AS n, CAST(sum(v * (x + 1)) AS BIGINT) AS total FROM whole JOIN ras1 ON y // {ROWS_A_FRAME} = frame GROUP BY frame")
def o1(spark, sf):
    folder = formats.shared_folder(spark, "raw")
    formats.write_files(formats.write_raw(_frames(spark, sf)), folder, "yuv")
    back = formats.read_raw(spark, folder, WIDTH, ROWS_A_FRAME, 400)
    total = F.aggregate(F.transform(F.col("planes")[0], lambda v, i: (v * (i % WIDTH + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return back.select(F.regexp_extract("path", r"f_(\d+)", 1).cast("int").alias("frame"), F.size(F.col("planes")[0]).alias("n"), total.alias("total"))


@query("o2_raw_sink", _with(VIEWS["ras1"], _WHOLE) + f"SELECT CAST(frame AS INTEGER) AS frame, CAST(count(*) AS INTEGER) AS n_bytes, md5(string_agg(printf('%02X', v), '' ORDER BY y, x)) AS md5 FROM whole JOIN ras1 ON y // {ROWS_A_FRAME} = frame GROUP BY frame")
def o2(spark, sf):
    return formats.write_raw(_frames(spark, sf)).select("frame", F.octet_length("data").alias("n_bytes"), F.md5(F.hex("data")).alias("md5"))


@query("o3_seek", _with(VIEWS["ras1"], _WHOLE) + "SELECT CAST(frame AS INTEGER) AS frame FROM whole WHERE frame >= 3")
def o3(spark, sf):
    return formats.select_frames(_frames(spark, sf), 3).select("frame")


_RGB = 100  # the raster's width
_RGB_WHOLE = f"whole AS (SELECT y // {ROWS_A_FRAME} AS frame FROM rgb GROUP BY y // {ROWS_A_FRAME} HAVING count(*) = {ROWS_A_FRAME * _RGB})"
_SUMS = _with(VIEWS["rgb"], _RGB_WHOLE) + f"SELECT CAST(frame AS INTEGER) AS frame, CAST(sum(r * (x + 1)) AS BIGINT) AS red, CAST(sum(g * (x + 1)) AS BIGINT) AS green, CAST(sum(b * (x + 1)) AS BIGINT) AS blue FROM whole JOIN rgb ON y // {ROWS_A_FRAME} = frame GROUP BY frame"


def _pictures(spark, sf):
    rows = views.rgb(spark, sf).withColumn("frame", F.floor(F.col("y") / ROWS_A_FRAME).cast("int"))
    whole = rows.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b"))).alias("p")).where(F.size("p") == ROWS_A_FRAME * _RGB)
    return whole.select("frame", F.array("p.r", "p.g", "p.b").alias("planes"))


def _round_trip(spark, sf, kind: str):
    folder = formats.shared_folder(spark, kind)
    formats.write_files(formats.encode_pictures(_pictures(spark, sf), kind, _RGB, ROWS_A_FRAME), folder, kind)
    total = lambda c: F.aggregate(F.transform(F.col("planes")[c], lambda v, i: (v * (i % _RGB + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, b: a + b)
    return formats.read_pictures(spark, folder, kind, _RGB, ROWS_A_FRAME).select("frame", *[total(i).alias(n) for i, n in enumerate(("red", "green", "blue"))])


@query("o4_png", _SUMS)
def o4(spark, sf):
    return _round_trip(spark, sf, "png")


@query("o5_bmp", _SUMS)
def o5(spark, sf):
    return _round_trip(spark, sf, "bmp")


_BMP = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + 3 * _RGB * ROWS_A_FRAME, 0, 0, 54, 40, _RGB, ROWS_A_FRAME, 1, 24, 0, 3 * _RGB * ROWS_A_FRAME, 2835, 2835, 0, 0).hex().upper()


@query("o5_bmp_sink", _with(VIEWS["rgb"], _RGB_WHOLE) + f"SELECT CAST(frame AS INTEGER) AS frame, md5('{_BMP}' || string_agg(printf('%02X%02X%02X', b, g, r), '' ORDER BY y DESC, x)) AS md5 FROM whole JOIN rgb ON y // {ROWS_A_FRAME} = frame GROUP BY frame")
def o5_sink(spark, sf):
    return formats.encode_pictures(_pictures(spark, sf), "bmp", _RGB, ROWS_A_FRAME).select("frame", F.md5(F.hex("data")).alias("md5"))


# ---- segments of streams
_RESTART = 7
_SEGMENTS = _with(VIEWS["ras1"], _WHOLE, _values("seg", "i, marker, payload", [(i, m, p) for i, (m, p) in enumerate(_heads(Q, _RESTART))]))


def _segments(spark, sf):
    return codec.segments(codec.encode(_frames(spark, sf), codec.Config(WIDTH, ROWS_A_FRAME, quality=Q, restart=_RESTART)))


for _name, _marker in {"o56_app0": "E0", "o57_dqt": "DB", "o58_dri": "DD", "o59_sof": "C0", "o60_dht": "C4", "o61_sos": "DA"}.items():

    @query(_name, _SEGMENTS + f"SELECT CAST(frame AS INTEGER) AS frame, CAST(i AS INTEGER) AS i, CAST(length(payload) // 2 + 2 AS INTEGER) AS length, payload FROM whole, seg WHERE marker = '{_marker}'")
    def _one(spark, sf, marker=_marker):
        return _segments(spark, sf).where(F.col("marker") == marker).select("frame", "i", "length", "payload")


@query("o62_restart", _SEGMENTS + f"SELECT CAST(frame AS INTEGER) AS frame, CAST(k AS INTEGER) AS k, printf('%02X', 208 + k % 8) AS marker FROM whole, range({-(-_N // _RESTART) - 1}) t(k)")
def o62(spark, sf):
    return _segments(spark, sf).where(F.col("marker").between("D0", "D7")).select("frame", (F.row_number().over(codec.by_frame("i")) - 1).alias("k"), "marker")


@query("o65_headers", _SEGMENTS + f"SELECT CAST(frame AS INTEGER) AS frame, {WIDTH} AS width, {ROWS_A_FRAME} AS height, 1 AS components, {_RESTART} AS restart, {sum(LUMA)} AS quant_sum, {sum(len(T.standard(k, c)[1]) for k in ('DC', 'AC') for c in (0, 1))} AS codes FROM whole")
def o65(spark, sf):
    return codec.headers_of(codec.encode(_frames(spark, sf), codec.Config(WIDTH, ROWS_A_FRAME, quality=Q, restart=_RESTART)))


@query("o82_designed_tables")
def o82(spark, sf):
    """Tables designed for each frame: a frame's bytes with the standard's tables and with its own."""
    cfg = codec.Config(WIDTH, ROWS_A_FRAME, quality=Q)
    return codec.compare(_frames(spark, sf), cfg, codec.replaced(cfg, optimise_tables=True))


@query("o83_passes")
def o83(spark, sf):
    """Repeated passes over pictures and blocks against one of each."""
    cfg = codec.Config(WIDTH, ROWS_A_FRAME, quality=Q, optimise_coefficients=True, optimise_tables=True)
    return codec.compare(_frames(spark, sf), cfg, codec.replaced(cfg, picture_passes=2, block_passes=2))
