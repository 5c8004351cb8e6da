import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.operators import pixels as P
from blockloom.plans import codec
from blockloom.sources import formats as S
from blockloom.streaming import frames as stream

RNG = np.random.default_rng(3)


def test_parsers(spark):
    df = spark.createDataFrame([("64x32",), ("x",), ("12X",)], "s string")
    assert [(r.w, r.h) for r in S.parse_size(df, "s").collect()] == [(64, 32), (None, None), (None, None)]
    df = spark.createDataFrame([("yuv420p",), ("yuv422p10le",), ("gray12le",), ("yuv420p10be",), ("rgb",)], "s string")
    c, d = S.parse_pixel_format("s")
    assert [tuple(r) for r in df.select(c, d).collect()] == [(420, 8), (422, 10), (400, 12), (None, None), (None, None)]
    df = spark.createDataFrame([("1:2.5:3:4",), ("1:a",)], "s string")
    assert [r[0] for r in df.select(S.parse_weights("s")).collect()] == [[1.0, 2.5, 3.0, 4.0], None]


def test_names(spark):
    df = spark.createDataFrame([("a/b_1x2_64x32_yuv422p10le.yuv",), ("c_16x8_cf444_/x.yuv",), ("x",)], "p string")
    assert [(r.w, r.h, r.chroma, r.depth) for r in S.infer(df, "p").collect()] == [(64, 32, 422, 10), (16, 8, 444, None), (None, None, None, None)]
    assert S.mismatches(S.infer(df, "p"), 64, 32, 422, 10).count() == 1


@pytest.mark.parametrize("depth", [8, 10])
def test_raw(spark, tmp_path, depth):
    shapes, _ = S.frame_shape(6, 4, 420, depth)
    planes = [[RNG.integers(0, 1 << depth, a * b).tolist() for a, b in shapes] for _ in range(3)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(planes)], "frame int, planes array<array<int>>")
    path = str(tmp_path / "v.yuv")
    S.write_stream(S.write_raw(df, depth), path)
    with open(path, "ab") as f:
        f.write(b"part")
    for range_bytes in (1, 64 << 20):  # a range for each frame, and one for all
        back = S.read_raw(spark, path, 6, 4, 420, depth, range_bytes).orderBy("frame").collect()
        assert [r.planes for r in back] == planes


@pytest.mark.parametrize("kind, encode, decode", [("bmp", S.bmp_encode, S.bmp_decode), ("png", S.png_encode, S.png_decode)])
def test_pictures(spark, tmp_path, kind, encode, decode):
    pics = [RNG.integers(0, 256, (5, 7, 3)).astype(np.uint8) for _ in range(5)]
    assert all((decode(encode(p)) == p).all() for p in pics)
    for i, p in enumerate(pics):
        if i != 3:
            (tmp_path / f"f_{i}.{kind}").write_bytes(encode(p))
    back = S.read_pictures(spark, str(tmp_path), kind, 7, 5).orderBy("frame").collect()
    assert [r.frame for r in back] == [0, 1, 2]  # to the first gap
    assert all((np.array(r.planes).reshape(3, 5, 7).transpose(1, 2, 0) == pics[r.frame]).all() for r in back)


def test_constant_margin(spark):
    df = spark.createDataFrame([(y, x, 5) for y in range(3) for x in range(4)], "y int, x int, v int")
    out = P.extend(df, 4, 3, 2, "Constant", 9)
    assert out.count() == 8 * 7 and out.where("v = 5").count() == 12 and out.where("v = 9").count() == 44


def test_encode_decode_evaluate_and_stream(spark, tmp_path):
    y, x = np.mgrid[:16, :24]
    frames = spark.createDataFrame([(i, [((x * 5 + y * 3 + i) % 200).reshape(-1).tolist()]) for i in range(3)], stream.SCHEMA)
    cfg = codec.Config(24, 16, quality=95)
    jpeg = codec.encode(frames, cfg)
    assert all(r.psnr > 25 for r in codec.evaluate(frames, codec.decode(jpeg)).collect())
    frames.write.parquet(str(tmp_path / "in"))
    stream.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), cfg)
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("frame").collect()
    assert [(r.frame, bytes(r.jpeg)) for r in out] == [(r.frame, bytes(r.jpeg)) for r in jpeg.orderBy("frame").collect()]


def test_configuration():
    text = """PictureSize = "24x16" ; a comment
Quality = 60
[opt]
OptQuantCoeffs = 1  # on
DistCalkMode = Approx
layout = Flat
FrameRate = 25
"""
    cfg = codec.Config.read(text, quality=70)
    assert (cfg.width, cfg.height, cfg.quality, cfg.optimise_coefficients, cfg.exact_distortion, cfg.layout) == (24, 16, 70, True, False, "Flat")
    own = codec.Config.from_arguments(["-q", "10", "-c", "a", "-cf", "422", "--RestartInterval=-1", "-oet", "1"], {"a": text})
    assert (own.width, own.quality, own.chroma, own.restart, own.optimise_tables, own.exact_distortion) == (24, 60, 422, -1, True, False)
    for wrong in (["-q"], ["q", "5"], ["-ps", "8x8", "-q", "101"]):
        with pytest.raises(ValueError):
            codec.Config.from_arguments(wrong, width=8, height=8)


def test_segments_and_chunks(spark):
    frames = spark.createDataFrame([(0, [[i % 251 for i in range(24 * 16)]])], stream.SCHEMA)
    jpeg = codec.encode(frames, codec.Config(24, 16, quality=80, restart=2))
    found = codec.segments(jpeg).orderBy("i").collect()
    assert [r.marker for r in found] == ["E0", "DB", "DD", "C0", "C4", "C4", "DA", "D0", "D1"] and [r.length for r in found][-2:] == [0, 0]
    assert tuple(codec.headers_of(jpeg).first())[:5] == (0, 24, 16, 1, 2)
    parts = spark.createDataFrame([(0, 1, 9, b"\xff\x00\x80"), (0, 0, 3, b"\xbf")], "frame int, slice int, nbits bigint, data binary")
    assert codec.join_chunks(parts).first().bits == "101" + "111111111"


def test_passes_and_tables(spark):
    y, x = np.mgrid[:16, :24]
    frames = spark.createDataFrame([(i, [((x * 7 + y * y + i * 3) % 256).reshape(-1).tolist()]) for i in range(2)], stream.SCHEMA)
    cfg = codec.Config(24, 16, quality=60)
    rows = codec.compare(frames, cfg, codec.replaced(cfg, optimise_tables=True)).collect()
    assert len(rows) == 2 and all(r.ssd_a == r.ssd_b and r.bytes_b < r.bytes_a for r in rows)
    assert codec.compare(frames, codec.replaced(cfg, optimise_coefficients=True), codec.replaced(cfg, optimise_coefficients=True, block_passes=2, picture_passes=2)).count() == 2


def test_empty(spark):
    empty = spark.createDataFrame([], stream.SCHEMA)
    cfg = codec.Config(8, 8)
    assert codec.decode(codec.encode(empty, cfg)).count() == 0
    assert codec.evaluate(empty, codec.decode(codec.encode(empty, cfg))).select(F.count("*")).first()[0] == 0
