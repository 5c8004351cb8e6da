"""Sources and sinks: raw planar video, PNG and BMP pictures, JPEG streams; parsers of sizes, formats and file names."""

from __future__ import annotations

import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.jfif import SAMPLING


def parse_size(df: DataFrame, c: str) -> DataFrame:
    """w and h of WxH; null if it isn't that."""
    part = lambda i: F.regexp_extract(c, r"^([0-9]+)[xX]([0-9]+)$", i).try_cast("int")
    return df.withColumns({"w": part(1), "h": part(2)})


def parse_pixel_format(c: Column | str) -> tuple[Column, Column]:
    """Chroma format and bit depth of yuv420p, yuv422p10le, gray12le and the like; null if not known. Big-endian names aren't."""
    found = lambda i: F.regexp_extract(c, r"^(?:yuv(420|422|444)p|(gray))(?:(9|10|12|14|16)le)?$", i)
    chroma = F.when(found(2) == "gray", F.lit(400)).otherwise(found(1).try_cast("int"))
    return chroma, F.when(chroma.isNotNull(), F.coalesce(found(3).try_cast("int"), F.lit(8)))


def parse_weights(c: Column | str, kind: str = "double") -> Column:
    """a:b:c:d as an array; null if a part isn't a number."""
    parts = F.transform(F.split(c, ":"), lambda p: p.try_cast(kind))
    return F.when(F.forall(parts, lambda p: p.isNotNull()), parts)


def infer(df: DataFrame, path: str) -> DataFrame:
    """w, h, chroma, depth, as a path's file name shows them, else its folders: patterns in order of trust; null if none is sure."""
    name, parent = F.regexp_extract(path, r"([^/]*)$", 1), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)

    def first(*patterns: str) -> Column:
        tries = [F.regexp_extract(s, p, 1).try_cast("int") for s in (name, parent) for p in patterns]
        return F.coalesce(*tries)

    size = r"^.*?([0-9]+)[xX]([0-9]+)(?!.*[0-9][xX][0-9])"
    both = [F.coalesce(*[F.regexp_extract(s, size, i).try_cast("int") for s in (name, parent)]) for i in (1, 2)]
    chroma = F.coalesce(first(r"yuv(420|422|444)p(?:9|10|12|14|16)(?:le|be)"), F.when(name.rlike("gray(9|10|12|14|16)(le|be)"), F.lit(400)), first(r"(?:cf|CF)(400|420|422|444)_", r"yuv(420|422|444)p"))
    depth = first(r"(?:yuv(?:420|422|444)p|gray)(9|10|12|14|16)(?:le|be)", r"_(8|9|10|12|14|16)bps")
    return df.withColumns({"w": both[0], "h": both[1], "chroma": chroma, "depth": depth})


def mismatches(df: DataFrame, w: int, h: int, chroma: int, depth: int) -> DataFrame:
    """Rows of infer() of which a sure value differs from what is declared."""
    differ = [F.coalesce(F.col(c) != v, F.lit(False)) for c, v in (("w", w), ("h", h), ("chroma", chroma), ("depth", depth))]
    return df.where(differ[0] | differ[1] | differ[2] | differ[3])


def select_frames(df: DataFrame, start: int, n: int = -1, frame: str = "frame") -> DataFrame:
    out = df.where(F.col(frame) >= start)
    return out.where(F.col(frame) < start + n) if n > 0 else out


def find_marker(df: DataFrame, c: str) -> DataFrame:
    """at: the offset in bytes of the first marker in hex text; -1 none, -2 if the last byte may begin one."""
    n = F.floor(F.length(c) / 2).cast("int")
    byte = lambda i: F.substring(F.col(c), i * 2 + 1, F.lit(2))
    hits = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: (byte(i) == "ff") & ~byte(i + 1).isin("00", "ff"))
    return df.withColumn("at", F.coalesce(F.try_element_at(hits, F.lit(1)), F.when(byte(n - 1) == "ff", -2).otherwise(-1)))


# ---- raw planar video
def frame_shape(width: int, height: int, chroma: int, depth: int) -> tuple[list[tuple[int, int]], int]:
    """Shapes of a frame's planes and its bytes."""
    h, v = SAMPLING[chroma]
    shapes = [(height, width)] + ([] if chroma == 400 else [(-(-height // v), -(-width // h))] * 2)
    return shapes, sum(a * b for a, b in shapes) * (1 if depth <= 8 else 2)


def read_raw(spark: SparkSession, path: str, width: int, height: int, chroma: int = 420, depth: int = 8, range_bytes: int = 64 << 20) -> DataFrame:
    """path, frame, planes. Each file's frames; a trailing partial frame is left out. Files are read in ranges of whole frames of about range_bytes, so a file may be larger than a task's memory."""
    shapes, size = frame_shape(width, height, chroma, depth)
    ends = np.cumsum([a * b for a, b in shapes])
    step = max(1, range_bytes // size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, first, n in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n"))):
                store, inner = fs.FileSystem.from_uri(name)
                with store.open_input_file(inner) as file:
                    for f in range(first, first + n):
                        file.seek(f * size)
                        flat = np.frombuffer(file.read(size), "<u2" if depth > 8 else np.uint8).astype(np.int32)
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([f], pa.int32()), pa.array([np.split(flat, ends[:-1])], pa.list_(pa.list_(pa.int32())))], names=["path", "frame", "planes"])

    # The content column is not selected, so only names and lengths are read here.
    files = spark.read.format("binaryFile").load(path).select("path", F.floor(F.col("length") / size).cast("int").alias("frames"))
    starts = files.where("frames > 0").select("path", "frames", F.explode(F.sequence(F.lit(0), F.col("frames") - 1, F.lit(step))).alias("first"))
    ranges = starts.select("path", "first", F.least(F.lit(step), F.col("frames") - F.col("first")).alias("n"))
    return ranges.repartition("path", "first").mapInArrow(cut, "path string, frame int, planes array<array<int>>")


def write_raw(frames: DataFrame, depth: int = 8) -> DataFrame:
    """frame, data: packed bytes; samples clip to what the depth's bytes hold."""

    @F.arrow_udf("binary")
    def packed(planes: pa.Array) -> pa.Array:
        kind, most = ("<u2", 65535) if depth > 8 else ("u1", 255)
        return pa.array([b"".join(np.clip(p, 0, most).astype(kind).tobytes() for p in row) for row in planes.to_pylist()], pa.binary())

    return frames.select("frame", packed("planes").alias("data"))


def write_stream(frames: DataFrame, path: str, column: str = "data") -> int:
    """Appends frames' bytes to one file in order; one frame at a time is on the driver. Returns the bytes written."""
    n = 0
    with open(path, "wb") as out:
        for row in frames.orderBy("frame").select(column).toLocalIterator():
            n += out.write(row[0])
    return n


# ---- pictures
def bmp_encode(rgb: np.ndarray) -> bytes:
    """24-bit, bottom-up, rows padded to 4 bytes."""
    h, w, _ = rgb.shape
    rows = np.zeros((h, (w * 3 + 3) // 4 * 4), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def bmp_decode(data: bytes) -> np.ndarray:
    offset, (w, h), bits, packed = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<ii", data, 18), struct.unpack_from("<H", data, 28)[0], struct.unpack_from("<I", data, 30)[0]
    if data[:2] != b"BM" or bits not in (24, 32) or packed:
        raise ValueError("only 24 and 32-bit uncompressed BMP is read")
    n, stride = bits // 8, (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, abs(h) * stride, offset).reshape(abs(h), stride)[:, : w * n].reshape(abs(h), w, n)
    return (rows[::-1] if h > 0 else rows)[:, :, 2::-1].copy()


def png_encode(rgb: np.ndarray) -> bytes:
    h, w, _ = rgb.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.c_[np.zeros((h, 1), np.uint8), rgb.astype(np.uint8).reshape(h, -1)].tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_decode(data: bytes) -> np.ndarray:
    """8-bit RGB, not interlaced; all five row filters."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, idat, w, h = 8, b"", 0, 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (depth, colour, interlace) != (8, 2, 0):
                raise ValueError("only 8-bit RGB without interlace is read")
        idat += body if kind == b"IDAT" else b""
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(h, 1 + 3 * w)
    out, above = np.zeros((h, 3 * w), np.uint8), np.zeros(3 * w, np.int64)
    for y in range(h):
        kind, row = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            row = row + above
        elif kind in (1, 3, 4):
            for i in range(3 * w):
                a, b, c = (row[i - 3] if i > 2 else 0), above[i], (above[i - 3] if i > 2 else 0)
                p = a + b - c
                paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
                row[i] = (row[i] + (a if kind == 1 else (a + b) // 2 if kind == 3 else paeth)) & 255
        above = row & 255
        out[y] = above
    return out.reshape(h, w, 3)


def read_pictures(spark: SparkSession, folder: str, kind: str, width: int, height: int) -> DataFrame:
    """frame, planes (R, G, B) of numbered files, up to the first gap; numbering begins at 0 if that file exists, else at 1. Sizes must be as declared."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.{kind}").withColumn("frame", F.regexp_extract("path", rf"([0-9]+)\.{kind}$", 1).cast("int"))
    numbers = files.select("frame").withColumns({"i": F.row_number().over(Window.orderBy("frame")) - 1, "first": F.min("frame").over(Window.partitionBy())})
    whole = numbers.where((F.col("frame") - F.col("i") == F.col("first")) & (F.col("first") <= 1)).select("frame")
    decoder = {"bmp": bmp_decode, "png": png_decode}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, data in zip(batch.column("frame").to_pylist(), batch.column("content").to_pylist()):
                rgb = decoder(data)
                if rgb.shape[:2] != (height, width):
                    raise ValueError(f"picture {frame} has another size than declared")
                yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int32()), pa.array([[rgb[:, :, c].reshape(-1).astype(np.int32) for c in range(3)]], pa.list_(pa.list_(pa.int32())))], names=["frame", "planes"])

    return files.join(whole, "frame").select("frame", "content").mapInArrow(run, "frame int, planes array<array<int>>")


def encode_pictures(frames: DataFrame, kind: str, width: int, height: int) -> DataFrame:
    """frames: frame, planes (red, green and blue samples of 8 bits). frame, data: a picture file's bytes."""
    encode = {"png": png_encode, "bmp": bmp_encode}[kind]

    @F.arrow_udf("binary")
    def packed(planes: pa.Array) -> pa.Array:
        return pa.array([encode(np.array(row, np.uint8).reshape(3, height, width).transpose(1, 2, 0)) for row in planes.to_pylist()], pa.binary())

    return frames.select("frame", packed("planes").alias("data"))


def write_files(rows: DataFrame, folder: str, suffix: str) -> int:
    """rows: frame, data. Writes a file per frame, named by its number, from the tasks that have them; a repeated task writes the same bytes again. Returns the bytes written."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        store.create_dir(inner, recursive=True)
        for batch in batches:
            sizes = []
            for frame, data in zip(batch.column("frame").to_pylist(), batch.column("data").to_pylist()):
                with store.open_output_stream(f"{inner}/f_{frame}.{suffix}") as out:
                    sizes.append(out.write(data))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], names=["n"])

    return rows.select("frame", "data").mapInArrow(put, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir; a temporary one where that is unset (one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="blockloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
