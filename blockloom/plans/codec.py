"""Plans of whole codecs: geometry, code design, slices, optimisation, encode, decode and evaluation. Frames and slices are independent rows or groups."""

from __future__ import annotations

import configparser
import math
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jfif
from ..functions import kernels as K
from ..functions import tables as T


@dataclass(frozen=True)
class Config:
    """What a user can set. restart counts MCUs; -1 is a row of them."""

    width: int
    height: int
    chroma: int = 400
    quality: int = 75
    layout: str = "Default"
    restart: int = 0
    optimise_coefficients: bool = False
    process_zeros: bool = False
    optimise_tables: bool = False
    block_passes: int = 1
    picture_passes: int = 1
    exact_distortion: bool = True
    lambda_mode: str = "ApproxExact"

    def __post_init__(self):
        if self.lambda_mode not in ("ApproxExact", "ApproxFast", "Exhaustive") or self.chroma not in jfif.SAMPLING or not 0 <= self.quality <= 100 or self.layout not in T.FAST or min(self.width, self.height) < 1:
            raise ValueError("not a valid configuration")

    @classmethod
    def read(cls, text: str = "", **more) -> Config:
        """From INI text (sections are flattened, # and ; begin comments, quotes are dropped; fields' or parameters' names) and keywords; what comes later wins."""
        return cls(**(_settings(text) | more))

    @classmethod
    def from_arguments(cls, tokens: list[str], files: dict[str, str] | None = None, **defaults) -> Config:
        """From command-line tokens: -short value or --Name value (or --Name=value). -c names an INI text of `files` and may be repeated; what comes later wins."""
        found, at = dict(defaults), 0
        while at < len(tokens):
            name, _, value = tokens[at].lstrip("-").partition("=")
            if not tokens[at].startswith("-") or not (value or at + 1 < len(tokens)):
                raise ValueError(f"not a parameter with its value: {tokens[at]}")
            if not value:
                at += 1
                value = tokens[at]
            if name == "c":
                found |= _settings((files or {})[value])
            else:
                found |= _setting(name, value)
            at += 1
        return cls(**found)

    @property
    def sampling(self) -> tuple[int, int]:
        return jfif.SAMPLING[self.chroma]


#: Parameters' names, lower-cased, and short flags: fixed values.
PARAMETERS = {
    "picturewidth": "width", "pw": "width", "pictureheight": "height", "ph": "height", "chromaformat": "chroma", "cf": "chroma",
    "quality": "quality", "q": "quality", "quanttablayout": "layout", "qtl": "layout", "restartinterval": "restart", "ri": "restart",
    "optquantcoeffs": "optimise_coefficients", "oqc": "optimise_coefficients", "processzerocoeffs": "process_zeros", "pzc": "process_zeros",
    "optentropytables": "optimise_tables", "oet": "optimise_tables", "numoptpassesblock": "block_passes", "npb": "block_passes",
    "numoptpassespic": "picture_passes", "npp": "picture_passes", "lambdaestmode": "lambda_mode", "lem": "lambda_mode",
    "distcalkmode": "exact_distortion", "dcm": "exact_distortion",
}


def _setting(name: str, value: str) -> dict:
    """A parameter's field and value. PictureSize gives two; a name that is no setting of the codec gives none."""
    key, value = name.lower().replace("_", ""), value.strip().strip("\"'")
    if key in ("picturesize", "ps"):
        return dict(zip(("width", "height"), map(int, value.lower().split("x"))))
    kinds = {f.name: f.type for f in fields(Config)}
    field = PARAMETERS.get(key) or next((n for n in kinds if n.replace("_", "") == key), None)
    if field is None:
        return {}
    as_kind = {"int": int, "bool": lambda v: v.lower() in ("1", "true", "yes", "exact"), "str": str}
    return {field: as_kind[kinds[field]](value)}


def _settings(text: str) -> dict:
    ini = configparser.ConfigParser(comment_prefixes=("#", ";"), inline_comment_prefixes=("#", ";"), strict=False)
    ini.read_string("[root]\n" + text)
    out: dict = {}
    for section in ini.sections():
        for name, value in ini[section].items():
            out |= _setting(name, value)
    return out


def geometry(df: DataFrame, h: int, v: int) -> DataFrame:
    up = lambda c, n: F.ceil(F.col(c) / n).cast("int")
    return df.select("id", "w", "h", up("w", 8 * h).alias("mcus_x"), up("h", 8 * v).alias("mcus_y"), up("w", h).alias("chroma_w"), up("h", v).alias("chroma_h"))


def estimate_quality(tables: DataFrame) -> DataFrame:
    """tables: quality, cmp, k, q. The quality that both tables round to; -1 if they differ."""
    base = [(c, k, t[r]) for c, t in ((0, T.LUMA), (1, T.CHROMA)) for k, r in enumerate(T.ZIGZAG)]
    both = tables.join(F.broadcast(tables.sparkSession.createDataFrame(base, "cmp int, k int, b int")), ["cmp", "k"])
    p = both.groupBy("quality", "cmp").agg(F.avg(100.0 * F.col("q") / F.col("b")).alias("p"), F.bool_and(F.col("q") == 1).alias("ones"))
    p = p.withColumn("e", F.round(F.when(F.col("p") <= 100, (200 - F.col("p")) / 2).otherwise(5000 / F.col("p"))))
    return p.groupBy("quality").agg(F.when(F.bool_and("ones"), 100).when(F.min("e") == F.max("e"), F.min("e")).otherwise(-1).cast("int").alias("estimate"))


def psnr(pairs: DataFrame) -> DataFrame:
    """frame, ssd, psnr of rows with d; an error of 0 counts as 1."""
    s = F.sum(F.col("d") * F.col("d"))
    return pairs.groupBy("frame").agg(s.alias("ssd"), F.round(10 * F.log10(F.count("*") * 65025.0 / F.greatest(s, F.lit(1))), 6).alias("psnr"))


def statistics(frames: DataFrame, rate: float) -> DataFrame:
    """frames: bytes, area. Bytes a frame, bits a second and a sample, and the size against 8-bit samples."""
    b, a = F.sum("bytes"), F.sum("area")
    return frames.agg(F.round(F.avg("bytes"), 6).alias("mean_bytes"), F.round(b * 8 * rate / F.count("*"), 6).alias("bitrate"), F.round(b * 8.0 / a, 6).alias("bits_per_pixel"), F.round(b * 1.0 / a, 6).alias("ratio"))


def design_codes(histogram: DataFrame) -> DataFrame:
    """frame, class, symbol, len, code: optimal codes of at most 16 bits. A group has at most 257 rows."""

    def design(key, pdf: pd.DataFrame) -> pd.DataFrame:
        codes = T.canonical(*K.optimal_lengths(dict(zip(pdf.symbol.tolist(), pdf.n.tolist()))))
        return pd.DataFrame([(key[0], key[1], s, n, c) for s, (n, c) in codes.items()], columns=["frame", "class", "symbol", "len", "code"])

    return histogram.groupBy("frame", "class").applyInPandas(design, "frame int, class string, symbol int, len int, code int")


def encode_slices(blocks: DataFrame, restart: int, table: int = 0) -> DataFrame:
    """blocks: frame, block_id, zz. A row per slice of `restart` blocks in block order: frame, slice, n, nbits, data."""
    codes = [(T.canonical(*T.standard("DC", table)), T.canonical(*T.standard("AC", table)))]
    place = F.row_number().over(Window.partitionBy("frame").orderBy("block_id")) - 1
    dealt = blocks.withColumn("slice", F.floor(place / restart).cast("int"))

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        data, n = K.pack(np.stack(pdf.sort_values("block_id").zz.to_list()), [0] * len(pdf), codes)
        return pd.DataFrame({"frame": [key[0]], "slice": [key[1]], "n": [len(pdf)], "nbits": [n], "data": [data]})

    return dealt.groupBy("frame", "slice").applyInPandas(pack, "frame int, slice int, n int, nbits bigint, data binary")


def decode_slices(slices: DataFrame, table: int = 0) -> DataFrame:
    """frame, slice, i, zz."""
    codes = [(T.canonical(*T.standard("DC", table)), T.canonical(*T.standard("AC", table)))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                zz = K.unpack(r.data, [0] * r.n, codes)
                yield pd.DataFrame({"frame": r.frame, "slice": r.slice, "i": range(r.n), "zz": list(zz.astype(np.int32))})

    return slices.mapInPandas(read, "frame int, slice int, i int, zz array<int>")


def code_lengths(codes: dict) -> np.ndarray:
    out = np.full(256, 16, np.int64)
    for s, (n, _) in codes.items():
        out[s] = n
    return out


def optimise(blocks: DataFrame, q: list[int], zeros: bool = False, passes: int = 1, exact: bool = False) -> DataFrame:
    """blocks: block_id, frame, px, coeff, zz, lam. Adds opt, and each block's cost and non-zero levels before and after."""
    lengths = code_lengths(T.canonical(*T.standard("AC", 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            px, coeff, zz = (batch.column(c).flatten().to_numpy().reshape(-1, 64).astype(np.int64) for c in ("px", "coeff", "zz"))
            lam, div = batch.column("lam").to_numpy(), np.array(q)
            opt = K.rdoq(zz, coeff, px if exact else None, div, lam, lengths, zeros, passes)
            cost = lambda z: (((K.inverse_dct(K.dequantise(z, div)) - px) ** 2).sum(axis=1) if exact else K.coefficient_ssd(z, coeff, div)) + lam * K.ac_bits(z, lengths)
            yield pa.RecordBatch.from_arrays([batch.column("block_id"), batch.column("frame"), pa.array(list(opt.astype(np.int32)), pa.list_(pa.int32())), pa.array(cost(zz)), pa.array(cost(opt)), pa.array((zz != 0).sum(axis=1)), pa.array((opt != 0).sum(axis=1))], names=["block_id", "frame", "opt", "cost_before", "cost_after", "nonzero_before", "nonzero_after"])

    return blocks.select("block_id", "frame", "px", "coeff", "zz", "lam").mapInArrow(run, "block_id bigint, frame int, opt array<int>, cost_before double, cost_after double, nonzero_before bigint, nonzero_after bigint")


def raster_frames(raster: DataFrame, rows: int) -> DataFrame:
    """frame, planes: rasters (y, x, v) cut into frames of `rows` lines; a trailing partial frame is left out."""
    frames = raster.groupBy(F.floor(F.col("y") / rows).cast("int").alias("frame")).agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p"), F.countDistinct("y").alias("n"))
    return frames.where(F.col("n") == rows).select("frame", F.array(F.col("p.v")).alias("planes"))


def _blocks(plane: np.ndarray, rows: int, cols: int, h: int, v: int) -> np.ndarray:
    """A plane's blocks in coding order. Partial blocks repeat the last column and row; blocks wholly outside are zero."""
    plane = np.pad(plane, ((0, -plane.shape[0] % 8), (0, -plane.shape[1] % 8)), mode="edge")
    plane = np.pad(plane, ((0, rows * 8 * v - plane.shape[0]), (0, cols * 8 * h - plane.shape[1])))
    return plane.reshape(rows, v, 8, cols, h, 8).transpose(0, 3, 1, 4, 2, 5).reshape(-1, 64)


def _plane(blocks: np.ndarray, rows: int, cols: int, h: int, v: int, height: int, width: int) -> np.ndarray:
    return blocks.reshape(rows, cols, v, h, 8, 8).transpose(0, 2, 4, 1, 3, 5).reshape(rows * v * 8, cols * h * 8)[:height, :width]


def _symbol_counts(zz: np.ndarray, slice_of: np.ndarray) -> tuple[dict, dict]:
    """Histograms of a component's DC and AC symbols."""
    first = np.r_[True, slice_of[1:] != slice_of[:-1]]
    delta = np.where(first, zz[:, 0], zz[:, 0] - np.r_[0, zz[:-1, 0]])
    dc = np.bincount(K.category(delta), minlength=12)
    block, k = np.nonzero(zz[:, 1:])
    k = k + 1
    run = np.where(np.r_[True, block[1:] != block[:-1]][: len(block)], k, k - np.r_[0, k[:-1]]) - 1
    ac = np.bincount((run % 16) * 16 + K.category(zz[block, k]), minlength=256)
    ac[0xF0] += (run // 16).sum()
    ac[0] += (zz[:, 63] == 0).sum()
    return {s: int(n) for s, n in enumerate(dc) if n}, {s: int(n) for s, n in enumerate(ac) if n}


def _rates(zz: list[np.ndarray], coeff: list[np.ndarray], quality: int, cfg: Config, table: list[int], slice_of: list[np.ndarray], made: dict) -> list[tuple[int, int]]:
    """Estimated bits and squared error of coefficients, by component."""
    out = []
    for z, c, t, s in zip(zz, coeff, table, slice_of):
        dc, ac = _symbol_counts(z, s)
        bits = sum(n * (made["DC", t].get(x, (16,))[0] + x) for x, n in dc.items()) + sum(n * (made["AC", t].get(x, (16,))[0] + (x & 15)) for x, n in ac.items())
        out.append((bits, int(K.coefficient_ssd(z, c, np.array(T.quant_table(quality, t, cfg.layout))).sum())))
    return out


def _lambdas(zz: list[np.ndarray], coeff: list[np.ndarray], cfg: Config, table: list[int], slice_of: list[np.ndarray], made: dict) -> list[float]:
    """What a bit is worth in squared error, by component."""
    rates = _rates(zz, coeff, cfg.quality, cfg, table, slice_of, made)
    if cfg.lambda_mode == "Exhaustive":
        slopes = []
        for other in ([cfg.quality - 2] if cfg.quality > 1 else []) + ([cfg.quality + 2] if cfg.quality < 100 else []):
            aside = [K.quantise(c, np.array(T.quant_table(other, t, cfg.layout))) for c, t in zip(coeff, table)]
            there = _rates(aside, coeff, other, cfg, table, slice_of, made)
            slopes.append([(s2 - s) / (b - b2) if b != b2 else 0.0 for (b, s), (b2, s2) in zip(rates, there)])
        return [sum(v) / len(v) for v in zip(*slopes)]
    q = math.log(min(max(cfg.quality, 1), 100))
    if cfg.lambda_mode == "ApproxFast":
        return [math.exp(sum(a * q**p for a, p in zip(T.FAST[cfg.layout][t], (3, 2, 1, 0)))) for t in table]
    area = cfg.width * cfg.height
    lb, lm = math.log(sum(b for b, _ in rates) / area), math.log(max(sum(s for _, s in rates) / area, 0.001))
    return [math.exp(a + b * q + c * lb + d * lm + e * q * lb + f * q * q) / (1 + t) for t in table for a, b, c, d, e, f in [T.EXACT[cfg.layout][t]]]


def encode_frame(planes: list[np.ndarray], cfg: Config) -> bytes:
    return encode_frames([planes], cfg)[0]


def encode_frames(frames: list[list[np.ndarray]], cfg: Config) -> list[bytes]:
    """Streams of frames with equally many planes. Each has its own lambdas and tables; their blocks are transformed and optimised together."""
    n = len(frames[0])
    h, v = cfg.sampling
    cols, rows = -(-cfg.width // (8 * h)), -(-cfg.height // (8 * v))
    mcus = rows * cols
    restart = cols if cfg.restart < 0 else cfg.restart
    shape = [(h, v), *[(1, 1)] * (n - 1)]
    quant = [T.quant_table(cfg.quality, c, cfg.layout) for c in range(min(2, n))]
    table = [0, 1, 1][:n]
    # by component: a row of blocks per frame
    px = [np.stack([_blocks(f[c], rows, cols, *s) for f in frames]) for c, s in enumerate(shape)]
    coeff = [K.forward_dct(p).reshape(p.shape) for p in px]
    zz = [K.quantise(c.reshape(-1, 64), np.array(quant[t])).reshape(c.shape) for c, t in zip(coeff, table)]
    codes = [{k: T.standard(*k) for t in set(table) for k in (("DC", t), ("AC", t))} for _ in frames]
    slice_of = [np.repeat(np.arange(mcus) // (restart or mcus), s[0] * s[1]) for s in shape]
    for _ in range(cfg.picture_passes):
        made = [{k: T.canonical(*c) for k, c in own.items()} for own in codes]
        if cfg.optimise_coefficients:
            lam = [_lambdas([z[f] for z in zz], [c[f] for c in coeff], cfg, table, slice_of, m) for f, m in enumerate(made)]
            for i, t in enumerate(table):
                of = np.repeat(np.arange(len(frames)), zz[i].shape[1])
                lengths = np.stack([code_lengths(m["AC", t]) for m in made])
                flat = [x.reshape(-1, 64) for x in (zz[i], coeff[i], px[i])]
                zz[i] = K.rdoq(flat[0], flat[1], flat[2] if cfg.exact_distortion else None, np.array(quant[t]), np.array([own[i] for own in lam])[of], lengths, cfg.process_zeros, cfg.block_passes, of).reshape(zz[i].shape)
        if cfg.optimise_tables:
            for f, own in enumerate(codes):
                for t in set(table):
                    both = [_symbol_counts(z[f], s) for z, s, t_ in zip(zz, slice_of, table) if t_ == t]
                    for i, kind in enumerate(("DC", "AC")):
                        total: dict[int, int] = {}
                        for x in both:
                            for s, m in x[i].items():
                                total[s] = total.get(s, 0) + m
                        own[kind, t] = K.optimal_lengths(total)
    per = [s[0] * s[1] for s in shape]
    cmps, step, out = [c for c, m in enumerate(per) for _ in range(m)], restart or mcus, []
    for f, own in enumerate(codes):
        made_f = {k: T.canonical(*c) for k, c in own.items()}
        order = np.concatenate([z[f].reshape(mcus, m, 64) for z, m in zip(zz, per)], axis=1)
        pairs = [(made_f["DC", t], made_f["AC", t]) for t in table]
        slices = [K.pack(part.reshape(-1, 64), cmps * len(part), pairs)[0] for part in (order[i : i + step] for i in range(0, mcus, step))]
        out.append(jfif.assemble(jfif.headers(cfg.width, cfg.height, cfg.chroma, quant, [(*k, *own[k]) for k in sorted(own, key=lambda k: (k[1], k[0] == "AC"))], restart), slices))
    return out


def decode_frame(data: bytes, most: int = 255) -> tuple[int, int, list[np.ndarray]]:
    head = jfif.parse(data)
    hs, vs = max(c[1] for c in head["cmps"]), max(c[2] for c in head["cmps"])
    width, height = head["width"], head["height"]
    cols, rows = -(-width // (8 * hs)), -(-height // (8 * vs))
    per = [c[1] * c[2] for c in head["cmps"]]
    cmps = [c for c, n in enumerate(per) for _ in range(n)]
    tables = [(head["codes"]["DC", head["scan"][c[0]][0]], head["codes"]["AC", head["scan"][c[0]][1]]) for c in head["cmps"]]
    left, parts = rows * cols, []
    for s in jfif.slices(head["data"]):
        n = min(left, head["restart"] or left)
        parts.append(K.unpack(s, cmps * n, tables).reshape(n, len(cmps), 64))
        left -= n
    mcus, planes, at = np.concatenate(parts), [], 0
    for (_, h, v, q), n in zip(head["cmps"], per):
        px = K.inverse_dct(K.dequantise(mcus[:, at : at + n].reshape(-1, 64), np.array(head["quant"][q])), most)
        planes.append(_plane(px, rows, cols, h, v, -(-height * v // vs), -(-width * h // hs)))
        at += n
    return width, height, planes


def _groups(batches: Iterator[pa.RecordBatch], cfg: Config, most: int = 1 << 17) -> Iterator[tuple[pa.Array, list[list[np.ndarray]]]]:
    """Numbers and planes of successive frames: of `most` samples together at most, or one frame. Frames of a group have equally many planes."""
    h, v = cfg.sampling
    shape = [(cfg.height, cfg.width), *[(-(-cfg.height // v), -(-cfg.width // h))] * 2]
    step = max(1, most // (cfg.height * cfg.width))
    for batch in batches:
        counts = batch.column("planes").value_lengths().to_pylist()
        at = 0
        while at < batch.num_rows:
            n = next((i for i in range(at, min(at + step, batch.num_rows)) if counts[i] != counts[at]), min(at + step, batch.num_rows)) - at
            part = batch.column("planes").slice(at, n)
            frames = [[p.values.to_numpy().astype(np.int64).reshape(s) for p, s in zip(planes.values, shape)] for planes in part]
            yield batch.column("frame").slice(at, n), frames
            at += n


def encode(frames: DataFrame, cfg: Config) -> DataFrame:
    """frames: frame, planes (arrays of samples: luma and, if not 4:0:0, two chroma planes of their size). Adds jpeg."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, planes in _groups(batches, cfg):
            yield pa.RecordBatch.from_arrays([frame, pa.array(encode_frames(planes, cfg), pa.binary())], names=["frame", "jpeg"])

    return frames.select("frame", "planes").mapInArrow(run, "frame int, jpeg binary")


def decode(streams: DataFrame) -> DataFrame:
    """streams: frame, jpeg. frame, width, height, px (all planes, one after another)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, data in zip(batch.column("frame").to_pylist(), batch.column("jpeg").to_pylist()):
                w, h, planes = decode_frame(data)
                px = np.concatenate([p.reshape(-1) for p in planes]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([frame], pa.int32()), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([px], pa.list_(pa.int32()))], names=["frame", "width", "height", "px"])

    return streams.select("frame", "jpeg").mapInArrow(run, "frame int, width int, height int, px array<int>")


def evaluate(frames: DataFrame, decoded: DataFrame) -> DataFrame:
    """frame, ssd, psnr of all samples."""
    both = frames.select("frame", F.flatten("planes").alias("a")).join(decoded.select("frame", F.col("px").alias("b")), "frame")
    rows = both.select("frame", F.explode(F.zip_with("a", "b", lambda a, b: (b - a).cast("bigint"))).alias("d"))
    return psnr(rows)


def exact_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, mean, n: means that don't depend on the order of rows: sums are of decimals with 18 places, in partial sums by task."""
    total = F.sum(F.col(value).cast("decimal(38,18)")).cast("double")
    return df.groupBy(key).agg(F.round(total / F.count(value), 6).alias("mean"), F.count(value).alias("n"))


def join_chunks(slices: DataFrame) -> DataFrame:
    """slices: frame, slice, nbits, data (stuffed bytes). frame, nbits, bits: a frame's chunks joined at the bit, in order, as text of 0 and 1."""

    @F.arrow_udf("string")
    def text(data: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array(["".join(f"{b:08b}" for b in K.unstuff(d))[:m] for d, m in zip(data.to_pylist(), n.to_pylist())], pa.string())

    chunks = slices.select("frame", "slice", "nbits", text("data", "nbits").alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "s"))), lambda x: x["s"]), "")
    return chunks.groupBy("frame").agg(F.sum("nbits").alias("nbits"), joined.alias("bits"))


def by_frame(order: str):
    return Window.partitionBy("frame").orderBy(order)


def segments(streams: DataFrame) -> DataFrame:
    """streams: frame, jpeg. A row per segment before the data (i, marker, length, payload: hex text) and per restart marker in it (length 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, data in zip(batch.column("frame").to_pylist(), batch.column("jpeg").to_pylist()):
                found = jfif.walk(data)
                yield pa.RecordBatch.from_arrays([pa.array([frame] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array([f"{m:02X}" for m, _ in found]), pa.array([0 if p is None else len(p) + 2 for _, p in found], pa.int32()), pa.array([None if p is None else p.hex().upper() for _, p in found])], names=["frame", "i", "marker", "length", "payload"])

    return streams.select("frame", "jpeg").mapInArrow(run, "frame int, i int, marker string, length int, payload string")


def headers_of(streams: DataFrame) -> DataFrame:
    """streams: frame, jpeg. What the header parser finds: frame, width, height, components, restart, quant_sum (of table 0), codes (symbols of all tables)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [jfif.parse(d) for d in batch.column("jpeg").to_pylist()]
            cols = [[h["width"] for h in heads], [h["height"] for h in heads], [len(h["cmps"]) for h in heads], [h["restart"] for h in heads], [sum(h["quant"][0]) for h in heads], [sum(map(len, h["codes"].values())) for h in heads]]
            yield pa.RecordBatch.from_arrays([batch.column("frame"), *[pa.array(c, pa.int32()) for c in cols]], names=["frame", "width", "height", "components", "restart", "quant_sum", "codes"])

    return streams.select("frame", "jpeg").mapInArrow(run, "frame int, width int, height int, components int, restart int, quant_sum int, codes int")


def replaced(cfg: Config, **changes) -> Config:
    return replace(cfg, **changes)


def compare(frames: DataFrame, a: Config, b: Config) -> DataFrame:
    """frame, and for both configurations the bytes and the squared error of the decoded samples. A task encodes, decodes and compares its frames, so each is coded once."""
    if (a.width, a.height, a.chroma) != (b.width, b.height, b.chroma):
        raise ValueError("both configurations need frames of one size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame, planes in _groups(batches, a):
            out = [frame]
            for cfg in (a, b):
                streams = encode_frames(planes, cfg)
                ssd = [sum(int(((x - y) ** 2).sum()) for x, y in zip(p, decode_frame(d)[2])) for p, d in zip(planes, streams)]
                out += [pa.array(map(len, streams), pa.int32()), pa.array(ssd, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["frame", "bytes_a", "ssd_a", "bytes_b", "ssd_b"])

    return frames.select("frame", "planes").mapInArrow(run, "frame int, bytes_a int, ssd_a bigint, bytes_b int, ssd_b bigint")
