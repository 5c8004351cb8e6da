"""Optimisation that follows changes against its plain form, and frames coded together against each alone."""

import numpy as np
import pytest

from blockloom.functions import kernels as K
from blockloom.functions import tables as T
from blockloom.plans import codec

SCHEMA = "frame int, planes array<array<int>>"


def plain_bits(block, lengths):
    bits, run = 0, 0
    for v in block[1:]:
        if not v:
            run += 1
            continue
        n = int(abs(v)).bit_length()
        bits += lengths[(run % 16) * 16 + n] + n + (run // 16) * lengths[0xF0]
        run = 0
    return bits + (lengths[0] if run else 0)


def plain_rdoq(zz, coeff, px, q, lam, lengths, zeros, passes):
    """A block: every trial is transformed and counted anew."""

    def cost(z):
        dist = ((K.inverse_dct(K.dequantise(z[None], q)) - px) ** 2).sum() if px is not None else K.coefficient_ssd(z[None], coeff[None], q)[0]
        return dist + lam * plain_bits(z, lengths)

    out, best = zz.copy(), cost(zz)
    last = max([k for k in range(1, 64) if zz[k]], default=0)
    for _ in range(passes):
        for k in range(last, 0, -1):
            was = out[k]
            if not (zeros or was):
                continue
            take = was
            for value in (0, was + 1, was - 1):
                if value == was:
                    continue
                trial = out.copy()
                trial[k] = value
                if (c := cost(trial)) < best:
                    best, take = c, value
            out[k] = take
    return out


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("zeros, passes", [(False, 1), (False, 2), (True, 2)])
def test_optimisation_is_the_plain_one(exact, zeros, passes):
    rng = np.random.default_rng(11)
    smooth = np.add.outer(np.arange(8) * 9, np.arange(8) * 5).reshape(-1)
    px = np.concatenate([rng.integers(0, 256, (4, 64)), rng.integers(0, 2, (3, 64)) * 255, smooth + rng.integers(0, 30, (3, 64)), np.full((1, 64), 255)])
    tables = np.stack([codec.code_lengths(T.canonical(*T.standard("AC", t))) for t in (0, 1)])
    for quality in (1, 50, 95):
        q = np.array(T.quant_table(quality))
        coeff = K.forward_dct(px)
        zz, lam, of = K.quantise(coeff, q), rng.choice([0.0, 7.0, 90.0, 2000.0], len(px)), rng.integers(0, 2, len(px))
        got = K.rdoq(zz, coeff, px if exact else None, q, lam, tables, zeros, passes, of)
        for i, z in enumerate(zz):
            assert (got[i] == plain_rdoq(z, coeff[i], px[i] if exact else None, q, lam[i], tables[of[i]], zeros, passes)).all()


def test_optimisation_of_wide_sums():
    """Sums beyond 32 bits, and samples whose squares are."""
    rng = np.random.default_rng(12)
    px, q = rng.integers(0, 2, (2, 64)) * 60000, np.full(64, 255)
    coeff = K.forward_dct(px)
    zz, lengths = K.quantise(coeff, q), codec.code_lengths(T.canonical(*T.standard("AC", 0)))
    got = K.rdoq(zz, coeff, px, q, np.full(2, 1e5), lengths)
    for i in range(2):
        assert (got[i] == plain_rdoq(zz[i], coeff[i], px[i], q, 1e5, lengths, False, 1)).all()


def test_trials_are_not_transformed_anew(monkeypatch):
    """Before, each of a block's up to 189 trials a pass went through the whole inverse transform."""
    calls, whole = [], K.inverse_dct
    monkeypatch.setattr(K, "inverse_dct", lambda *a: calls.append(1) or whole(*a))
    px = np.random.default_rng(13).integers(0, 256, (20, 64))
    q, coeff = np.array(T.quant_table(50)), K.forward_dct(px)
    K.rdoq(K.quantise(coeff, q), coeff, px, q, np.full(20, 50.0), codec.code_lengths(T.canonical(*T.standard("AC", 0))))
    assert len(calls) <= 1


@pytest.mark.parametrize("chroma", [400, 420, 444])
def test_frames_together_are_frames_alone(chroma):
    rng = np.random.default_rng(14)
    (h, v), size = codec.jfif.SAMPLING[chroma], (21, 37)
    shapes = [size] + ([(-(-21 // v), -(-37 // h))] * 2 if chroma != 400 else [])
    frames = [[rng.integers(0, 40 * (i + 1), s) for s in shapes] for i in range(4)]
    cfg = codec.Config(37, 21, chroma, quality=50, restart=2, optimise_coefficients=True, optimise_tables=True, picture_passes=2, block_passes=2)
    assert codec.encode_frames(frames, cfg) == [codec.encode_frames([f], cfg)[0] for f in frames]


def test_comparison_codes_each_frame_once(spark):
    rng = np.random.default_rng(15)
    rows = [(i, [rng.integers(0, 256, 24 * 16).tolist()]) for i in range(3)]
    frames = spark.createDataFrame(rows, SCHEMA)
    a = codec.Config(24, 16, quality=60, optimise_coefficients=True)
    b = codec.replaced(a, block_passes=2, optimise_tables=True)
    got = codec.compare(frames, a, b)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    expected = []
    for i, planes in rows:
        own = [i]
        for cfg in (a, b):
            plane = np.array(planes[0]).reshape(16, 24)
            data = codec.encode_frame([plane], cfg)
            own += [len(data), int(((codec.decode_frame(data)[2][0] - plane) ** 2).sum())]
        expected.append(tuple(own))
    assert sorted(map(tuple, got.select("frame", "bytes_a", "ssd_a", "bytes_b", "ssd_b").collect())) == expected
