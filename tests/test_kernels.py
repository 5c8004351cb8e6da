import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.functions import jfif
from blockloom.functions import kernels as K
from blockloom.functions import tables as T
from blockloom.plans import codec

RNG = np.random.default_rng(7)
STANDARD = [(T.canonical(*T.standard("DC", 0)), T.canonical(*T.standard("AC", 0)))]


def test_quantiser_rounds_half_away_for_all_inputs():
    c = np.arange(-32768, 32768)
    for q in (1, 2, 3, 7, 16, 99, 255):
        blocks = c.reshape(-1, 64)
        got = K.quantise(blocks, np.full(64, q))[:, K.UNSCAN].reshape(-1)
        exact = np.sign(c) * np.floor(np.abs(c) / (16 * q) + 0.5)
        assert (got == exact).all()


def test_transform_round_trip():
    px = RNG.integers(0, 256, (200, 64))
    ones = np.ones(64, np.int64)
    assert np.abs(K.inverse_dct(K.dequantise(K.quantise(K.forward_dct(px), ones), ones)) - px).max() <= 1


def test_constant_block():
    c = K.forward_dct(np.full((1, 64), 128))
    assert not c.any() and (K.inverse_dct(c) == 128).all()


def test_scan_is_a_permutation():
    assert sorted(T.ZIGZAG) == list(range(64)) and T.ZIGZAG[:6] == [0, 1, 8, 16, 9, 2] and T.ZIGZAG[-1] == 63


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 0, 0, 0, 1, -1, 2, -5, 30, -200, 1000]), min_size=64, max_size=64), min_size=1, max_size=6))
def test_entropy_coding_round_trip_and_estimate(blocks):
    zz = np.array(blocks, np.int64)
    data, n = K.pack(zz, [0] * len(zz), STANDARD)
    assert (K.unpack(data, [0] * len(zz), STANDARD) == zz).all()
    dc, ac = STANDARD[0]
    size = [abs(int(v)).bit_length() for v in np.diff(np.r_[0, zz[:, 0]])]
    assert n == K.ac_bits(zz, codec.code_lengths(ac)).sum() + sum(dc[s][0] + s for s in size)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 1 << 30), min_size=1, max_size=256))
def test_designed_lengths_fit(counts):
    bits, symbols = K.optimal_lengths(counts)
    assert len(bits) == 16 and sum(bits) == len(symbols) == len(counts)
    T.canonical(bits, symbols)
    assert sum(n / 2 ** (i + 1) for i, n in enumerate(bits)) < 1  # the code of ones only stays free


@given(st.binary(max_size=300))
def test_stuffing(data):
    assert K.unstuff(K.stuff(data)) == data and K.unstuff(K.stuff(data) + b"\xff\xd0x") == data


def test_markers():
    data = b"!!\xff\xd8!!\xff\0!\xff\xff\xda!\xff"
    assert jfif.markers(data) == [(2, 0xD8), (10, 0xDA)]
    assert jfif.find_marker(b"abc") == -1 and jfif.find_marker(b"ab\xff") == -2


def test_oversubscribed_codes_are_an_error():
    with pytest.raises(ValueError):
        T.canonical([3] + [0] * 15, [1, 2, 3])


@pytest.mark.parametrize("chroma", [400, 420, 422, 444])
@pytest.mark.parametrize("restart", [0, 2, -1])
def test_frames_round_trip(chroma, restart):
    w, h = 37, 21
    y, x = np.mgrid[:h, :w]
    s = jfif.SAMPLING[chroma]
    planes = [(4 * x + 3 * y) % 256] + ([] if chroma == 400 else [np.full((-(-h // s[1]), -(-w // s[0])), v) for v in (90, 160)])
    cfg = codec.Config(w, h, chroma, quality=95, restart=restart)
    data = codec.encode_frame(planes, cfg)
    width, height, back = codec.decode_frame(data)
    assert (width, height) == (w, h) and data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9" and b"JFIF" in data[:12]
    for a, b in zip(planes, back):
        assert a.shape == b.shape
    assert np.abs(back[0] - planes[0])[:, :32].mean() < 12
    for a, b in zip(planes[1:], back[1:]):
        assert np.abs(a - b)[: a.shape[0] // 8 * 8, : a.shape[1] // 8 * 8].max(initial=0) <= 2


def test_optimised_streams_are_smaller():
    y, x = np.mgrid[:64, :64]
    plane = ((x * y) // 7 + RNG.integers(0, 20, (64, 64))) % 256
    simple = codec.encode_frame([plane], codec.Config(64, 64))
    tables = codec.encode_frame([plane], codec.Config(64, 64, optimise_tables=True))
    both = codec.encode_frame([plane], codec.Config(64, 64, optimise_tables=True, optimise_coefficients=True, picture_passes=2))
    assert len(both) <= len(tables) < len(simple)
    assert codec.decode_frame(both)[2][0].shape == (64, 64)
    assert (codec.decode_frame(tables)[2][0] == codec.decode_frame(simple)[2][0]).all()


def test_config():
    cfg = codec.Config.read("Width = 16 # comment\n[codec]\nquality = '80'\noptimise_tables=1\n", height=8)
    assert (cfg.width, cfg.height, cfg.quality, cfg.optimise_tables) == (16, 8, 80, True)
    with pytest.raises(ValueError):
        codec.Config(8, 8, quality=101)


@pytest.mark.parametrize("form", K.FORMS)
def test_forms_of_the_transform_agree(form):
    rng = np.random.default_rng(3)
    px = np.concatenate([rng.integers(0, 256, (500, 64)), np.zeros((1, 64), int), np.full((1, 64), 255)])
    assert np.abs(K.forward_dct_as(form, px) - K.forward_dct(px)).max() <= 2
    c = K.dequantise(K.quantise(K.forward_dct(px), np.full(64, 5)), np.full(64, 5))
    assert np.abs(K.inverse_dct_as(form, c) - K.inverse_dct(c)).max() <= 1


def test_exhaustive_lambda_saves_bits():
    rng = np.random.default_rng(4)
    plane = np.clip(np.add.outer(np.arange(64), 2 * np.arange(64)) + rng.integers(-20, 20, (64, 64)), 0, 255)
    for quality in (1, 60, 100):
        plain = codec.encode_frame([plane], codec.Config(64, 64, quality=quality))
        less = codec.encode_frame([plane], codec.Config(64, 64, quality=quality, optimise_coefficients=True, lambda_mode="Exhaustive"))
        assert len(less) <= len(plain)
        assert codec.decode_frame(less)[2][0].shape == plane.shape
    with pytest.raises(ValueError):
        codec.Config(8, 8, lambda_mode="none")
