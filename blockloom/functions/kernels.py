"""Block arithmetic over numpy arrays (a row per block), and its Arrow-batched column functions."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import BASIS, BASIS13, EXACT_BASIS, ZIGZAG

SCAN = np.array(ZIGZAG)
UNSCAN = np.argsort(SCAN)


def forward_dct(px: np.ndarray) -> np.ndarray:
    s = px.reshape(-1, 8, 8).astype(np.int64)
    t = (s @ BASIS.T + (1 << 11)) >> 12
    out = ((BASIS @ t + (1 << 14)) >> 15).reshape(-1, 64)
    out[:, 0] -= 16384  # level shift
    return out


def inverse_dct(coeff: np.ndarray, most: int = 65535) -> np.ndarray:
    c = coeff.reshape(-1, 64).astype(np.int64).copy()
    c[:, 0] += 1024
    t = (BASIS.T @ c.reshape(-1, 8, 8) + (1 << 12)) >> 13
    return np.clip((t @ BASIS + (1 << 17)) >> 18, 0, most).reshape(-1, 64)


def _halves(basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The left halves of the even and of the odd frequencies; the right halves mirror them, the odd ones negated."""
    return basis[::2, :4], basis[1::2, :4]


def _folded(s: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Transforms the last axis with half of the products: sums of mirrored samples give even frequencies, differences odd ones."""
    even, odd = _halves(basis)
    a, b = s[..., :4], s[..., :3:-1]
    out = np.empty(s.shape, np.result_type(s, basis))
    out[..., ::2], out[..., 1::2] = (a + b) @ even.T, (a - b) @ odd.T
    return out


def _unfolded(c: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The inverse along the last axis."""
    even, odd = _halves(basis)
    e, o = c[..., ::2] @ even, c[..., 1::2] @ odd
    return np.concatenate([e + o, (e - o)[..., ::-1]], axis=-1)


def _round(v: np.ndarray) -> np.ndarray:
    """Half away from zero."""
    return np.trunc(v + np.copysign(0.5, v)).astype(np.int64)


#: Forms of the transform besides the 14-bit matrix: they differ from it by 2 at most, backward by 1.
FORMS = ("float", "float_folded", "int13_folded")


def forward_dct_as(form: str, px: np.ndarray) -> np.ndarray:
    s = px.reshape(-1, 8, 8).astype(np.int64)
    turn = lambda v: v.transpose(0, 2, 1)
    if form == "int13_folded":
        t = (_folded(s, BASIS13) + (1 << 10)) >> 11
        out = turn((_folded(turn(t), BASIS13) + (1 << 13)) >> 14)
    elif form == "float_folded":
        out = _round(turn(_folded(turn(_folded(s.astype(np.float64), EXACT_BASIS)), EXACT_BASIS)) * 2)
    else:
        out = _round(EXACT_BASIS @ (s @ EXACT_BASIS.T) * 2)
    out = out.reshape(-1, 64).copy()
    out[:, 0] -= 16384  # level shift
    return out


def inverse_dct_as(form: str, coeff: np.ndarray, most: int = 65535) -> np.ndarray:
    c = coeff.reshape(-1, 64).astype(np.int64).copy()
    c[:, 0] += 1024
    c, turn = c.reshape(-1, 8, 8), lambda v: v.transpose(0, 2, 1)
    if form == "int13_folded":
        t = (turn(_unfolded(turn(c), BASIS13)) + (1 << 10)) >> 11
        out = (_unfolded(t, BASIS13) + (1 << 17)) >> 18
    elif form == "float_folded":
        out = _round(_unfolded(turn(_unfolded(turn(c).astype(np.float64), EXACT_BASIS)), EXACT_BASIS) / 8)
    else:
        out = _round(EXACT_BASIS.T @ c @ EXACT_BASIS / 8)
    return np.clip(out, 0, most).reshape(-1, 64)


def quantise(coeff: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Raster coefficients to scan order, divided by 16 q and rounded half away from zero."""
    c, d = coeff[:, SCAN], 16 * np.asarray(q, np.int64)
    return np.sign(c) * ((2 * np.abs(c) + d) // (2 * d))


def dequantise(zz: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (zz * np.asarray(q, np.int64))[:, UNSCAN]


def category(v: np.ndarray) -> np.ndarray:
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def _run_costs(lengths: np.ndarray) -> np.ndarray:
    """Bits of a level of each category (16) after each run of zeros (64), with its 16-zero symbols: a row of 1,024 per table of lengths."""
    run, n = np.arange(64)[:, None], np.arange(16)
    return (lengths[:, (run % 16) * 16 + n] + n + (run // 16) * lengths[:, 0xF0, None, None]).reshape(len(lengths), -1)


def ac_bits(zz: np.ndarray, lengths: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Bits of all AC symbols of each block; a symbol without a code counts 16. lengths: 256 a table; table: each block's row of them, if there are many."""
    lengths = lengths.reshape(-1, 256)
    row = np.zeros(len(zz), np.int64) if table is None else table
    on = zz != 0
    on[:, 0] = False
    at = np.where(on, np.arange(64), 0)
    last = at.max(axis=1, initial=0)
    before = np.maximum.accumulate(np.c_[np.zeros((len(zz), 1), np.int64), at[:, :-1]], axis=1)
    block, k = np.nonzero(on)
    each = _run_costs(lengths).reshape(-1)[row[block] * 1024 + (k - before[block, k] - 1) * 16 + category(zz[block, k])]
    cost = np.zeros(len(zz), np.int64)
    np.add.at(cost, block, each)
    return cost + np.where(last < 63, lengths[row, 0], 0)


def coefficient_ssd(zz: np.ndarray, coeff: np.ndarray, q: np.ndarray) -> np.ndarray:
    return ((((dequantise(zz, q) << 4) - coeff) ** 2).sum(axis=1) + 128) >> 8


def rdoq(zz: np.ndarray, coeff: np.ndarray, px: np.ndarray | None, q: np.ndarray, lam: np.ndarray, lengths: np.ndarray, zeros: bool = False, passes: int = 1, table: np.ndarray | None = None) -> np.ndarray:
    """Rate-distortion optimised levels: from the last non-zero to the first AC one, each tries 0, +1 and -1 and takes what costs strictly less. px: exact distortion, else that of coefficients. lengths, table: as in ac_bits()."""
    lengths, out = lengths.reshape(-1, 256), zz.copy()
    row = np.zeros(len(zz), np.int64) if table is None else table
    for at in range(0, len(zz), 1024):  # what is kept of these blocks stays in a core's cache
        s = slice(at, at + 1024)
        out[s] = _rdoq(zz[s], coeff[s], None if px is None else px[s], np.asarray(q, np.int64), lam[s], lengths, zeros, passes, row[s])
    return out


class _Samples:
    """Exact distortion: both sums of the inverse transform before their shifts, blocks last. A changed coefficient adds a multiple of one basis row to one column of the first and what follows from it to the second, so trials have the same integers as inverse_dct()."""

    def __init__(self, zz: np.ndarray, px: np.ndarray, q: np.ndarray, room: int):
        c = dequantise(zz, q)
        c[:, 0] += 1024
        # 32 bits if no sum can pass them, whatever levels are tried
        most = (np.abs(c).sum(axis=1).max(initial=0) + room * int(q.sum())) * 22725 // 8192 * 22725 + 64 * 22725
        kind = np.int32 if most < 2**30 and np.abs(px).max(initial=0) < 8192 else np.int64
        first = BASIS.T @ c.reshape(-1, 8, 8) + (1 << 12)
        self.basis, self.q = BASIS.astype(kind), q
        self.first = np.ascontiguousarray(first.transpose(1, 2, 0).astype(kind))
        self.second = np.ascontiguousarray(((first >> 13) @ BASIS + (1 << 17)).transpose(1, 2, 0).astype(kind))
        self.px = np.ascontiguousarray(px.T.reshape(8, 8, -1).astype(kind))

    def _of(self, second: np.ndarray, px: np.ndarray) -> np.ndarray:
        d = second >> 18
        np.clip(d, 0, 65535, out=d)
        d -= px
        d *= d
        return d.reshape(64, -1).sum(axis=0, dtype=np.int64)

    def all(self) -> np.ndarray:
        return self._of(self.second, self.px)

    def at(self, k: int, own: np.ndarray) -> None:
        """Trials are of level k of these blocks."""
        self.u, self.v = divmod(int(SCAN[k]), 8)
        self.step = int(self.q[k])
        self.column = self.first[:, self.v].take(own, axis=1)
        self.seconds, self.pxs = self.second.take(own, axis=2), self.px.take(own, axis=2)

    def _moved(self, change: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The column after the change, and what it adds to the second sums."""
        new = column + self.basis[self.u][:, None] * (change * self.step).astype(column.dtype)
        return new, ((new >> 13) - (column >> 13))[:, None] * self.basis[self.v][:, None]

    def trial(self, change: np.ndarray) -> np.ndarray:
        add = self._moved(change, self.column)[1]
        add += self.seconds
        return self._of(add, self.pxs)

    def take(self, own: np.ndarray, change: np.ndarray) -> None:
        i = np.flatnonzero(change)
        new, add = self._moved(change[i], self.column[:, i])
        self.first[:, self.v, own[i]] = new
        self.second[:, :, own[i]] += add


class _Coefficients:
    """Distortion of coefficients: the sum before its rounding, of which a changed level replaces one term."""

    def __init__(self, zz: np.ndarray, coeff: np.ndarray, q: np.ndarray):
        self.zz, self.q, self.coeff = zz.copy(), q, coeff[:, SCAN]
        self.sum = ((((zz * q) << 4) - self.coeff) ** 2).sum(axis=1)

    def all(self) -> np.ndarray:
        return (self.sum + 128) >> 8

    def at(self, k: int, own: np.ndarray) -> None:
        self.k, self.was, self.sums, self.c = k, self.zz[own, k], self.sum[own], self.coeff[own, k]
        self.sums = self.sums - self._term(0)

    def _term(self, change: np.ndarray | int) -> np.ndarray:
        return ((((self.was + change) * self.q[self.k]) << 4) - self.c) ** 2

    def trial(self, change: np.ndarray) -> np.ndarray:
        return (self.sums + self._term(change) + 128) >> 8

    def take(self, own: np.ndarray, change: np.ndarray) -> None:
        self.sum[own] = self.sums + self._term(change)
        self.zz[own, self.k] += change


def _rdoq(zz: np.ndarray, coeff: np.ndarray, px: np.ndarray | None, q: np.ndarray, lam: np.ndarray, lengths: np.ndarray, zeros: bool, passes: int, row: np.ndarray) -> np.ndarray:
    """rdoq() of some blocks. A trial's distortion and bits follow from what it changes: one coefficient, and the symbols from the non-zero level before it to the one after it."""
    out, every = zz.copy(), np.arange(len(zz))
    last = np.where(zz[:, 1:] != 0, np.arange(1, 64), 0).max(axis=1, initial=0)
    dist = _Coefficients(zz, coeff, q) if px is None else _Samples(zz, px, q, passes)
    costs, base, end = _run_costs(lengths).reshape(-1), row * 1024, lengths[row, 0]
    kinds = category(np.arange(np.abs(zz).max(initial=0) + passes + 1))
    bits = ac_bits(zz, lengths, row)
    best = dist.all() + lam * bits
    for _ in range(passes):
        places = np.where(out != 0, np.arange(64), 0)
        places[:, 0] = 0
        before = np.maximum.accumulate(places, axis=1)
        following, n_following = np.full(len(zz), 64), np.zeros(len(zz), np.int64)  # the next non-zero level's place and category
        for k in range(63, 0, -1):
            own = np.flatnonzero((last >= k) & (zeros | (out[:, k] != 0)))
            if len(own):
                was, prev, nxt, b = out[own, k], before[own, k - 1], following[own], base[own]
                more, own_lam, own_best, own_bits = nxt < 64, lam[own], best[own], bits[own]
                after = b + n_following[own]
                gap = np.where(more, costs[after + np.minimum(nxt - k - 1, 63) * 16], end[own] if k < 63 else 0)
                gone = np.where(more, costs[after + np.minimum(nxt - prev - 1, 63) * 16], end[own])
                run = b + (k - prev - 1) * 16
                of = lambda v: np.where(v != 0, costs[run + kinds[np.abs(v)]] + gap, gone)  # noqa: B023, E731
                rest = own_bits - of(was)
                change, now = np.zeros_like(was), own_bits
                dist.at(k, own)
                for value, tried in ((0 * was, was != 0), (was + 1, was != -1), (was - 1, was != 1)):
                    n = rest + of(value)
                    c = dist.trial(value - was) + own_lam * n
                    less = tried & (c < own_best)
                    own_best, change, now = np.where(less, c, own_best), np.where(less, value - was, change), np.where(less, n, now)
                if change.any():
                    dist.take(own, change)
                    out[own, k], best[own], bits[own] = was + change, own_best, now
            on = every[out[:, k] != 0]
            following[on], n_following[on] = k, kinds[np.abs(out[on, k])]
    return out


def optimal_lengths(counts: dict[int, int], size: int = 256, limit: int = 16) -> tuple[list[int], list[int]]:
    """Numbers of codes by length, and symbols: a Huffman tree of the counts and one reserved symbol, limited as in T.81 K.2. Ties go by count, then larger symbols first, then order of making."""
    heap = [(n, -s, 0, (s,)) for s, n in counts.items() if n > 0] + [(1, -size, 0, (size,))]
    heapq.heapify(heap)
    depth: dict[int, int] = dict.fromkeys([s for h in heap for s in h[3]], 0 if len(heap) > 1 else 1)
    made = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        made += 1
        for s in a[3] + b[3]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], 1, made, a[3] + b[3]))
    n = [0] * (max(depth.values()) + 2)
    for d in depth.values():
        n[d] += 1
    for i in range(len(n) - 1, limit, -1):
        while n[i] > 0:
            j = i - 2
            while n[j] == 0:
                j -= 1
            n[i] -= 2
            n[i - 1] += 1
            n[j + 1] += 2
            n[j] -= 1
    n = (n + [0] * limit)[: limit + 1]
    n[max(i for i in range(limit + 1) if n[i])] -= 1  # the reserved code
    order = sorted((s for s in depth if s != size), key=lambda s: (depth[s], s))
    return n[1:], order


def bits_of(value: int, n: int) -> str:
    return format(value & ((1 << n) - 1), f"0{n}b") if n else ""


def pack(zz: np.ndarray, cmps: list[int], tables: list[tuple[dict, dict]]) -> tuple[bytes, int]:
    """One slice's entropy-coded bytes (padded with ones, stuffed) and its bits. cmps: each block's component; tables: DC and AC codes by component."""
    out, last = [], [0] * len(tables)
    for block, cmp in zip(zz.tolist(), cmps):
        dc, ac = tables[cmp]
        d, last[cmp] = block[0] - last[cmp], block[0]
        n = abs(d).bit_length()
        out += [bits_of(dc[n][1], dc[n][0]), bits_of(d if d > 0 else d - 1, n)]
        run = 0
        for v in block[1:]:
            if not v:
                run += 1
                continue
            if run > 15:
                out += [bits_of(ac[0xF0][1], ac[0xF0][0])] * (run // 16)
            n = abs(v).bit_length()
            length, code = ac[(run % 16) << 4 | n]
            out += [bits_of(code, length), bits_of(v if v > 0 else v - 1, n)]
            run = 0
        if run:
            out.append(bits_of(ac[0][1], ac[0][0]))
    bits = "".join(out)
    full = bits + "1" * (-len(bits) % 8)
    return stuff(int(full, 2).to_bytes(len(full) // 8, "big") if full else b""), len(bits)


def unpack(data: bytes, cmps: list[int], tables: list[tuple[dict, dict]]) -> np.ndarray:
    """The inverse of pack()."""
    blocks = len(cmps)
    raw = unstuff(data)
    bits = bin(int.from_bytes(b"\1" + raw, "big"))[3:]
    by_code = [tuple({(n, c): s for s, (n, c) in t.items()} for t in pair) for pair in tables]
    at, last, out = 0, [0] * len(tables), np.zeros((blocks, 64), np.int64)

    def symbol(table: dict) -> int:
        nonlocal at
        for n in range(1, 17):
            if (s := table.get((n, int(bits[at : at + n], 2)))) is not None:
                at += n
                return s
        raise ValueError("no such code")

    def number(n: int) -> int:
        nonlocal at
        v = int(bits[at : at + n], 2) if n else 0
        at += n
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    for i, cmp in enumerate(cmps):
        dc, ac = by_code[cmp]
        last[cmp] += number(symbol(dc))
        out[i, 0], k = last[cmp], 1
        while k < 64:
            s = symbol(ac)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                out[i, k] = number(s & 15)
            k += 1
    return out


def stuff(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\0")


def unstuff(data: bytes) -> bytes:
    """Stops at the first real marker."""
    i = 0
    while (i := data.find(b"\xff", i)) >= 0 and data[i + 1 : i + 2] in (b"\0", b""):
        i += 2
    return (data if i < 0 else data[:i]).replace(b"\xff\0", b"\xff")


def _column(fn, column: Column | str) -> Column:
    """fn over rows of 64 integers, as an Arrow function of a list column."""

    @F.arrow_udf("array<int>")
    def run(a: pa.Array) -> pa.Array:
        out = fn(a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.reshape(-1).astype(np.int32)))

    return run(column)


def dct(px: Column | str) -> Column:
    return _column(forward_dct, px)


def idct(coeff: Column | str, most: int = 65535) -> Column:
    return _column(lambda c: inverse_dct(c, most), coeff)


def dct_as(form: str, px: Column | str) -> Column:
    return _column(lambda p: forward_dct_as(form, p), px)


def idct_as(form: str, coeff: Column | str, most: int = 65535) -> Column:
    return _column(lambda c: inverse_dct_as(form, c, most), coeff)


def quant_scan(coeff: Column | str, q: list[int]) -> Column:
    return _column(lambda c: quantise(c.astype(np.int64), np.array(q)), coeff)


def unquant_scan(zz: Column | str, q: list[int]) -> Column:
    return _column(lambda z: dequantise(z.astype(np.int64), np.array(q)), zz)
