"""Fixed tables of baseline block coding: scan order, cosine basis, quantisation and Huffman tables, colour matrices."""

from __future__ import annotations

import math

import numpy as np

# Example quantisation tables of ITU-T T.81, K.1 and K.2, by rows.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
# Huffman tables of ITU-T T.81, K.3: numbers of codes by length 1 to 16, and the symbols of the codes of under 16 bits
# (the 16-bit ones are all other symbols, ascending).
BITS = {
    ("DC", 0): [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0],
    ("AC", 0): [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    ("DC", 1): [0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0],
    ("AC", 1): [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
}
SHORT = {
    ("DC", 0): [*range(12)],
    ("DC", 1): [*range(12)],
    ("AC", 0): [*bytes.fromhex("0102030004110512213141061351610722711432819 1a1082342b1c11552d1f02433627282".replace(" ", ""))],
    ("AC", 1): [*bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1")],
}
#: Luma shares of red and blue: BT.601 (JPEG), BT.709, SMPTE 240M, BT.2020.
SPACES = {"BT601": (0.299, 0.114), "BT709": (0.2126, 0.0722), "SMPTE240M": (0.212, 0.087), "BT2020": (0.2627, 0.0593)}


def zigzag() -> list[int]:
    """Raster index of each scan position: diagonals, upward on even ones."""
    return [y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]


ZIGZAG = zigzag()
#: Cosine basis in 14 bits: rows are frequencies.
EXACT_BASIS = np.array([[1.0 if u == 0 else math.sqrt(2) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
BASIS = np.round(EXACT_BASIS * 16384).astype(np.int64)
#: The same in 13 bits.
BASIS13 = np.round(EXACT_BASIS * 8192).astype(np.int64)


def quant_table(quality: int, cmp: int = 0, layout: str = "Default") -> list[int]:
    """Divisors in scan order. Layouts: Default scales the standard's table, Flat takes its mean, SemiFlat the middle of both."""
    q = min(max(quality, 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    base = CHROMA if cmp else LUMA
    own = [min(max((base[r] * scale + 50) // 100, 1), 255) for r in ZIGZAG]
    mean = (sum(own) + 32) >> 6
    return {"Default": own, "Flat": [mean] * 64, "SemiFlat": [(v + mean + 1) >> 1 for v in own]}[layout]


def canonical(bits: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (length, code). Too many codes of a length are an error."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for s in symbols[at : at + n]:
            if code >> length:
                raise ValueError("the code lengths are over-subscribed")
            out[s] = (length, code)
            code += 1
        at += n
        code <<= 1
    return out


def standard(kind: str, table: int) -> tuple[list[int], list[int]]:
    short = SHORT[kind, table]
    every = range(12) if kind == "DC" else [0, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
    return BITS[kind, table], [*short, *sorted(set(every) - set(short))]


def matrices(space: str, decimals: int | None = None) -> tuple[list[list], list[list]]:
    """Forward and backward colour matrices from the standards' luma shares: integers of 16 bits, or with decimals fractions rounded to them."""
    kr, kb = SPACES[space]
    kg = 1 - kr - kb
    fix = lambda v: round(v * 65536) if decimals is None else round(v, decimals)
    forward = [[kr, kg, kb], [-kr / (2 * (1 - kb)), -kg / (2 * (1 - kb)), 0.5], [0.5, -kg / (2 * (1 - kr)), -kb / (2 * (1 - kr))]]
    backward = [[1, 0, 2 * (1 - kr)], [1, -2 * kb * (1 - kb) / kg, -2 * kr * (1 - kr) / kg], [1, 2 * (1 - kb), 0]]
    return [[fix(v) for v in row] for row in forward], [[fix(v) for v in row] for row in backward]


# Coefficients of the rate-distortion models, by table layout.
FAST = {
    "Default": ((0, -0.312666, 0.080179, 7.530120), (0.462055, -4.42234, 10.86430, 0.837368)),
    "Flat": ((0, -0.889040, 4.250010, 2.699890), (-0.604092, 5.00975, -14.26030, 23.097600)),
    "SemiFlat": ((0, -0.735792, 3.083170, 3.960580), (-0.503516, 4.23209, -13.10200, 23.033500)),
}
EXACT = {
    "Default": ((-1.19987, 1.98030, -2.62476, 0.72908, 0.54911, -0.37379), (3.43417, 0.34002, -3.04510, 0.55147, 0.50961, -0.16052)),
    "Flat": ((2.66954, 0.78743, -1.96582, 0.50298, 0.19647, -0.24829), (3.75927, 3.20834, -0.38154, 0.47452, -0.19072, -0.76296)),
    "SemiFlat": ((1.30210, 1.16094, -2.00048, 0.58254, 0.26535, -0.27819), (1.23927, 2.72368, -2.18054, 0.55767, 0.24089, -0.55437)),
}
