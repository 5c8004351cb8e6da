"""JFIF streams: markers, segments, frame assembly and parsing."""

from __future__ import annotations

import struct

from .tables import canonical, standard

SOI, EOI, SOF, DHT, DQT, DRI, SOS, APP0, RST = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xE0, 0xD0
SAMPLING = {400: (1, 1), 444: (1, 1), 422: (2, 1), 420: (2, 2)}


def segment(marker: int, payload: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(payload) + 2) + payload


def headers(width: int, height: int, chroma: int, quant: list[list[int]], codes: list[tuple[str, int, list[int], list[int]]], restart: int) -> bytes:
    """All that stands before the entropy-coded data. codes: class, table, numbers by length, symbols."""
    cmps = [0] if chroma == 400 else [0, 1, 1]
    h, v = SAMPLING[chroma]
    out = [b"\xff\xd8", segment(APP0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [segment(DQT, bytes([i, *q])) for i, q in enumerate(quant)]
    out += [segment(DRI, struct.pack(">H", restart))] if restart else []
    out.append(segment(SOF, struct.pack(">BHHB", 8, height, width, len(cmps)) + b"".join(bytes([i + 1, (h << 4 | v) if i == 0 else 0x11, t]) for i, t in enumerate(cmps))))
    out += [segment(DHT, bytes([(kind == "AC") << 4 | t, *bits, *symbols])) for kind, t, bits, symbols in codes]
    out.append(segment(SOS, bytes([len(cmps)]) + b"".join(bytes([i + 1, t << 4 | t]) for i, t in enumerate(cmps)) + b"\0\x3f\0"))
    return b"".join(out)


def assemble(head: bytes, slices: list[bytes]) -> bytes:
    return head + b"".join((bytes([0xFF, RST + (i - 1) % 8]) if i else b"") + s for i, s in enumerate(slices)) + b"\xff\xd9"


def find_marker(data: bytes, start: int = 0) -> int:
    """Offset of the next marker; -1: none, -2: the last byte may begin one."""
    i = start
    while (i := data.find(b"\xff", i)) >= 0:
        if i + 1 == len(data):
            return -2
        if data[i + 1] not in (0, 0xFF):
            return i
        i += 1
    return -1


def markers(data: bytes) -> list[tuple[int, int]]:
    """Absolute offsets of all markers, with their bytes."""
    out, at = [], 0
    while (at := find_marker(data, at)) >= 0:
        out.append((at, data[at + 1]))
        at += 2
    return out


def parse(data: bytes) -> dict:
    """Headers in any order up to the scan, walked by segment; tables that are missing are the standard's. Unknown markers are errors."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("the stream doesn't begin with SOI")
    out: dict = {"quant": {}, "codes": {k: canonical(*standard(*k)) for k in (("DC", 0), ("AC", 0), ("DC", 1), ("AC", 1))}, "restart": 0}
    at = 2
    while True:
        mark, marker, size = struct.unpack_from(">BBH", data, at)
        body = data[at + 4 : at + 2 + size]
        if mark != 0xFF:
            raise ValueError("a segment doesn't begin with a marker")
        if marker == DQT:
            while body:
                wide = 1 + (body[0] >> 4)
                out["quant"][body[0] & 15] = [int.from_bytes(body[1 + i * wide : 1 + (i + 1) * wide], "big") for i in range(64)]
                body = body[1 + 64 * wide :]
        elif marker == DHT:
            while body:
                bits = [*body[1:17]]
                out["codes"]["AC" if body[0] >> 4 else "DC", body[0] & 15] = canonical(bits, [*body[17 : 17 + sum(bits)]])
                body = body[17 + sum(bits) :]
        elif marker == DRI:
            out["restart"] = struct.unpack(">H", body)[0]
        elif marker == SOF:
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["cmps"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == SOS:
            out["scan"] = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            out["data"] = data[at + 2 + size :]
            if "cmps" not in out or not out["quant"]:
                raise ValueError("the stream has no SOF or DQT")
            return out
        elif not APP0 <= marker <= 0xEF and marker != 0xFE:
            raise ValueError(f"unknown marker {marker:#x}")
        at += 2 + size


def slices(data: bytes) -> list[bytes]:
    """Entropy-coded data cut at restart markers, up to the end marker."""
    out, start, at = [], 0, 0
    while (at := find_marker(data, at)) >= 0:
        out.append(data[start:at])
        if not RST <= data[at + 1] <= RST + 7:
            return out
        start = at = at + 2
    return [*out, data[start:]]


def walk(data: bytes) -> list[tuple[int, bytes | None]]:
    """Markers after SOI in order: segments up to the scan's with their payloads, then the restart markers in the data, without any."""
    out, at, marker = [], 2, 0
    while marker != SOS:
        mark, marker, size = struct.unpack_from(">BBH", data, at)
        if mark != 0xFF:
            raise ValueError("a segment doesn't begin with a marker")
        out.append((marker, data[at + 4 : at + 2 + size]))
        at += 2 + size
    return out + [(m, None) for _, m in markers(data[at:]) if RST <= m <= RST + 7]
