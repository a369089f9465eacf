"""Image files as arrays: sizes from headers, and the kinds that Spark's image source can't read in full depth.

PNG of 8 and 16 bits, the binary and plain PNM kinds, and Radiance HDR.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}  # by PNG colour type
_PNM = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?(?:#[^\n]*\n)?\s")
_HDR = re.compile(rb"#\?(?:RADIANCE|RGBE)\n(?:[^\n]*\n)*?\n-Y (\d+) \+X (\d+)\n")


def header(data: bytes) -> tuple[str, int, int, int, int] | None:
    """(kind, width, height, channels, bits a channel) from a file's first bytes; None if it is no image that is known here."""
    if data[:8] == _PNG and data[12:16] == b"IHDR":
        w, h, bits, colour = struct.unpack(">IIBB", data[16:26])
        return "png", w, h, _CHANNELS.get(colour, 0), 8 if colour == 3 else bits
    if found := _HDR.match(data):
        return "hdr", int(found[2]), int(found[1]), 3, 32
    if data[:1] == b"P" and (found := _pnm(data)):
        kind, w, h, most, _ = found
        return "pnm", w, h, 3 if kind in (3, 6) else 1, 16 if most > 255 else 8 if most > 1 or kind not in (1, 4) else 1
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return "gif", *struct.unpack("<HH", data[6:10]), 3, 8
    if data[:2] == b"BM" and len(data) >= 30:
        w, h, _, bits = struct.unpack("<iiHH", data[18:30])
        return "bmp", w, abs(h), 4 if bits == 32 else 3, 8
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                bits, h, w, channels = struct.unpack(">BHHB", data[at + 4 : at + 10])
                return "jpeg", w, h, channels, bits
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def _pnm(data: bytes) -> tuple[int, int, int, int, int] | None:
    found = _PNM.match(data)
    if not found:
        return None
    kind = int(found[1])
    if kind in (1, 4):  # without a greatest value
        found = re.match(rb"P[14](?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:#[^\n]*\n)?\s", data)
        return kind, int(found[1]), int(found[2]), 1, found.end()
    return (kind, int(found[2]), int(found[3]), int(found[4]), found.end()) if found[4] else None


def decode(data: bytes) -> tuple[np.ndarray, bool]:
    """Height x width x channels, and whether values are linear already (HDR); others go from 0 to 1 as stored."""
    found = header(data)
    if found and found[0] == "png":
        return _decode_png(data), False
    if found and found[0] == "pnm":
        return _decode_pnm(data), False
    if found and found[0] == "hdr":
        return _decode_hdr(data), True
    raise ValueError("no PNG, PNM or HDR image")


def _unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """PNG's row filters undone."""
    lines = np.frombuffer(raw, np.uint8, rows * (stride + 1)).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    for y in range(rows):
        kind, line, above = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + above
        elif kind == 1:
            for c in range(step):
                out[y + 1, c::step] = np.cumsum(line[c::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            new, up = line.tolist(), above.tolist()
            for x in range(stride):
                a, b, c = (new[x - step] if x >= step else 0), up[x], (up[x - step] if x >= step else 0)
                if kind == 3:
                    near = (a + b) >> 1
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    near = a if p <= q and p <= r else b if q <= r else c
                new[x] = (new[x] + near) & 0xFF
            out[y + 1] = new
        else:
            raise ValueError(f"row filter {kind}")
    return out[1:]


def _decode_png(data: bytes) -> np.ndarray:
    w, h, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if interlaced or colour not in _CHANNELS:
        raise ValueError("interlaced PNG images are not read")
    at, parts, palette = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IDAT":
            parts.append(body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IEND":
            break
        at += 12 + size
    channels = 1 if colour == 3 else _CHANNELS[colour]
    stride = -(-w * channels * bits // 8)
    rows = _unfiltered(zlib.decompress(b"".join(parts)), h, stride, max(1, channels * bits // 8))
    if bits == 16:
        values = rows.reshape(-1).view(">u2").reshape(h, w, channels)
    elif bits == 8:
        values = rows.reshape(h, w, channels)
    else:
        values = np.unpackbits(rows, axis=1)[:, : w * bits].reshape(h, w, bits)
        values = (values << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)[:, :, None]
    if colour == 3:
        return palette[values[:, :, 0]] / 255.0
    return values / float((1 << bits) - 1)


def _decode_pnm(data: bytes) -> np.ndarray:
    kind, w, h, most, at = _pnm(data)
    channels = 3 if kind in (3, 6) else 1
    if kind == 4:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * -(-w // 8), at).reshape(h, -1), axis=1)[:, :w]
        return 1.0 - bits[:, :, None]
    if kind == 1:
        digits = np.frombuffer(re.sub(rb"[^01]", b"", data[at:]), np.uint8, w * h) - ord("0")
        return 1.0 - digits.reshape(h, w, 1)
    if kind in (2, 3):
        values = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: w * h * channels], np.int64)
    else:
        values = np.frombuffer(data, ">u2" if most > 255 else "u1", w * h * channels, at)
    return values.reshape(h, w, channels) / float(most)


def _decode_hdr(data: bytes) -> np.ndarray:
    found = _HDR.match(data)
    h, w, at = int(found[1]), int(found[2]), found.end()
    out = np.zeros((h, 4, w), np.uint8)
    for y in range(h):
        if not (8 <= w < 32768 and data[at : at + 2] == b"\2\2" and (data[at + 2] << 8 | data[at + 3]) == w):
            rest = np.frombuffer(data, np.uint8, (h - y) * w * 4, at)  # rows that aren't run-length coded
            out[y:] = rest.reshape(h - y, w, 4).transpose(0, 2, 1)
            break
        at += 4
        for c in range(4):
            x = 0
            while x < w:
                n = data[at]
                if n > 128:
                    out[y, c, x : x + n - 128] = data[at + 1]
                    at, x = at + 2, x + n - 128
                else:
                    out[y, c, x : x + n] = np.frombuffer(data, np.uint8, n, at + 1)
                    at, x = at + 1 + n, x + n
    power = out[:, 3].astype(int)
    scale = np.where(power > 0, np.ldexp(1.0, power - 136), 0.0)
    return out[:, :3].transpose(0, 2, 1) * scale[:, :, None]
