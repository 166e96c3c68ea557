"""PNG encoding with numpy: lossless palettes where colours are few, quantized ones on request, else true colour."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..operators.quantize import quantize

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def phys(dpi: float) -> bytes:
    per_meter = int(np.floor(dpi / 0.0254 + 0.5))
    return chunk(b"pHYs", struct.pack(">IIB", per_meter, per_meter, 1))


def filtered(pixels: np.ndarray) -> bytes:
    """Rows (height x width x channels) with the filter each whose residuals, taken as signed, sum least; ties to the
    first of none, sub, up, average, Paeth. All five are worked out for all rows at once."""
    h, w, c = pixels.shape
    x = pixels.astype(np.int16)
    left, up = np.zeros_like(x), np.zeros_like(x)
    left[:, 1:], up[1:] = x[:, :-1], x[:-1]
    corner = np.zeros_like(x)
    corner[1:, 1:] = x[:-1, :-1]
    guess = left + up - corner
    near = [np.abs(guess - v) for v in (left, up, corner)]
    paeth = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
    rows = np.stack([(x - p).astype(np.uint8).reshape(h, w * c) for p in (np.zeros_like(x), left, up, (left + up) // 2, paeth)])
    cost = np.minimum(rows, 256 - rows.astype(np.int16)).sum(2)
    best = cost.argmin(0)
    return np.hstack([best[:, None].astype(np.uint8), rows[best, np.arange(h)]]).tobytes()


def packed(indices: np.ndarray, depth: int) -> bytes:
    """Palette indices in `depth` bits each, rows byte-aligned, filter 0."""
    h, w = indices.shape
    per = 8 // depth
    wide = np.zeros((h, -(-w // per) * per), np.uint8)
    wide[:, :w] = indices
    shifts = np.arange(per - 1, -1, -1, dtype=np.uint8) * depth
    rows = np.bitwise_or.reduce(wide.reshape(h, -1, per) << shifts, axis=2).astype(np.uint8)
    return np.hstack([np.zeros((h, 1), np.uint8), rows]).tobytes()


def _file(width: int, height: int, depth: int, color: int, body: bytes, before: bytes = b"", dpi: float | None = None, level: int = 6) -> bytes:
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + (phys(dpi) if dpi else b"")
    return SIGNATURE + head + before + chunk(b"IDAT", zlib.compress(body, level)) + chunk(b"IEND", b"")


def _indexed(indices: np.ndarray, palette: np.ndarray, dpi: float | None, level: int) -> bytes:
    """Colours that aren't opaque come first, so that tRNS ends with the last of them."""
    order = np.argsort(palette[:, 3] == 255, kind="stable")
    place = np.empty(len(order), np.uint8)
    place[order] = np.arange(len(order))
    palette, indices = palette[order], place[indices]
    clear = palette[palette[:, 3] < 255, 3].astype(np.uint8).tobytes()
    depth = next(d for d in (1, 2, 4, 8) if len(palette) <= 1 << d)
    before = chunk(b"PLTE", palette[:, :3].astype(np.uint8).tobytes()) + (chunk(b"tRNS", clear) if clear else b"")
    return _file(indices.shape[1], indices.shape[0], depth, 3, packed(indices, depth), before, dpi, level)


def encode(rgba: np.ndarray, colors: int = 0, dpi: float | None = None, level: int = 6) -> tuple[bytes, int, bool]:
    """(file, palette size, lossy) of a height x width x 4 array. colors > 0 allows that many colours at most."""
    data = rgba.astype(np.uint8).copy()
    data[data[..., 3] == 0] = 0
    alpha = bool((data[..., 3] != 255).any())
    gray = bool((data[..., 0] == data[..., 1]).all() and (data[..., 1] == data[..., 2]).all())
    keys = data.reshape(-1, 4).view(">u4").ravel()
    distinct, index = np.unique(keys, return_inverse=True)
    levels = gray and not alpha and len(distinct) > 16
    if len(distinct) <= 256 and not levels:
        palette = distinct.astype(">u4").view(np.uint8).reshape(-1, 4)
        return _indexed(index.reshape(data.shape[:2]), palette, dpi, level), len(distinct), False
    if colors > 0 and not levels:
        palette, chosen = quantize(data, min(256, colors))
        return _indexed(chosen, palette, dpi, level), len(palette), True
    channels, color = {(True, False): ([0], 0), (True, True): ([0, 3], 4), (False, False): ([0, 1, 2], 2), (False, True): ([0, 1, 2, 3], 6)}[gray, alpha]
    return _file(data.shape[1], data.shape[0], 8, color, filtered(data[..., channels]), b"", dpi, level), 0, False


def set_png_dpi(data: bytes, dpi: float) -> bytes:
    """The file with pHYs after IHDR in place of any it had; what isn't a whole PNG comes back as it is."""
    if len(data) < 33 or data[:2] != b"\x89P":
        return data
    out, at, done = [data[:8]], 8, False
    while at + 12 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + length > len(data):
            return data
        if kind != b"pHYs":
            out.append(data[at : at + 12 + length])
        if kind == b"IHDR" and not done:
            out.append(phys(dpi))
            done = True
        at += 12 + length
        if kind == b"IEND":
            break
    return b"".join(out) if done else data


def set_jpeg_dpi(data: bytes, dpi: float) -> bytes:
    """The file with the density of its JFIF header set, or with such a header put in; other files as they are."""
    if data[:3] != b"\xff\xd8\xff":
        return data
    density = struct.pack(">BHH", 1, *[int(max(1, min(65535, np.floor(dpi + 0.5))))] * 2)
    if len(data) > 18 and data[2:4] == b"\xff\xe0" and data[6:11] == b"JFIF\0":
        return data[:13] + density + data[18:]
    return data[:2] + b"\xff\xe0\x00\x10JFIF\0\x01\x01" + density + b"\0\0" + data[2:]
