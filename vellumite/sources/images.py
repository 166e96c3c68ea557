"""Image headers from the first bytes of files: format, size, alpha, animation, orientation. Names don't matter."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "format string, width int, height int, may_have_alpha boolean, animated boolean, orientation int"
#: Bytes of a file that are looked at.
HEAD = 512 * 1024
# Brands of ISO media files.
AVIF, HEIC = {b"avif", b"avis"}, {b"heic", b"heix", b"heim", b"heis", b"hevc", b"hevx", b"mif1", b"msf1"}


def _made(kind: str, size: tuple[int | None, int | None] = (None, None), alpha: bool = True, animated: bool = False, orientation: int = 1) -> tuple:
    return (kind, *size, alpha, animated, orientation)


def _exif(segment: bytes) -> int | None:
    """Orientation in the first directory of an Exif segment."""
    if len(segment) < 14 or segment[:4] != b"Exif" or segment[6:8] not in (b"II", b"MM"):
        return None
    tiff, order = segment[6:], "<" if segment[6:8] == b"II" else ">"
    at = struct.unpack_from(order + "I", tiff, 4)[0]
    if at + 2 > len(tiff):
        return None
    for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
        entry = at + 2 + 12 * k
        if entry + 12 > len(tiff):
            return None
        tag, value = struct.unpack_from(order + "H", tiff, entry)[0], struct.unpack_from(order + "H", tiff, entry + 8)[0]
        if tag == 0x0112:
            return value if 1 <= value <= 8 else None
    return None


def jpeg(data: bytes) -> tuple | None:
    """(width, height, components, orientation) of a JPEG; None without a frame header."""
    at, turn, size = 2, 1, None
    while at + 4 <= len(data):
        if data[at] != 0xFF or data[at + 1] == 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0x01 or 0xD0 <= mark <= 0xD7:
            at += 2
            continue
        length = struct.unpack_from(">H", data, at + 2)[0]
        if mark in (0xD9, 0xDA):
            break
        if length < 2:
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and size is None and at + 9 < len(data):
            high, wide, parts = struct.unpack_from(">HHB", data, at + 5)
            size = (wide, high, parts)
        elif mark == 0xE1 and at + 2 + length <= len(data):
            turn = _exif(data[at + 4 : at + 2 + length]) or turn
        at += 2 + length
    return None if size is None else (*size, turn)


def _png(data: bytes) -> tuple:
    at, size, alpha, animated = 8, (None, None), False, False
    while at + 8 <= len(data):
        length, kind = struct.unpack_from(">I4s", data, at)
        if kind in (b"IDAT", b"IEND"):
            break
        if kind == b"IHDR" and at + 18 <= len(data):
            size = struct.unpack_from(">II", data, at + 8)
            alpha |= data[at + 17] in (4, 6)
        alpha |= kind == b"tRNS"
        if kind == b"acTL" and at + 12 <= len(data):
            animated = struct.unpack_from(">I", data, at + 8)[0] > 1
        at += 12 + length
    return _made("png", size, alpha, animated)


def _gif(data: bytes) -> tuple:
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    byte = lambda i: data[i] if i < len(data) else 0

    def past_blocks(i: int) -> int:
        while byte(i):
            i += byte(i) + 1
        return i + 1

    at, frames, alpha = 13 + table(byte(10)), 0, False
    while at < len(data) and frames < 2 and data[at] in (0x21, 0x2C):
        if data[at] == 0x21:
            alpha |= byte(at + 1) == 0xF9 and bool(byte(at + 3) & 1)
            at = past_blocks(at + 2)
        else:
            frames += 1
            at = past_blocks(at + 11 + table(byte(at + 9)))
    return _made("gif", struct.unpack_from("<HH", data, 6) if len(data) >= 10 else (None, None), alpha, frames > 1)


def _webp(data: bytes) -> tuple:
    kind = data[12:16]
    if kind == b"VP8 " and len(data) >= 30:
        wide, high = struct.unpack_from("<HH", data, 26)
        return _made("webp", (wide & 0x3FFF, high & 0x3FFF), False)
    if kind == b"VP8L" and len(data) >= 25:
        bits = struct.unpack_from("<I", data, 21)[0]
        return _made("webp", (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)), bool(bits >> 28 & 1))
    if kind == b"VP8X" and len(data) >= 30:
        side = lambda i: 1 + int.from_bytes(data[i : i + 3], "little")
        return _made("webp", (side(24), side(27)), bool(data[20] & 0x10), bool(data[20] & 2))
    return _made("webp")


def _bmp(data: bytes) -> tuple:
    if struct.unpack_from("<I", data, 14)[0] == 12:
        return _made("bmp", struct.unpack_from("<HH", data, 18), False)
    if len(data) < 30:
        return _made("bmp")
    wide, high = struct.unpack_from("<ii", data, 18)
    return _made("bmp", (abs(wide), abs(high)), struct.unpack_from("<H", data, 28)[0] == 32)


def _iso(data: bytes) -> tuple:
    end = min(struct.unpack_from(">I", data)[0], len(data))
    first, brands = data[8:12], {data[8:12], *(data[i : i + 4] for i in range(16, end - 3, 4))}
    if brands & AVIF:
        return _made("avif", animated=first == b"avis")
    if brands & HEIC:
        return _made("heic", animated=bool(brands & {b"hevc", b"hevx", b"msf1"}) and b"heic" not in brands)
    return _made("unknown")


def sniff(data: bytes | None) -> tuple:
    """HEADER of a file's first bytes; null and what no rule knows are `unknown`."""
    data = bytes(data or b"")
    if data[:3] == b"\xff\xd8\xff":
        found = jpeg(data)
        return _made("jpeg", found[:2] if found else (None, None), False, False, found[3] if found else 1)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return _gif(data)
    if len(data) >= 16 and data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    if len(data) >= 26 and data[:2] == b"BM":
        return _bmp(data)
    if len(data) >= 12 and data[4:8] == b"ftyp":
        return _iso(data)
    if data[:4] in (b"II*\0", b"MM\0*"):
        return _made("tiff")
    if len(data) >= 6 and data[:4] == b"\0\0\1\0":
        return _made("ico")
    head = data[:2048].decode("utf-8", "replace").removeprefix("﻿").lstrip()
    return _made("svg" if head.startswith("<") and re.search(r"<svg[\s>]", head, re.I) else "unknown")


def _sniff_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for content in batches:
        yield pd.DataFrame([sniff(c) for c in content], columns=[c.split()[0] for c in HEADER.split(", ")])


def image_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds `header` to a table with binary content; only the first bytes go to Python."""
    header = F.pandas_udf(_sniff_all, HEADER)
    return files.withColumn("header", header(F.substring(F.col(content), 1, HEAD)))


def read_folder(spark: SparkSession, path: str, most: int = 5000) -> DataFrame:
    """path, length, header of a folder's files, hidden and system files left out, in natural order of names, the first
    `most` of them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    seen = files.where(~name.startswith(".") & ~name.isin("thumbs.db", "desktop.ini") & ~F.lower("path").contains("/__macosx/"))
    padded = F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1)), lambda p: F.when(p.rlike(r"\A[0-9]"), F.lpad(p, 20, "0")).otherwise(p)), "")
    return image_headers(seen.withColumn("_order", padded).orderBy("_order", "path").limit(most)).drop("content", "_order", "modificationTime")
