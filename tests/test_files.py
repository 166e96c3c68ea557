"""Readers and writers: headers, PNG, PDF, Markdown, HTML, Word, zip."""

import io
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumite.functions import text as T
from vellumite.sinks import archives, docx, markdown, pdf, png
from vellumite.sources import docx as docx_source
from vellumite.sources import html, images


def decoded(data):
    """A plain PNG reader: (color type, depth, RGBA array)."""
    at, parts, palette, clear = 8, b"", None, b""
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack_from(">I", data, at + 8 + n)[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            w, h, depth, color = struct.unpack_from(">IIBB", body)
        palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
        clear = body if kind == b"tRNS" else clear
        parts += body if kind == b"IDAT" else b""
        at += 12 + n
    raw, c = zlib.decompress(parts), {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    row, step = -(-w * c * depth // 8), max(1, c * depth // 8)
    out, prev = np.zeros((h, row), int), np.zeros(row, int)
    for y in range(h):
        kind, line = raw[y * (row + 1)], np.frombuffer(raw, np.uint8, row, y * (row + 1) + 1).astype(int)
        for x in range(row):
            a, b, d = (out[y, x - step] if x >= step else 0), prev[x], (prev[x - step] if x >= step else 0)
            p = a + b - d
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            out[y, x] = (line[x] + (0, a, b, (a + b) // 2, near)[kind]) & 255
        prev = out[y]
    if color == 3:
        bits = np.unpackbits(out.astype(np.uint8), axis=1).reshape(h, -1, depth)[:, :w]
        index = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2)
        full = np.full((len(palette), 4), 255)
        full[:, :3] = palette
        full[: len(clear), 3] = list(clear)
        return color, depth, full[index]
    pixels = out.reshape(h, w, c)
    alpha = pixels[..., -1:] if c in (2, 4) else np.full((h, w, 1), 255)
    return color, depth, np.concatenate([pixels[..., :1].repeat(3, 2) if c < 3 else pixels[..., :3], alpha], 2)


def picture(f, w=64, h=48):
    return np.array([[f(x, y) for x in range(w)] for y in range(h)], np.uint8)


@pytest.mark.parametrize(
    "f,color,depth",
    [(lambda x, y: (x * 4 % 256, y * 5 % 256, (x * y) % 256, 255), 2, 8), (lambda x, y: (255, 0, 0, 255) if x > y else (0, 0, 9, 255), 3, 1), (lambda x, y: ((x % 16) * 9, 1, 2, 255), 3, 4), (lambda x, y: ((x + y) % 200,) * 3 + (255,), 0, 8), (lambda x, y: (x % 7, y % 11, 3, 0 if x < 9 else 200), 3, 8), (lambda x, y: (x * 4 % 256, y * 5 % 256, (x * y) % 256, (x * 7 + y) % 256), 6, 8)],
)
def test_png_is_lossless(f, color, depth):
    image = picture(f)
    data, _, lossy = png.encode(image, dpi=300)
    kind, bits, back = decoded(data)
    want = image.copy()
    want[want[..., 3] == 0] = 0
    assert (kind, bits, lossy) == (color, depth, False) and (back == want).all()
    assert images.sniff(data)[:3] == ("png", 64, 48) and b"pHYs" in data[:60]
    again = png.set_png_dpi(data, 72)
    assert again.count(b"pHYs") == 1 and len(again) == len(data)


def test_quantized_png_is_near():
    image = picture(lambda x, y: (x * 4 % 256, y * 5 % 256, 128, 255))
    data, n, lossy = png.encode(image, colors=64)
    assert lossy and n <= 64 and np.abs(decoded(data)[2][..., :3].astype(int) - image[..., :3]).mean() < 16


def jpeg(orientation=6):
    exif = b"Exif\0\0II*\0\x08\0\0\0\x01\0" + struct.pack("<HHIHH", 0x0112, 3, 1, orientation, 0) + b"\0\0\0\0"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0\x00\x11\x08" + struct.pack(">HHB", 2, 4, 3) + b"\0" * 9 + b"\xff\xd9"


HEADERS = [
    (jpeg(), ("jpeg", 4, 2, False, False, 6)),
    (b"GIF89a" + struct.pack("<HH", 5, 7) + b"\0\0\0" + b"\x21\xf9\x04\x01\0\0\0\0" + (b"\x2c" + b"\0" * 9 + b"\x02\x01\0\0") * 2 + b";", ("gif", 5, 7, True, True, 1)),
    (b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 4 + b"\x12\0\0\0" + b"\x09\0\0\x13\0\0", ("webp", 10, 20, True, True, 1)),
    (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 30, -20) + struct.pack("<HH", 1, 32), ("bmp", 30, 20, True, False, 1)),
    (b"\0\0\0\x18ftypavis" + b"\0\0\0\0avifmif1", ("avif", None, None, True, True, 1)),
    (b"\0\0\0\x18ftypheic" + b"\0\0\0\0mif1heic", ("heic", None, None, True, False, 1)),
    (b"II*\0", ("tiff", None, None, True, False, 1)),
    (b"\0\0\1\0\0\0", ("ico", None, None, True, False, 1)),
    ("﻿ <svg width='1'/>".encode(), ("svg", None, None, True, False, 1)),
    (b"", ("unknown", None, None, True, False, 1)),
    (b"%PDF-1.7", ("unknown", None, None, True, False, 1)),
]


def test_headers(spark):
    assert [images.sniff(d) for d, _ in HEADERS] == [h for _, h in HEADERS]
    df = spark.createDataFrame([(i, bytearray(d)) for i, (d, _) in enumerate(HEADERS)] + [(99, None)], "i int, content binary")
    got = images.image_headers(df).orderBy("i").collect()
    assert [tuple(r.header)[0] for r in got] == [h[0] for _, h in HEADERS] + ["unknown"]


def test_folder_is_read_in_natural_order(spark, tmp_path):
    for name in ("a10.gif", "a2.gif", ".hidden", "Thumbs.db"):
        (tmp_path / name).write_bytes(HEADERS[1][0])
    got = images.read_folder(spark, str(tmp_path)).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["a2.gif", "a10.gif"] and got[0].header.format == "gif"


def test_jpeg_density():
    made = png.set_jpeg_dpi(jpeg(), 300)
    assert made[2:4] == b"\xff\xe0" and struct.unpack(">BHH", made[13:18]) == (1, 300, 300)
    assert struct.unpack(">BHH", png.set_jpeg_dpi(made, 96)[13:18]) == (1, 96, 96) and len(png.set_jpeg_dpi(made, 96)) == len(made)
    assert png.set_jpeg_dpi(b"x", 96) == b"x"


def test_pdf_offsets_and_text(spark):
    rows = [(1, p, i, f"line {i} (x)\\", 72.0, 90.0 + 15 * i, 10.5) for p in range(2) for i in range(3)]
    made = pdf.text_documents(spark.createDataFrame(rows, "doc_id long, page_index int, seq int, text string, x double, baseline double, font_size double")).first()
    data = bytes(made.pdf)
    start = int(data.rsplit(b"startxref\n", 1)[1].split()[0])
    assert data[start : start + 4] == b"xref" and made.pages == 2
    places = [int(x[:10]) for x in data[start:].split(b"\n")[3:] if x.endswith(b" n ")]
    assert all(data[p:].startswith(b"%d 0 obj" % (k + 1)) for k, p in enumerate(places))
    stream = next(s for s in data.split(b"stream\n") if s[:1] == b"x")
    assert b"(line 0 \\(x\\)\\\\) Tj" in zlib.decompressobj().decompress(stream)


def test_markdown_runs_tables_and_documents(spark):
    run = spark.createDataFrame([([(" 加粗 ", True, False), ("rest", False, True), ("x", True, True)],)], "r array<struct<text:string,bold:boolean,italic:boolean>>")
    assert run.select(markdown.runs_text(F.col("r"))).first()[0] == " **加粗** *rest****x***"
    rows = spark.createDataFrame([([["a", "b"], ["c"]], [["one", "two"]])], "t array<array<string>>, u array<array<string>>")
    got = rows.select(markdown.table_markdown(F.col("t")).alias("t"), markdown.table_markdown(F.col("u")).alias("u")).first()
    assert got.t == "| a | b |\n| --- | --- |\n| c |  |" and got.u == "|  |  |\n| --- | --- |\n| one | two |"
    cells = spark.createDataFrame([([[("a<b", 1, 2)]],)], "t array<array<struct<text:string,row_span:int,col_span:int>>>")
    assert '<td colspan="2">a&lt;b</td>' in cells.select(markdown.html_table(F.col("t"))).first()[0]
    blocks = [(1, 0, 1, "heading", 2, "Title"), (1, 0, 2, "list-item", 0, "• one"), (1, 0, 3, "list-item", 1, "2. two"), (1, 1, 1, "paragraph", None, "text")]
    df = spark.createDataFrame(blocks, "doc_id long, page_index int, block long, kind string, level int, text string")
    assert markdown.documents(df).first().markdown == "<!-- page: 1 -->\n\n## Title\n\n- one\n  2. two\n\n<!-- page: 2 -->\n\ntext\n"
    made = docx.documents(df).withColumnRenamed("docx", "content")
    back = docx_source.read_documents(made).orderBy("seq").collect()
    assert [(r.kind, r.level, r.text, r.ordered) for r in back] == [("heading", 2, "Title", None), ("list-item", 0, "one", False), ("list-item", 1, "two", True), ("paragraph", None, "text", None)]
    bad = docx_source.read_documents(spark.createDataFrame([(1, bytearray(b"no zip"))], "i int, content binary")).collect()
    assert [(r.kind, r.error) for r in bad] == [(None, "invalid-docx")]


def test_word_page_fields_are_named():
    body = f'<w:document {docx.W}><w:body><w:p><w:r><w:t>Page </w:t></w:r><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>7</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p></w:body></w:document>'
    data = archives.pack(["word/document.xml"], [body.encode()])
    assert docx_source.read(data) == ([(0, "paragraph", None, "Page ", None, "page")], None)


def test_html():
    text, removed = html.to_markdown("<script>x</script><h2>T &amp; x</h2><p>a <b>bold</b> <a href='javascript:x'>no</a> <a href='https://e.org'>yes</a></p><ol start=3><li>p<ul><li>q</li></ul></li><li>r</li></ol>")
    assert removed == 1 and "## T & x" in text and "a **bold** no [yes](https://e.org)" in text and "3. p" in text and "  - q" in text and "4. r" in text
    assert html.to_markdown(None) == ("", 0)


def test_archives(spark):
    rows = [(1, "a.txt", bytearray(b"one"), 0), (1, "a.txt", bytearray(b"two"), 1), (1, "中.txt", bytearray(b""), 2)]
    made = archives.archives(spark.createDataFrame(rows, "g int, name string, content binary, seq int"), "g").first()
    with zipfile.ZipFile(io.BytesIO(bytes(made.zip))) as z:
        assert z.namelist() == ["a.txt", "a (2).txt", "中.txt"] and z.read("a (2).txt") == b"two" and z.testzip() is None


def test_win_ansi(spark):
    df = spark.createDataFrame([("A€",), ("“x”",), ("中",), ("é.",)], "t string")
    assert [r[0] for r in df.select(T.win_ansi_hex(F.col("t"))).collect()] == ["4180", "937894", None, "e92e"]
