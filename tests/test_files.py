"""PNG files, EXIF blocks, JPEG segments, folders of files."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.sources import exif, images, png

KINDS = [(d, c, i) for c, depths in png.DEPTHS.items() for d in depths for i in (0, 1)]


def picture(width, height, depth, color, interlace, seed=0):
    head = png.Header(width, height, depth, color, interlace)
    top = 1 << depth if depth < 8 else 256
    smooth = np.add.outer(np.arange(height) * 7, np.arange(width) * 5)[:, :, None] + np.random.default_rng(seed).integers(0, 9, (height, width, head.pixel_bytes))
    return head, (smooth % top).astype(np.uint8)


@pytest.mark.parametrize("depth,color,interlace", KINDS)
@pytest.mark.parametrize("size", [(1, 1), (7, 5), (33, 12)])
def test_png_of_all_kinds(depth, color, interlace, size):
    head, raster = picture(*size, depth, color, interlace)
    data = png.png_file(head, raster, ((b"tEXt", b"Comment\0kept"),))
    parts = png.chunks(data)
    assert png.header(parts) == head
    assert np.array_equal(png.decoded(head, png.frames(parts, head)[0][1]), raster)
    for mode, block in (("pixel", 0), ("block", 3 | 0x8000)):
        hidden = png.scrambled(data, b"key", b"salt", mode, block)
        back = png.chunks(png.restored(hidden, b"key"))
        assert np.array_equal(png.decoded(head, png.frames(back, head)[0][1]), raster)
        assert [k for k, _ in back] == [k for k, _ in parts] and png.marker_of(back) is None


def test_each_filter_by_hand():
    rows = np.array([[1, 2, 3, 250], [9, 8, 7, 6]], np.uint8)
    for kind in range(5):
        raw = []
        for y in range(2):
            line = [kind]
            for x in range(4):
                a, b = int(rows[y, x - 1]) if x else 0, int(rows[y - 1, x]) if y else 0
                c = int(rows[y - 1, x - 1]) if x and y else 0
                p = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                line.append((int(rows[y, x]) - (0, a, b, (a + b) // 2, p)[kind]) % 256)
            raw += line
        assert np.array_equal(png.decoded(png.Header(4, 2, 8, 0), zlib.compress(bytes(raw)))[:, :, 0], rows)


def test_animation():
    head, first = picture(6, 5, 8, 2, 0)
    small, second = picture(3, 2, 8, 2, 0, 1)
    control = lambda n, h: struct.pack(">IIIIIHHBB", n, h.width, h.height, 0, 0, 1, 10, 0, 0)
    one, two = png.encoded(head, first), png.encoded(small, second)
    parts = png.chunks(png.png_file(head, first))
    parts = [parts[0], (b"acTL", struct.pack(">II", 2, 0)), (b"fcTL", control(0, head)), (b"IDAT", one[:5]), (b"IDAT", one[5:]), (b"fcTL", control(1, small)), (b"fdAT", struct.pack(">I", 2) + two[:4]), (b"fdAT", struct.pack(">I", 3) + two[4:]), parts[-1]]
    hidden = png.scrambled(png.joined(parts), b"key", b"salt")
    assert png.info(hidden)["frames"] == 2 and png.info(hidden)["scrambled"]
    again = png.rekeyed(hidden, b"key", b"other", b"salt2")
    found = png.frames(png.chunks(png.restored(again, b"other")), head)
    assert [np.array_equal(png.decoded(h, s), r) for (h, s), r in zip(found, (first, second), strict=True)] == [True, True]


def test_errors_have_codes():
    head, raster = picture(8, 8, 8, 0, 0)
    data = png.png_file(head, raster)
    hidden = png.scrambled(data, b"key", b"")
    cases = [(lambda: png.restored(hidden, b"no"), "WRONG_KEY"), (lambda: png.restored(data, b"no"), "NOT_SCRAMBLED"), (lambda: png.scrambled(hidden, b"k", b""), "ALREADY_SCRAMBLED"), (lambda: png.chunks(b"GIF89a"), "UNSUPPORTED_FORMAT"), (lambda: png.chunks(data[:-20]), "CORRUPT"), (lambda: png.header(png.chunks(data), 63), "LIMIT"), (lambda: png.decoded(head, zlib.compress(b"x")), "CORRUPT")]
    for call, code in cases:
        with pytest.raises(png.ImageError) as e:
            call()
        assert e.value.code == code


@pytest.mark.parametrize("order", "<>")
def test_exif(order):
    block = exif.block_of([("ifd0", 0x0112, 3, struct.pack(order + "H", 6)), ("exif", 0x9003, 2, b"2020:01:02 03:04:05\0"), ("gps", 2, 5, struct.pack(order + "6I", 1, 2, 3, 4, 5, 6)), ("interop", 1, 2, b"R98\0")], order)
    found = exif.tags(block)
    assert exif.orientation(found) == 6
    assert {(t["ifd"], t["text"]) for t in found if t["tag"] not in exif.POINTERS} == {("ifd0", "6"), ("exif", "2020:01:02 03:04:05"), ("gps", "1/2,3/4,5/6"), ("interop", "R98")}
    for cut in range(8, len(block)):
        exif.tags(block[:cut])


def test_jpeg_segments_with_scan():
    data = b"\xff\xd8\xff\xfe\x00\x05abc\xff\xda\x00\x04xy\x12\xff\x00\x34\xff\xd0\x56\xff\xff\xd9"
    assert [(s["marker"], s["length"], s["coded"]) for s in exif.segments(data)] == [(0xFE, 3, 0), (0xDA, 2, 7)]
    with pytest.raises(png.ImageError):
        exif.segments(b"\xff\xd8\xff\xfe\x00\x50abc")


def test_folder_and_stream(spark, tmp_path):
    head, raster = picture(9, 4, 8, 6, 0)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(png.png_file(head, raster))
    (tmp_path / "in/b.png").write_bytes(b"junk")
    (tmp_path / "in/c.png").write_bytes(bytes(100_000))
    files = images.image_files(spark, str(tmp_path / "in"), 50_000)
    look = lambda f: f.select(F.regexp_extract("path", r"[^/]+$", 0).alias("name"), images.png_info(F.col("content")).alias("i")).select("name", "i.width", "i.code")
    want = {("a.png", 9, None), ("b.png", None, "UNSUPPORTED_FORMAT")}
    assert {tuple(r) for r in look(files).collect()} == want
    stream = look(images.image_files(spark, str(tmp_path / "in"), 50_000, stream=True))
    stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    assert {tuple(r) for r in spark.table("seen").collect()} == want


def test_null_file(spark):
    row = spark.sql("SELECT cast(null AS binary) AS c").select(images.png_info(F.col("c"))["code"]).first()
    assert row[0] == "EMPTY"
