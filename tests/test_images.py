"""JPEG coefficients, metadata and policies, conversion, GIF, JPEG XL heads, watermarks, stores, sinks."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geometry, keys
from rasterloom.functions.errors import ImageError
from rasterloom.functions.limits import checked, color, resolved
from rasterloom.functions.params import fitted, inverse_transform, key_bytes, marker, params, read_marker
from rasterloom.metadata import exif, icc, iptc, policy, previews, text, xmp
from rasterloom.metadata.tags import TAGS, tag_by_name, tag_name
from rasterloom.operators import files
from rasterloom.sources import detect, gif, images, jpeg, jpeg_pixels, jxl, png, raster, sink, stores
from rasterloom.streaming import files as streams
from rasterloom.watermark import carried, compile, definition, paint, render


def refused(code, call, *args, **options):
    with pytest.raises(ImageError) as e:
        call(*args, **options)
    assert e.value.code == code


def gradient(width, height):
    y, x = np.mgrid[:height, :width]
    return np.stack([7 * x % 256, 5 * y % 256, 3 * (x ^ y) % 256], 2).astype(np.uint8)


def with_alpha(rgb, alpha=255):
    return np.concatenate([rgb, np.full((*rgb.shape[:2], 1), alpha, np.uint8)], 2)


def png_of(rgba, **meta):
    return raster.png_file(raster.Picture(rgba, 16 if rgba.dtype == np.uint16 else 8, None, meta))[0]


SQUARE = "M0 -700L700 -700L700 0L0 0Z"
MARK = definition.compiled({
    "format": "test-watermark", "version": 1, "id": "mark", "name": "Mark", "box": [0, -700, 1500, 0], "size": {"relative": 0.2}, "stroke": {"width": 0.05}, "shadow": {"blur": 0.1},
    "shapes": [{"d": SQUARE, "fill": "#ff0000"}, {"d": "M800 0Q1150 -1400 1500 0Z", "fill": {"type": "linear", "dir": [1, 0], "stops": [{"at": 0, "color": "#00ff00"}, {"at": 1, "color": "#0000ff80"}]}}],
})


# ---- keys, params, limits


def test_known_stream_and_permutation():
    assert keys.keystream(bytes(32), bytes(12), 0, 1).astype("<u4").tobytes()[:16].hex() == "76b8e0ada0f13d90405d6ae55386bd28"
    # fixed, so that files of earlier versions can be restored
    order = keys.layout(b"alpha", bytes(16), 32, 32)
    assert hashlib.sha256(order.astype("<u4").tobytes()).hexdigest().startswith("0f562333347a6283")
    assert sorted(order.tolist()) == list(range(1024)) and (order != np.arange(1024)).any()


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000])
def test_draws_one_by_one_and_together(n):
    one, two = keys.Draws(bytes(32), bytes(12)), keys.Draws(bytes(32), bytes(12))
    together = [int(x) for part in two.falling(n) for x in part]
    assert together == [one.below(k) for k in range(n, 1, -1)]
    assert two.many_below(8, 50).tolist() == [one.below(8) for _ in range(50)]


def test_params_and_marker():
    p = params("block", 5, True, salt=b"s")
    assert read_marker(marker(p, b"1234")) == (p, b"1234")
    assert [inverse_transform(t) for t in range(8)] == [0, 1, 2, 3, 4, 6, 5, 7]
    small = fitted(params("block", 16, True, salt=b""), [(16, 16)])
    assert small.tile == 8 and fitted(params("block", 2, salt=b""), [(4, 2)]).mode == "pixel"
    assert fitted(p, [(100, 100)]) is p
    refused("BAD_OPTION", params, "block", 1)
    refused("BAD_OPTION", key_bytes, "")
    refused("BAD_OPTION", key_bytes, "\ud800")
    good = marker(p, b"1234")
    for damaged, code in ((good[:3], "BAD_MARKER"), (b"\x09" + good[1:], "UNSUPPORTED"), (good[:1] + b"\x07" + good[2:], "BAD_MARKER"), (good + b"x", "BAD_MARKER"), (good[:2] + b"\0\0" + good[4:], "BAD_MARKER"), (b"\2" + good[1:] + b"\x40", "UNSUPPORTED")):
        refused(code, read_marker, damaged)


def test_options_and_limits():
    assert color("#AbC") == "#aabbcc" and checked({"background": "112233"}) == {"background": "#112233"}
    for bad in ({"block": 1}, {"quality": 101}, {"mode": "x"}, {"subsampling": "4:1:1"}, {"progressive": 3}, {"background": "red"}, {"salt": bytes(256)}, {"level": True}):
        refused("BAD_OPTION", checked, bad)
    assert resolved({"max_pixels": 9}).max_pixels == 9
    refused("BAD_OPTION", resolved, {"max_pixel": 9})
    refused("BAD_OPTION", resolved, {"max_pixels": 0})
    data = png_of(with_alpha(gradient(20, 20)))
    for limits in ({"max_pixels": 399}, {"max_input_bytes": 10}, {"max_chunks": 2}, {"max_decompressed_bytes": 100}):
        refused("LIMIT", files.encode, data, "k", limits=limits)
    picture = jpeg_pixels.jpeg_file(gradient(16, 16), progressive=True)
    refused("LIMIT", files.inspect, picture, limits={"max_scans": 2})


def test_orientation_and_delay():
    stored = np.arange(6).reshape(2, 3)
    assert geometry.displayed(stored, 6).tolist() == [[3, 0], [4, 1], [5, 2]]
    for o in range(1, 9):
        assert (geometry.undisplayed(geometry.displayed(stored, o), o) == stored).all()
        a, b, c, d, e, f = geometry.orientation_matrix(o, 3, 2)
        shown = geometry.displayed(stored, o)
        for y in range(2):
            for x in range(3):
                px, py = a * (x + 0.5) + c * (y + 0.5) + e, b * (x + 0.5) + d * (y + 0.5) + f
                assert shown[int(py), int(px)] == stored[y, x]
    assert geometry.apng_delay(5, 0) == (5, 100) and geometry.apng_delay(200_000, 100_000) == (2, 1)
    assert max(geometry.apng_delay(1_000_003, 999_983)) <= 65535 and geometry.exact_delay(10, 100) == (1, 10)


# ---- PNG


def test_small_pictures_change():
    rgba = with_alpha(gradient(16, 16))
    hidden = files.encode(png_of(rgba), "key", b"salt")
    assert (raster.decoded(hidden).rgba != rgba).any(2).mean() > 0.5
    assert (raster.decoded(files.decode(hidden, "key")).rgba == rgba).all()


@pytest.mark.parametrize("options", [{"mode": "pixel"}, {"block": 4}, {"transforms": False}, {"watermark": "mark"}, {"visible_watermark": MARK, "watermark": MARK}, {"format": "jpeg"}, {"format": "jpeg", "visible_watermark": MARK}])
def test_verbs(options):
    rgba = with_alpha(gradient(120, 90))
    data = png_of(rgba)
    hidden = files.encode(data, "key", b"salt", **options)
    plain = files.decode(hidden, "key")
    told = files.inspect(hidden)
    assert told["scrambled"] and not files.inspect(plain)["scrambled"] and files.is_scrambled(hidden)
    assert (told["watermark"] or {}).get("id") == ("mark" if "watermark" in options else None)
    again = files.rekey(hidden, "key", "other", b"salt2")
    if told["format"] == "png":
        assert (raster.decoded(plain).rgba == rgba).all()
        assert files.decode(again, "other") == plain
    else:
        assert jpeg_pixels.decoded(files.decode(again, "other"))[0].tolist() == jpeg_pixels.decoded(plain)[0].tolist()
    refused("WRONG_KEY", files.decode, again, "key")
    refused("ALREADY_SCRAMBLED", files.encode, hidden, "key")
    refused("ALREADY_SCRAMBLED", files.convert, hidden, format="png" if told["format"] == "jpeg" else "jpeg")
    refused("NOT_SCRAMBLED", files.decode, plain, "key")


def test_watermark_on_a_restored_picture():
    rgba = with_alpha(gradient(200, 150))
    for data in (png_of(rgba), png_of(with_alpha((gradient(200, 150) // 64) * 64))):
        hidden = files.encode(data, "key", b"s", watermark=MARK)
        drawn = raster.decoded(files.decode(hidden, "key", watermark=True)).rgba
        changed = (drawn != raster.decoded(data).rgba).any(2)
        place = render.placed(MARK, 200, 150)
        assert changed.any() and not changed[: place.rect[1]].any() and not changed[:, : place.rect[0]].any()
    by_id = files.encode(data, "key", b"s", watermark="mark")
    refused("BAD_WATERMARK", files.decode, by_id, "key", watermark=True)
    assert files.decode(by_id, "key", watermark=True, find={"mark": MARK}.get) == files.decode(hidden, "key", watermark="mark", find={"mark": MARK}.get)


def test_smallest_kind_of_file():
    rng = np.random.default_rng(1)
    grey = lambda v: with_alpha(np.repeat(v[:, :, None], 3, 2).astype(np.uint8))
    noise = rng.integers(0, 256, (30, 40))
    cases = [(grey(noise // 128 * 255), (0, 1)), (grey(noise // 64 * 85), (0, 2)), (grey(noise // 16 * 17), (0, 4)), (grey(noise), (0, 8)), (with_alpha(grey(noise)[:, :, :3], 9), (4, 8))]
    cases += [(with_alpha(gradient(40, 30) // 128 * 128), (3, 4)), (with_alpha(gradient(40, 30)), (2, 8)), (with_alpha(gradient(40, 30), 9), (6, 8)), (with_alpha(gradient(40, 30)).astype(np.uint16) * 257, (2, 8))]
    cases += [(with_alpha(gradient(40, 30)).astype(np.uint16) * 250, (6, 16))]
    for rgba, (kind, bits) in cases:
        data = png_of(rgba)
        head = png.header(png.chunks(data))
        assert (head.color_type, head.depth) == (kind, bits)
        back = raster.decoded(data)
        assert (back.rgba == (rgba // 257 if rgba.dtype == np.uint16 and back.depth == 8 else rgba)).all()


def test_16_bit_becomes_8():
    rgba = np.zeros((1, 4, 4), np.uint16)
    rgba[0, :, 0] = [0, 128, 129, 65535]
    assert files.to_8_bit(raster.Picture(rgba, 16)).rgba[0, :, 0].tolist() == [0, 0, 1, 255]


def test_previews_do_not_survive():
    thumb = jpeg_pixels.jpeg_file(gradient(16, 16))
    model = exif.Exif("<", {"IFD0": [exif.encoded(tag_by_name("Make"), "Cam", "<")], "IFD1": [exif.Entry(0x0201, 4, 1, bytes(4), (thumb,)), exif.Entry(0x0202, 4, 1, struct.pack("<I", len(thumb)))]})
    block, _ = exif.written(model)
    assert thumb in block and exif.info(block)["thumbnail"] == len(thumb)
    data = png_of(with_alpha(gradient(30, 30)), exif=block)
    hidden = files.encode(data, "k")
    assert thumb[:100] not in hidden and thumb[:100] in files.encode(data, "k", keep_thumbnails=True)
    as_jpeg = files.convert(data, format="jpeg", keep_thumbnails=True).content
    got = files.convert(as_jpeg + b"a second picture")
    assert thumb[:100] not in got.content and got.dropped == ["EXIF thumbnail", "16 bytes after the image"]
    packet = xmp.Packet(xmp.EMPTY)
    packet.set("xmp:Thumbnails", "data")
    assert previews.without_xmp_previews(str(packet))[1] == ["XMP preview (xmp:Thumbnails)"]
    assert previews.without_xmp_previews("<x:Thumbnails> <broken") == (None, ["XMP (not readable, and it names a preview)"])
    assert previews.without_jfif_thumbnail(b"JFIF\0" + bytes(7) + b"\1\1abc") == b"JFIF\0" + bytes(9)
    note = exif.Entry(0x927C, 7, len(thumb) + 8, b"vendor!!" + thumb)
    block, _ = exif.written(exif.Exif("<", {"IFD0": [], "Exif": [note]}))
    cleaned, what = previews.without_exif_previews(block)
    assert what == ["MakerNote preview (zeroed)"] and len(cleaned) == len(block) and thumb not in cleaned


# ---- JPEG


def coefficients(data):
    return [c.coefs[: c.real_h, : c.real_w] for c in jpeg.read(data)[1].components]


def same(a, b):
    return all((x == y).all() for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("size", [(64, 48), (37, 23), (50, 30), (33, 65), (7, 5), (1, 1)])
@pytest.mark.parametrize("sampling", ["4:4:4", "4:2:2", "4:2:0"])
@pytest.mark.parametrize(("progressive", "grey", "interval"), [(False, False, 0), (False, True, 0), (False, False, 3), (True, False, 0), (True, True, 0)])
def test_jpeg_coefficients(size, sampling, progressive, grey, interval):
    tables, frame = jpeg_pixels.frame_of_pixels(gradient(*size), 85, sampling, grey)
    data = jpeg.assembled(tables, frame, progressive=progressive, interval=interval)
    segments, found, _ = jpeg.read(data)
    assert not found.damaged and [s.marker for s in segments if jpeg.is_sof(s.marker)] == [0xC2 if progressive else 0xC0]
    want = [c.coefs[: c.real_h, : c.real_w] for c in frame.components]
    assert same(coefficients(data), want)
    hidden = jpeg.scrambled(data, b"key", b"salt")
    assert same(coefficients(jpeg.restored(hidden, b"key")), want)
    if size[0] > 30:
        assert not same(coefficients(hidden), want)
    assert same(coefficients(jpeg.rebuilt(data)), want)


def test_jpeg_of_unusual_factors_is_enlarged():
    _, frame = jpeg_pixels.frame_of_pixels(gradient(37, 23), 85, "4:4:4")
    parts = tuple(jpeg.Component(c.id, 2, 2, c.tq, c.real_w, c.real_h, np.zeros((4, 6, 64), np.int16)) for c in frame.components)
    for k, c in enumerate(parts):
        c.coefs[: c.real_h, : c.real_w] = np.random.default_rng(k).integers(-9, 9, (c.real_h, c.real_w, 64))
    body = frame.body[:6] + b"".join(bytes([c.id, 0x22, c.tq]) for c in parts)
    tables, _ = jpeg_pixels.frame_of_pixels(gradient(8, 8), 85, "4:4:4")
    data = jpeg.assembled(tables, jpeg.Frame(0xC0, body, 37, 23, parts, 2, 2, 3, 2))
    hidden = jpeg.scrambled(data, b"key", b"salt")
    told = jpeg.info(hidden)
    assert (told["width"], told["height"], told["stored_width"], told["stored_height"]) == (37, 23, 48, 32)
    assert same(coefficients(jpeg.restored(hidden, b"key")), coefficients(data))


def test_refined_scans():
    """A progressive file whose coefficients come bit by bit: made by hand, a block of few values."""
    coefs = np.zeros(64, int)
    coefs[[0, 1, 2, 5, 40]] = [20, 5, -3, 1, -6]  # by zigzag place
    bits = []
    put = lambda v, n: bits.extend(int(b) for b in f"{v:0{n}b}"[:n]) if n else None

    def data():
        while len(bits) % 8:
            bits.append(1)
        out = bytes(int("".join(map(str, bits[k : k + 8])), 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits.clear()
        return out

    every = bytes(15) + b"\x00"
    dht = lambda kind, symbols: jpeg.Segment(0xC4, bytes([kind << 4]) + bytes(7) + bytes([len(symbols)]) + bytes(8) + bytes(symbols))
    dc, ac = [0, 1, 2, 3, 4, 5], [0x00, 0x01, 0x02, 0x11, 0x12, 0xF0, 0x31, 0x41]
    code = lambda table, symbol: put(table.index(symbol), 8)
    scans = []
    code(dc, 4)
    put(20 >> 1, 4)
    scans.append(jpeg.Segment(0xDA, b"\1\1\0\0\0\x01", data()))
    put(20 & 1, 1)
    scans.append(jpeg.Segment(0xDA, b"\1\1\0\0\0\x10", data()))
    # first pass without the lowest bit: 2, -1 at 1 and 2, -3 at 40
    code(ac, 0x02), put(2, 2), code(ac, 0x01), put(0, 1), code(ac, 0xF0), code(ac, 0xF0)
    run = 40 - 3 - 32
    ac2 = run << 4 | 2
    table = [*ac, ac2]
    put(table.index(ac2), 8), put(0, 2), put(0, 8)
    scans.append(jpeg.Segment(0xDA, b"\1\1\0\1\x3f\x01", data()))
    # refinement: 5 -> one more bit 1, -3 -> 1, a new 1 at 5 after two zeros, -6 -> 0
    new = 0x21
    table2 = [*table, new]
    put(table2.index(new), 8), put(1, 1), put(1, 1), put(1, 1), put(0, 8), put(0, 1)
    scans.append(jpeg.Segment(0xDA, b"\1\1\0\1\x3f\x10", data()))
    tables, frame = jpeg_pixels.frame_of_pixels(gradient(8, 8), 85, "4:4:4", grey=True)
    file = jpeg.written([*tables, jpeg.Segment(0xC2, frame.body), dht(0, dc), *scans[:2], dht(1, table), scans[2], dht(1, table2), scans[3]])
    found = jpeg.read(file)[1]
    assert not found.damaged and every
    assert found.components[0].coefs.reshape(64)[jpeg.ZIGZAG].tolist() == coefs.tolist()


def test_damaged_jpeg():
    data = jpeg_pixels.jpeg_file(gradient(64, 64), quality=95)
    cut = data[: len(data) * 2 // 3]
    assert jpeg.read(cut)[1].damaged and not jpeg.read(data)[1].damaged
    half = jpeg_pixels.decoded(cut)[0]
    assert np.abs(half[:16].astype(int) - jpeg_pixels.decoded(data)[0][:16]).max() == 0
    rng = np.random.default_rng(3)
    for _ in range(60):
        broken = bytearray(data)
        for at in rng.integers(2, len(data), 4):
            broken[at] = rng.integers(0, 256)
        try:
            jpeg.restored(jpeg.scrambled(bytes(broken), b"k", b"s"), b"k")
        except ImageError:
            pass


def test_jpeg_pixels():
    y, x = np.mgrid[:96, :128]
    smooth = np.stack([128 + 100 * np.sin(x / 40), 128 + 90 * np.cos(y / 30), (x + y) / 2], 2).astype(np.uint8)
    for sampling, far in (("4:4:4", 1.5), ("4:2:0", 3)):
        assert np.abs(jpeg_pixels.decoded(jpeg_pixels.jpeg_file(smooth, quality=95, subsampling=sampling))[0].astype(int) - smooth).mean() < far
    table = np.ones(64, int)
    block = np.random.default_rng(0).integers(0, 256, (8, 8)).astype(np.float64)
    got = jpeg_pixels.blocks_of(block, 1, 1, table).reshape(8, 8)
    c = lambda k: np.sqrt(0.125) if k == 0 else 0.5
    want = [[c(u) * c(v) * sum((block[i, j] - 128) * np.cos((2 * i + 1) * v * np.pi / 16) * np.cos((2 * j + 1) * u * np.pi / 16) for i in range(8) for j in range(8)) for u in range(8)] for v in range(8)]
    assert np.abs(got - np.array(want)).max() <= 0.5 + 1e-9


def test_optimal_codes_are_bounded_and_least():
    counts = np.zeros(256, int)
    counts[:30] = [int(1.7**k) + 1 for k in range(30)]
    lengths, symbols = jpeg.optimal_spec(counts)
    assert sum(lengths) == 30 and sum(n / 2 ** (k + 1) for k, n in enumerate(lengths)) < 1
    assert len(jpeg.optimal_spec(np.eye(256, dtype=int)[7])[1]) == 1
    few = np.zeros(256, int)
    few[[1, 2, 3, 4]] = [8, 4, 2, 1]
    assert jpeg.optimal_spec(few)[0][:4] == bytes([1, 1, 1, 1])


# ---- metadata


def phone(order="<"):
    put = lambda name, value: exif.encoded(exif.settable(name), value, order)
    first = [put(n, v) for n, v in (("Make", "Cam"), ("Artist", "Ann"), ("Orientation", 6), ("DateTime", "2024:01:02 03:04:05"), ("XPAuthor", "Änn"))]
    second = [put("FNumber", 2.8), put("UserComment", "größe"), put("BodySerialNumber", "123"), exif.Entry(0x927C, 7, 16, b"vendor data 1234")]
    return exif.written(exif.Exif(order, {"IFD0": first, "Exif": second, "GPS": [put("GPSLatitude", [1, 2, 3.5])], "SubIFD0": [put("ImageWidth", 7)]}))[0]


@pytest.mark.parametrize("order", "<>")
def test_exif_model(order):
    block = phone(order)
    model = exif.parsed(block)
    assert exif.written(model) == (block, []) and model.warnings == []
    rows = {(t["ifd"], t["name"]): t["value"] for t in exif.info(block)["tags"]}
    assert rows["GPS", "GPSLatitude"] == [1, 2, 3.5] and rows["IFD0", "XPAuthor"] == "Änn" and rows["Exif", "UserComment"] == "größe" and rows["SubIFD0", "ImageWidth"] == 7
    other = exif.parsed(exif.written(model, "<>".replace(order, ""))[0])
    assert {(t["ifd"], t["name"]): t["value"] for t in exif.info(exif.written(other)[0])["tags"] if t["name"] != "UserComment"} == {k: v for k, v in rows.items() if k[1] != "UserComment"}
    assert exif.orientation(model) == 6 and exif.parsed(exif.with_orientation(block, 3)).ifds["IFD0"] != model.ifds["IFD0"]
    assert exif.with_orientation(None, 1) is None and exif.orientation(exif.parsed(exif.with_orientation(None, 8))) == 8
    for cut in range(8, len(block)):
        exif.info(block[:cut])
    smaller = exif.parsed(block)
    smaller.ifds["IFD0"] = smaller.ifds["IFD0"][:1]
    again, notes = exif.written(smaller)
    assert exif.parsed(again).maker_note_at == model.maker_note_at and notes == []


def test_exif_values():
    assert exif.best_fraction(0.1, False) == (1, 10) and exif.best_fraction("1/3", False) == (1, 3) and exif.best_fraction(-0.5, True) == (-1, 2)
    assert exif.best_fraction(np.pi, False)[1] <= 1_000_000 and exif.best_fraction(-1, False) is None and exif.best_fraction("1/0", False) is None
    for name, value in (("Orientation", 9), ("DateTime", "yesterday"), ("Make", 3), ("FNumber", "x"), ("ExifVersion", "23"), ("GPSLatitude", [1, 2])):
        refused("BAD_METADATA", lambda n=name, v=value: exif.encoded(exif.settable(n), v, "<"))
    for name in ("MakerNote", "StripOffsets", "ExifIFDPointer", "nothing"):
        refused("BAD_METADATA", exif.settable, name)
    assert tag_name("GPS", 2) == "GPSLatitude" and tag_name("IFD1", 0x0201) == "JPEGInterchangeFormat" and tag_name("Exif", 0x1234) == "0x1234" and len(TAGS) > 170


def test_xmp():
    packet = xmp.Packet(xmp.EMPTY)
    packet.set("dc:creator", ["Ann", "Bob & Co"])
    packet.set("xmp:CreatorTool", "tool")
    packet.set("dc:title", "T")
    written = str(packet)
    again = xmp.Packet(written)
    assert again.properties() == [("dc:creator", ["Ann", "Bob & Co"]), ("xmp:CreatorTool", "tool"), ("dc:title", ["T"])] and str(again) == written
    assert again.remove(lambda n: n.startswith("dc:")) == ["dc:creator", "dc:title"] and again.properties() == [("xmp:CreatorTool", "tool")]
    odd = f"""<r:RDF xmlns:r='{xmp.RDF}'><r:Description  q:City = "A&amp;B" xmlns:q="http://ns.adobe.com/photoshop/1.0/" ><!-- c --><q:X r:resource='u'/></r:Description></r:RDF>"""
    assert str(xmp.Packet(odd)) == odd and xmp.Packet(odd).properties() == [("photoshop:City", "A&B"), ("photoshop:X", "u")]
    for bad in ("<a><b></a>", "<!DOCTYPE x><a/>", "<a>&nope;</a>", "<a x='1' x='2'/>", "<a>" * 80, "plain", "<a b=c/>"):
        refused("BAD_XMP", xmp.Packet, bad)
    assert xmp.known_property("dc:creator") and not xmp.known_property("zz:creator") and not xmp.known_property("rdf:li")


def test_iptc_and_icc_and_text():
    fields = ((1, 90, iptc.UTF8), (2, 80, "Ännchen".encode()), (2, 90, b"Town"), (2, 120, b"x" * 40_000))
    body = iptc.SIGNATURE + iptc.Resource(iptc.IPTC, b"8BIM\x04\x04\0\0", b"".join(iptc.Dataset(*f).written() for f in fields)).written() + iptc.Resource(iptc.DIGEST, b"8BIM\x04\x25\0\0", bytes(16)).written()
    assert [d["name"] for d in iptc.listed(body)] == ["By-line", "City", "Caption-Abstract"] and iptc.listed(body)[0]["value"] == "Ännchen"
    new, gone, put = iptc.edited(body, lambda n: n == "City", {"by-line": "Zed"})
    assert (gone, put) == (["City"], ["By-line"]) and iptc.listed(new)[0]["value"] == "Zed" and len(iptc.readable(new)) == 1
    assert iptc.edited(body[:-3], lambda n: True) is None and iptc.dataset_number("city") == 90
    assert icc.is_srgb(icc.srgb()) and icc.described(icc.srgb())["description"] == "sRGB"
    off = bytearray(icc.srgb())
    at = off.index(b"rXYZ") + 4
    off[int.from_bytes(off[at : at + 4], "big") + 9] ^= 1
    assert not icc.is_srgb(bytes(off)) and icc.described(b"x" * 200) is None
    assert text.comment(b"caf\xe9 \x80") == "café €" and text.comment("größe".encode()) == "größe" and len(text.comment_bytes("é" * 40_000)) == 65532
    for word, value in (("Title", "café"), ("Title", "中")):
        assert text.read_text(*text.text_chunk(word, value)) == (word, value)
    assert text.read_text(b"zTXt", b"K\0\0" + zlib.compress(b"long")) == ("K", "long") and text.read_text(b"zTXt", b"K\0\0junk") is None
    refused("LIMIT", text.read_text, b"zTXt", b"K\0\0" + zlib.compress(bytes(1000)), 10)
    assert text.header_json({"a": "é"}) == '{"a":"\\u00e9"}'


def both_formats():
    packet = xmp.Packet(xmp.EMPTY)
    packet.set("dc:creator", ["Ann"])
    packet.set("photoshop:City", "Town")
    packet.set("crs:Version", "1")
    data = png_of(with_alpha(gradient(40, 30)), exif=phone(), xmp=str(packet), icc=icc.srgb(), density=(2835, 2835, "meter"), comments=["hello", "größe 中"])
    return data, files.convert(data, format="jpeg").content


POLICIES = ["keep", "strip-all", "privacy", "web", {"remove": ["exif:GPS/*", "xmp:dc:*", "timestamps"]}, {"set": {"artist": "Zed", "comment": ["a", "b"], "orientation": 3, "icc": "srgb", "exif": {"Copyright": "me", "Make": None}, "xmp": {"dc:subject": ["x"]}, "text": {"Title": "t"}}}]


@pytest.mark.parametrize("given", POLICIES)
def test_policies(given):
    for data in both_formats():
        out, report = files.apply_metadata(data, given)
        again, second = files.apply_metadata(out, given)
        assert again == out and not second.set and not second.removed
        found = files.inspect(out, metadata=True)["meta"]
        tags = {t["name"]: t["value"] for t in (found["exif"] or {}).get("tags", [])}
        properties = {p["name"] for p in (found["xmp"] or {}).get("properties", [])}
        if given == "keep":
            assert out == data
        elif given in ("strip-all", "web"):
            assert tags == {"Orientation": 6} and not properties and not found["text"] and (found["icc"] is None) == (given == "web")
        elif given == "privacy":
            assert {"Make", "FNumber", "Orientation"} <= set(tags) and not {"Artist", "XPAuthor", "GPSLatitude", "DateTime", "BodySerialNumber", "MakerNote"} & set(tags)
            assert properties == {"crs:Version"}
        elif "remove" in given:
            assert "GPSLatitude" not in tags and "DateTime" not in tags and "Artist" in tags and properties == {"photoshop:City", "crs:Version"}
        else:
            assert (tags["Artist"], tags["Copyright"], tags["Orientation"]) == ("Zed", "me", 3) and "Make" not in tags and "dc:subject" in properties
            assert [t["text"] for t in found["text"] if t["keyword"] == "Comment"] == ["a", "b"]
        if given != "keep":
            assert report.removed or report.set
    pixels = [raster.decoded(both_formats()[0]).rgba, raster.decoded(files.apply_metadata(both_formats()[0], given)[0]).rgba]
    assert (pixels[0] == pixels[1]).all()


def test_policy_on_scrambled_and_unreadable():
    data = both_formats()[0]
    hidden = files.encode(data, "k", b"s")
    cleaned, report = files.apply_metadata(hidden, "privacy")
    assert (raster.decoded(files.decode(cleaned, "k")).rgba == raster.decoded(data).rgba).all() and report.removed
    assert files.decode(hidden, "k", metadata="privacy") == files.decode(cleaned, "k")
    broken = png.joined([(k, b"junk" if k == b"eXIf" else d) for k, d in png.chunks(data)])
    out, report = files.apply_metadata(broken, "privacy")
    assert png.own_part(png.chunks(out), b"eXIf") is None and any("unreadable" in r for r in report.removed)
    refused("UNSUPPORTED", files.apply_metadata, b"GIF89a" + bytes(20), "privacy")


def test_policy_forms():
    for bad in ("none", {"keep": ["exif"], "strip": ["exif"]}, {"strip": ["x"]}, {"remove": ["exif:Nowhere/x"]}, {"remove": ["xmp:creator"]}, {"set": {"orientation": 9}}, {"set": {"xmp": {"zz:a": "b"}}}, {"set": {"text": {"Comment": "x"}}}, {"other": 1}, 5):
        refused("BAD_METADATA", policy.policy, bad)
    p = policy.policy({"remove": ["owner", "xmp:exif:GPS*", "exif:SubIFD/Image*"]})
    assert p.reason("xmp", "dc:creator") == "owner" and p.reason("xmp", "exif:GPSLatitude") == "xmp:exif:GPS*" and p.reason("text", "author") == "owner" and p.reason("iptc", "City") is None
    assert p.exif_reason("SubIFD3", 0x0100, "ImageWidth") == "exif:SubIFD/Image*" and p.exif_reason("IFD0", 0x0100, "ImageWidth") is None
    assert p.touches("iptc") and not p.touches("other") and policy.policy("keep").idle
    shown = policy.profile({"set": {"xmp": {"xmp:b": "1", "dc:a": "2"}, "artist": "A"}, "id": "mine", "strip": ["text", "exif"], "keep": []})
    assert list(shown) == ["id", "strip", "set"] and shown["strip"] == ["exif", "text"] and list(shown["set"]) == ["artist", "xmp"] and list(shown["set"]["xmp"]) == ["dc:a", "xmp:b"]
    refused("BAD_METADATA", policy.profile, {"id": "keep"})


# ---- other formats


def lzw(indices, size):
    clear, out, width = 1 << size, [], size + 1
    table, codes = {bytes([k]): k for k in range(clear)}, []
    codes.append((clear, width))
    run, free = b"", clear + 2
    for v in indices:
        if run + bytes([v]) in table:
            run += bytes([v])
            continue
        codes.append((table[run], width))
        if free < 4096:
            table[run + bytes([v])] = free
            free += 1
            if free == (1 << width) + 1 and width < 12:
                width += 1
        run = bytes([v])
    codes += [(table[run], width), (clear + 1, width)]
    held = bits = 0
    for code, n in codes:
        held |= code << bits
        bits += n
        while bits >= 8:
            out.append(held & 255)
            held, bits = held >> 8, bits - 8
    data = bytes([*out, held])
    return b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255)) + b"\0"


def gif_file(frames, palette, size, loops=2):
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x83, 0, 0) + palette.tobytes() + b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0"
    for index, x, y, disposal, delay, clear in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None)]) + struct.pack("<HB", delay, clear or 0) + b"\0\x2c" + struct.pack("<4HB", x, y, index.shape[1], index.shape[0], 0) + b"\x04" + lzw(index.ravel().tolist(), 4)
    return out + b"\x3b"


def test_gif():
    rng = np.random.default_rng(0)
    palette = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    full, part, last = (rng.integers(0, 16, s).astype(np.uint8) for s in ((120, 150), (8, 10), (5, 5)))
    data = gif_file([(full, 0, 0, 0, 0, None), (part, 3, 2, 2, 7, 4), (last, 1, 1, 0, 9, None)], palette, (150, 120))
    got = gif.decoded(data)
    assert got.animation.delays == [(10, 100), (7, 100), (9, 100)] and got.animation.plays == 3
    want = with_alpha(palette[full])
    assert (got.animation.frames[0] == want).all()
    area = want.copy()
    seen = part != 4
    area[2:10, 3:13][seen] = with_alpha(palette[part])[seen]
    assert (got.animation.frames[1] == area).all()
    area[2:10, 3:13] = 0
    area[1:6, 1:6] = with_alpha(palette[last])
    assert (got.animation.frames[2] == area).all()
    made = files.convert(data)
    back = raster.decoded(made.content)
    assert made.format == "png" and made.transferred == ["animation"] and back.animation.delays == got.animation.delays and back.animation.plays == 3
    assert all((a == b).all() for a, b in zip(back.animation.frames, got.animation.frames, strict=True))
    hidden = files.encode(data, "k")
    assert all((a == b).all() for a, b in zip(raster.decoded(files.decode(hidden, "k")).animation.frames, got.animation.frames, strict=True))
    told = files.inspect(data)
    assert (told["format"], told["width"], told["height"], told["frames"], told["animated"]) == ("gif", 150, 120, 3, True)
    for cut in range(0, len(data), 37):
        try:
            gif.decoded(data[:cut])
        except ImageError:
            pass


def test_formats(spark):
    ftyp = lambda brand, *more: struct.pack(">I", 16 + 4 * len(more)) + b"ftyp" + brand + bytes(4) + b"".join(more)
    cases = [
        (b"\x89PNG\r\n\x1a\n", "png"), (b"\xff\xd8\xff\xe0", "jpeg"), (b"\xff\x0a\x00", "jxl"), (jxl.SIGNATURE, "jxl"), (b"GIF89a", "gif"), (b"RIFF\1\2\3\4WEBPVP8 ", "webp"), (b"BMxx", "bmp"),
        (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (ftyp(b"avif"), "avif"), (ftyp(b"heic"), "heic"), (ftyp(b"mif1", b"heic", b"avif"), "avif"), (ftyp(b"mif1", b"heic"), "heic"), (ftyp(b"isom"), None), (b"RIFF....WAVE", None), (b"", None),
    ]
    assert [detect.format_of(c) for c, _ in cases] == [f for _, f in cases]
    table = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c binary")
    assert [r[0] for r in table.orderBy("i").select(detect.format_column(F.col("c"))).collect()] == [f for _, f in cases]
    assert detect.target_format("gif") == "png" and detect.target_format("jpeg") == "jpeg"
    refused("BAD_OPTION", detect.target_format, "png", "gif")
    refused("UNSUPPORTED", detect.handler, {"png": 1}, b"GIF89a")
    webp = b"RIFF\0\0\0\0WEBP" + b"".join(k + struct.pack("<I", len(d)) + d + b"\0" * (len(d) % 2) for k, d in ((b"VP8X", bytes(4) + b"\x09\0\0\x04\0\0"), (b"ANIM", bytes(4) + b"\5\0"), (b"ANMF", bytes(6) + b"\x04\0\0\x03\0\0" + bytes(4)), (b"EXIF", b"Exif\0\0" + phone())))
    told = files.inspect(webp)
    assert (told["width"], told["height"], told["frames"], told["orientation"], told["metadata"]) == (10, 5, 1, 6, ["exif"]) and detect.webp_metadata(webp)["loops"] == 5
    refused("UNSUPPORTED", files.convert, webp)
    solid = lambda data, limits: raster.Picture(np.full((5, 10, 4), 255, np.uint8))
    broken = lambda data, limits: 1 / 0
    assert files.convert(webp, decoders=((("webp",), solid, "solid"),)).decoder == "solid"
    got = files.convert(jpeg_pixels.jpeg_file(gradient(9, 9)), decoders=((("jpeg",), broken, "broken"),), format="png")
    assert got.decoder == "jpeg" and got.notes[0].startswith("broken could not") and got.notes[1].startswith("jpeg is lossy")


def jxl_bits(*fields):
    value = n = 0
    for v, k in fields:
        value |= v << n
        n += k
    return jxl.BARE + value.to_bytes(-(-n // 8) + 4, "little")


def test_jxl():
    # a size of 40 x 24, no default, no extras, 8 bits, one alpha, without XYB, sRGB
    stream = jxl_bits((1, 1), (2, 5), (0, 3), (4, 5), (0, 1), (0, 1), (0, 1), (0, 2), (1, 1), (1, 2), (1, 1), (0, 1), (1, 1))
    head = jxl.header(stream)
    assert (head["width"], head["height"], head["alpha"], head["lossy"], head["srgb"]) == (40, 24, True, False, True)
    packet = xmp.Packet(xmp.EMPTY)
    packet.set("dc:creator", ["Ann"])
    data = jxl.written([(b"Exif", bytes(4) + phone()), (b"xml ", str(packet).encode()), (b"jumb", b"xx"), (b"jbrd", b"yy"), (b"brob", b"xml abc")], stream)
    told = files.inspect(data, metadata=True)
    assert told["format"] == "jxl" and told["jpeg_data"] and told["metadata"] == ["exif", "xmp"] and told["meta"]["exif"]["tags"]
    assert jxl.read(data)[1] == stream and jxl.has_jpeg(data) and files.inspect(stream)["container"] is False
    out, report = files.apply_metadata(data, "privacy")
    kinds = [k for k, _ in jxl.read(out)[0]]
    assert b"jumb" not in kinds and b"jbrd" not in kinds and b"Exif" in kinds and any("c2pa" in r for r in report.removed)
    for call in (lambda: files.encode(data, "k"), lambda: files.decode(data, "k"), lambda: files.rekey(data, "k", "l"), lambda: files.convert(data, format="png"), lambda: files.encode(both_formats()[0], "k", format="jxl")):
        refused("UNSUPPORTED", call)
    assert jxl.reencoding_notes({**head, "lossy": True, "depth": 16, "extra": ["depth", "depth"]})[-1] == "extra channels (2: depth)"
    for cut in range(len(data)):
        try:
            files.inspect(data[:cut])
        except ImageError:
            pass


# ---- watermarks


def test_watermark_forms():
    made = definition.normal_definition({"id": "a-b", "text": "x", "font": "F", "fill": "#ABC", "stroke": {}, "ornaments": [{}]})
    assert made["name"] == "a-b" and made["fill"] == "#aabbcc" and made["stroke"]["join"] == "round" and made["ornaments"][0]["shape"] == "sparkle" and list(made)[:3] == ["id", "name", "text"]
    assert json.loads(definition.definition_text(made)) == made
    assert definition.json_text({"a": {"b": 1, "c": []}, "d": [1, 2]}) == '{\n  "a": {\n    "b": 1,\n    "c": []\n  },\n  "d": [1, 2]\n}'
    for bad in ({"id": "A"}, {"id": "a", "text": "", "font": "F"}, {"id": "a", "text": "x", "font": "F", "opacity": 2}, {"id": "a", "text": "x", "font": "F", "nope": 1}, {"id": "a", "text": "x", "font": "F", "size": {"min": 9, "max": 3}}):
        refused("BAD_WATERMARK", definition.normal_definition, bad)
    for change in ({"version": 2}, {"shapes": []}, {"box": [1, 2]}, {"format": "x"}):
        refused("BAD_WATERMARK", definition.compiled, {**MARK, **change})


def test_coverage_against_many_points():
    rng = np.random.default_rng(2)
    points = rng.uniform(-3, 15, (3, 2))
    cover = render.coverage([points], 12, 10)
    fine = (np.arange(0, 12, 1 / 16) + 1 / 32, np.arange(0, 10, 1 / 16) + 1 / 32)
    x, y = np.meshgrid(*fine)
    sides = [(points[(k + 1) % 3, 0] - points[k, 0]) * (y - points[k, 1]) - (points[(k + 1) % 3, 1] - points[k, 1]) * (x - points[k, 0]) for k in range(3)]
    inside = np.all([s > 0 for s in sides], 0) | np.all([s < 0 for s in sides], 0)
    assert np.abs(cover - inside.reshape(10, 16, 12, 16).mean((1, 3))).max() < 0.05
    square = render.coverage([np.array([[1.5, 1.25], [6.5, 1.25], [6.5, 4.75], [1.5, 4.75]])], 10, 8)
    assert square.sum() == pytest.approx(17.5) and square[1, 1] == pytest.approx(0.375)


def test_rendering():
    patch = render.rendered(MARK, 400, 300)
    place = render.placed(MARK, 400, 300)
    assert place.em == 48 and (patch.x, patch.y) == place.rect[:2] and 0 <= patch.data.min() and patch.data.max() <= 1 + 1e-9
    assert render.placed({**MARK, "fit": {**MARK["fit"], "minSize": 100}}, 400, 300) is None
    for o in range(1, 9):
        w, h = (300, 400) if o > 4 else (400, 300)
        got = render.rendered_stored(MARK, w, h, o)
        full = np.zeros((h, w, 4))
        full[got.y : got.y + got.data.shape[0], got.x : got.x + got.data.shape[1]] = got.data
        want = np.zeros((300, 400, 4))
        want[patch.y : patch.y + patch.data.shape[0], patch.x : patch.x + patch.data.shape[1]] = patch.data
        assert (geometry.displayed(full, o) == want).all()
    assert render.blurred(np.eye(5), 1)[2, 2] == pytest.approx(3 / 9)
    assert render.dilated(np.pad([[1.0]], 3), 2, False, True).sum() == 13
    assert render.straight(patch).dtype == np.uint8


def test_painting():
    patch = render.Patch(1, 0, np.dstack([np.full((2, 2), 0.5), np.zeros((2, 2)), np.zeros((2, 2)), np.full((2, 2), 0.5)]))
    grey = np.full((3, 4, 1), 100, np.uint8)
    out = paint.painted_samples(grey, 8, patch)
    assert out[:2, 1:3, 0].tolist() == [[88, 88], [88, 88]] and (out[2] == 100).all() and (grey == 100).all()
    clear = np.zeros((3, 4, 4), np.uint8)
    assert paint.painted_samples(clear, 8, patch)[0, 1].tolist() == [255, 0, 0, 128]
    keyed = np.zeros((3, 4, 3), np.uint8)
    assert paint.painted_samples(keyed, 8, patch, key=np.array([0, 0, 0]))[0, 1].tolist() == [255, 0, 0]
    wide = np.full((3, 4, 2), 1, np.uint8)
    assert paint.painted_samples(wide, 16, patch).shape == (3, 4, 2)
    indexed = paint.painted_indices(np.zeros((3, 4, 1), np.uint8), bytes([0, 0, 0, 120, 0, 0, 255, 0, 0]), b"", patch)
    assert indexed[0, :, 0].tolist() == [0, 1, 1, 0]


def glyph(font, c):
    """Squares for letters, nothing for spaces, in a font of one name."""
    return None if font != "Boxes" or c == "?" else (0.6, "" if c == " " else "M0 -0.7L0.5 -0.7L0.5 0L0 0Z")


def test_compiling():
    wanted = {"id": "x", "text": "ab\nc", "font": "Boxes", "align": "right", "letterSpacing": 0.1, "fill": {"type": "linear", "angle": 90, "stops": [{"at": 0, "color": "#000"}, {"at": 1, "color": "#ffffff80"}]}, "ornaments": [{"shape": s} for s in ("sparkle", "star", "diamond", "dot", "heart")] + [{"shape": "line", "position": "below", "size": 1}, {"shape": "image", "src": "logo.png", "position": "top-left"}], "background": {"border": {}}, "stroke": {}}
    made = compile.compile_watermark(wanted, glyph, {"logo.png": png_of(with_alpha(gradient(9, 6)))}.get)
    first, second = made["shapes"][0]["d"], made["shapes"][1]["d"]
    assert first == "M0 -700L500 -700L500 0L0 0ZM700 -700L1200 -700L1200 0L700 0Z" and second == "M700 500L1200 500L1200 1200L700 1200Z"
    assert made["shapes"][0]["fill"]["dir"] == [1.0, 0.0] and len(made["shapes"]) == 9 and made["shapes"][-1]["image"]["width"] == 9
    assert compile.bounds(["M0 0Q50 100 100 0Z"]) == pytest.approx((0, 0, 100, 50)) and compile.bounds([made["shapes"][5]["d"]])[2] > 1200
    assert render.rendered(made, 800, 600) is not None
    picture = compile.svg(made)
    import xml.etree.ElementTree as tree

    assert len(tree.fromstring(picture).findall("{*}path")) == 8 and "linearGradient" in picture
    refused("BAD_WATERMARK", compile.compile_watermark, {**wanted, "font": "None"}, glyph)
    refused("BAD_WATERMARK", compile.compile_watermark, wanted, glyph)


def test_scaling():
    raster_ = np.arange(64, dtype=np.uint8).reshape(4, 16, 1)
    assert geometry.nearest_scaled(raster_, 4, 2)[:, :, 0].tolist() == [[18, 22, 26, 30], [50, 54, 58, 62]]
    assert geometry.box_scaled(raster_, 4, 2)[:, :, 0].tolist() == [[10, 14, 18, 22], [42, 46, 50, 54]]
    assert geometry.reveal_plan("blocks", 4000, 3000, (16, 16), 100, 1_000_000) == ("blocks", 1000, 750) and geometry.reveal_plan("none", 10, 10) == ("dissolve", 10, 10)
    photo = jpeg_pixels.jpeg_file(gradient(8, 8), {"exif": phone()})
    assert jpeg.orientation_of(jpeg.parsed(photo)[0]) == 6 and jpeg.orientation_of(jpeg.parsed(jpeg.without_exif(photo))[0]) == 1


def test_carried_watermarks():
    assert carried.decoded(carried.encoded({"id": "x"})) == {"id": "x", "name": None, "compiled": None}
    assert carried.decoded(carried.encoded(MARK))["compiled"] == MARK
    for bad in (b"", b"\1\5x", b"\1\1{", b"\1\1[]"):
        assert carried.read_carried(bad)[1].code == "BAD_WATERMARK" and carried.carried(bad) is None
    data = bytes(range(200))
    assert carried.enciphered(carried.enciphered(data, b"k", b"s"), b"k", b"s") == data
    rasters = [np.arange(60, dtype=np.uint8).reshape(5, 4, 3)]
    regions = [(0, 1, 1, 2, 3)]
    made = carried.stash(MARK, regions, carried.covered_bytes(rasters, regions), b"k", b"s")
    back, told = carried.unstashed_pixels([np.zeros_like(rasters[0])], made, b"k", b"s")
    assert (back[0][1:4, 1:3] == rasters[0][1:4, 1:3]).all() and json.loads(told) == MARK
    for bad in (made[:-1], b"\7" + made[1:], made[:40]):
        refused("BAD_WATERMARK", carried.unstashed_pixels, rasters, bad, b"k", b"s")
    refused("BAD_WATERMARK", carried.unstashed_pixels, [rasters[0][:2]], made, b"k", b"s")
    many = carried.stash(MARK, [(k, 0, 0, 1, 1) for k in range(300)], bytes(300), b"k", b"s")
    assert many[0] == 2 and len(carried.unstashed(many, b"k", b"s", lambda r: 1)[1]) == 300


# ---- tables, sinks, stores


def test_columns_over_files(spark, tmp_path):
    rgba = with_alpha(gradient(32, 24))
    rows = [("a/one.png", png_of(rgba)), ("a/two.jpeg", jpeg_pixels.jpeg_file(gradient(32, 24))), ("a/three.gif", b"GIF89a"), ("b/four", b"no picture"), ("b/five.png", None), ("b/six.png", png_of(rgba)[:-30])]
    table = spark.createDataFrame(rows, "path string, content binary")
    hidden = table.select("path", images.scrambled(F.col("content"), "key", F.col("path").cast("binary")).alias("h"), images.inspected(F.col("content")).alias("i"))
    codes = {r["path"]: r["h"]["code"] for r in hidden.collect()}
    assert codes == {"a/one.png": None, "a/two.jpeg": None, "a/three.gif": "BAD_GIF", "b/four": "UNSUPPORTED", "b/five.png": "EMPTY", "b/six.png": "CORRUPT"}
    back = hidden.select("path", images.restored(F.col("h.content"), "key").alias("r"), images.inspected(F.col("h.content")).alias("i"), images.rekeyed(F.col("h.content"), "key", "new", F.lit(b"s")).alias("k"))
    got = {r["path"]: r for r in back.collect()}
    assert got["a/one.png"]["i"]["scrambled"] and (raster.decoded(bytes(got["a/one.png"]["r"]["content"])).rgba == rgba).all()
    assert got["b/four"]["r"]["code"] == "EMPTY" and got["a/two.jpeg"]["k"]["code"] is None
    made = table.select("path", images.converted(F.col("content"), format="jpeg").alias("c"), images.with_policy(F.col("content"), "privacy").alias("p"), images.metadata(F.col("content")).alias("m")).collect()
    assert [r["c"]["format"] for r in made[:2]] == ["jpeg", "jpeg"] and made[2]["p"]["code"] == "UNSUPPORTED" and made[0]["m"]["format"] == "png"
    for bad in ({"quality": 0}, {"metadata": "nothing"}):
        with pytest.raises(ImageError):
            images.converted(F.col("content"), **bad)
    files_out = hidden.where("h.content is not null").select(sink.output_name("encode", F.col("path"), F.col("i.format")).alias("name"), F.col("h.content").alias("content"))
    sink.write_files(files_out, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.scrambled.png", "two.scrambled.jpg"]
    assert files.is_scrambled((tmp_path / "out/one.scrambled.png").read_bytes())
    with pytest.raises(Exception, match="there already"):
        sink.write_files(files_out, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.scrambled.png", "two.scrambled.jpg"]


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    data = png_of(with_alpha(gradient(20, 20)))
    for name, content in (("a.png", data), ("b.png", data), ("c.png", b"junk")):
        (tmp_path / "in" / name).write_bytes(content)
    bad = []
    for _ in range(2):
        found = streams.once_each(images.image_files(spark, str(tmp_path / "in"), 10**6, stream=True))
        query = streams.written(found, images.scrambled(F.col("content"), "key", F.lit(b"s")), sink.output_name("encode", F.col("path"), F.lit("png")), str(tmp_path / "out"), str(tmp_path / "state"), lambda rows: bad.extend(rows.collect()))
        query.awaitTermination(120)
        assert query.exception() is None
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert names in (["a.scrambled.png"], ["b.scrambled.png"]) and [r["code"] for r in bad] == ["UNSUPPORTED"]
    assert files.decode((tmp_path / "out" / names[0]).read_bytes(), "key") == png_of(with_alpha(gradient(20, 20)))


def test_faults_become_codes(spark):
    row = spark.sql("SELECT cast('x' AS binary) AS c").select(images.per_file(lambda c: 1 / 0, images.FILE, F.col("c"))["code"], images.png_scrambled(F.lit(png_of(with_alpha(gradient(9, 9)))), b"k", F.lit(bytes(300)))["code"], images.png_scrambled(F.lit(png_of(with_alpha(gradient(9, 9)))), b"k", F.lit(b"s"), "block")["code"]).first()
    assert tuple(row) == ("FAULT", "BAD_OPTION", "BAD_OPTION")


def test_large_files_keep_a_row(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"12345")
    (tmp_path / "b").write_bytes(bytes(100))
    got = images.image_files(spark, str(tmp_path), 50, keep_large=True).select(F.regexp_extract("path", "[^/]+$", 0), "length", F.length("content"), "code").collect()
    assert {tuple(r) for r in got} == {("a", 5, 5, None), ("b", 100, None, "LIMIT")}


def test_names_and_keys(spark):
    cases = [("encode", "x/a.b.png", "jpeg", "a.b.scrambled.jpg"), ("decode", "a.scrambled.png", "png", "a.png"), ("decode", "a.png", "png", "a.restored.png"), ("rekey", "/d/a", "jxl", "a.rekeyed.jxl")]
    for verb, path, kind, want in cases:
        assert spark.range(1).select(sink.output_name(verb, F.lit(path), F.lit(kind))).first()[0] == want
    assert sink.key_file(b"\xef\xbb\xbfkey\r\n") == b"key" and sink.key_file(b"a\n\n") == b"a\n"
    refused("BAD_OPTION", sink.key_file, b"\n")


def test_stores(spark, tmp_path):
    store = stores.profiles(str(tmp_path))
    store.save({"id": "mine", "preset": "web"}, create=True)
    refused("EXISTS", store.save, {"id": "mine"}, create=True)
    refused("NOT_FOUND", store.get, "other")
    refused("BAD_METADATA", store.get, "../x")
    (tmp_path / "bad.json").write_text("{")
    assert store.list() == [{"id": "mine", "preset": "web"}] and stores.load_policy("mine", str(tmp_path)) == {"id": "mine", "preset": "web"} and stores.load_policy("web", "") == "web"
    assert store.table(spark).collect()[0]["id"] == "mine"
    store.remove("mine")
    marks = stores.compiled_watermarks(str(tmp_path))
    marks.save(MARK)
    assert stores.load_watermark("mark", str(tmp_path)) == MARK and marks.ids() == ["mark"]
