"""What format a file has, and what its head tells without decoding: GIF, WebP and files that are only named."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.errors import ImageError
from rasterloom.functions.limits import DEFAULTS, OUTPUT_FORMATS, Limits

# Formats by what files begin with (None: any byte), and by brand where the fifth byte on says ftyp.
SIGNATURES = (
    ("png", b"\x89PNG\r\n\x1a\n"), ("jpeg", b"\xff\xd8\xff"), ("jxl", b"\xff\x0a"), ("jxl", b"\0\0\0\x0cJXL \r\n\x87\n"), ("gif", b"GIF8"),
    ("webp", b"RIFF....WEBP"), ("bmp", b"BM"), ("tiff", b"II*\0"), ("tiff", b"MM\0*"),
)
BRANDS = {b"avif": "avif", b"avis": "avif", b"heic": "heic", b"heix": "heic", b"mif1": "heif", b"msf1": "heif"}
MOST_CHUNKS = 1024


def begins(data: bytes, sign: bytes) -> bool:
    return data.startswith(sign) if b"...." not in sign else len(data) >= len(sign) and data[:4] == sign[:4] and data[8:12] == sign[8:]


def compatible_brands(data: bytes) -> list[bytes]:
    end = min(int.from_bytes(data[:4], "big"), len(data), 4096)
    return [data[k : k + 4] for k in range(16, end - 3, 4)]


def format_of(data: bytes) -> str | None:
    if len(data) >= 12 and data[4:8] == b"ftyp":
        found = BRANDS.get(data[8:12])
        return found if found != "heif" else "avif" if any(BRANDS.get(b) == "avif" for b in compatible_brands(data)) else "heic"
    return next((name for name, sign in SIGNATURES if begins(data, sign)), None)


def format_column(content: Column) -> Column:
    """format_of as an expression, which Spark runs without Python; only the first 4096 bytes are looked at."""
    at = lambda k, n: F.substring(content, k, n)
    ends = F.least(F.conv(F.hex(at(1, 4)), 16, 10).cast("long"), F.length(content).cast("long"), F.lit(4096))
    places = F.sequence(F.lit(17).cast("long"), F.greatest(ends - 3, F.lit(17)), F.lit(4).cast("long"))
    brands = lambda kind: [k for k, v in BRANDS.items() if v == kind]
    avif = F.exists(places, lambda k: (k + 3 <= ends) & F.substring(content, k.cast("int"), F.lit(4)).isin(brands("avif")))
    own = at(9, 4)
    of_brand = F.when(own.isin(brands("heif")), F.when(avif, "avif").otherwise("heic")).when(own.isin(brands("avif")), "avif").when(own.isin(brands("heic")), "heic")
    of_sign = None
    for name, sign in SIGNATURES:
        test = at(1, len(sign)) == sign if b"...." not in sign else (at(1, 4) == sign[:4]) & (at(9, 4) == sign[8:])
        of_sign = F.when(test, name) if of_sign is None else of_sign.when(test, name)
    return F.when((F.length(content) >= 12) & (at(5, 4) == b"ftyp"), of_brand).otherwise(of_sign)


def handler(table: dict, data: bytes, target: str | None = None):
    """The entry of a table for a file's format, which is also the target's."""
    name = format_of(data)
    if name is None:
        raise ImageError("UNSUPPORTED", "no format that is known")
    if target not in (None, name):
        raise ImageError("UNSUPPORTED", f"{name} files are not made {target} files here")
    if name not in table:
        raise ImageError("UNSUPPORTED", f"{name} files are not handled here")
    return table[name]


def target_format(source: str, asked: str | None = None) -> str:
    """The format asked for, else the source's own if it can be written, else png."""
    if asked is not None and asked not in OUTPUT_FORMATS:
        raise ImageError("BAD_OPTION", f"format has to be one of {', '.join(OUTPUT_FORMATS)}")
    return asked or (source if source in OUTPUT_FORMATS else "png")


def gif_info(data: bytes) -> dict:
    """The screen and the sizes of all images, block by block; damage ends the walk."""
    if len(data) < 13:
        raise ImageError("BAD_GIF", "the head is cut")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    table = lambda f: 3 << (f & 7) + 1 if f & 0x80 else 0
    at, sizes = 13 + table(flags), []
    while at < len(data) and data[at] in (0x21, 0x2C):
        if data[at] == 0x21:
            at += 2
        elif at + 10 > len(data):
            break
        else:
            sizes.append(struct.unpack_from("<HH", data, at + 5))
            at += 11 + table(data[at + 9])
        while at < len(data) and data[at]:
            at += data[at] + 1
        at += 1
    return {"width": width, "height": height, "sizes": sizes, "metadata": []}


def riff(data: bytes) -> list[tuple[bytes, bytes]]:
    """(id, data) of a WebP file's chunks, of which there are at most a bounded number; the last may be cut."""
    out, at = [], 12
    while at + 8 <= len(data) and len(out) < MOST_CHUNKS:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        out.append((data[at : at + 4], data[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return out


def webp_metadata(data: bytes) -> dict:
    """exif, icc, xmp of a WebP file, and how often it plays (0: for ever, null: not at all)."""
    out: dict = {"exif": None, "icc": None, "xmp": None, "loops": None}
    for kind, body in riff(data):
        if kind == b"ICCP":
            out["icc"] = body
        elif kind == b"EXIF":
            out["exif"] = body[6:] if body[:2] == b"Ex" and body[4:6] == b"\0\0" else body
        elif kind == b"XMP ":
            out["xmp"] = body.decode("utf-8", "replace")
        elif kind == b"ANIM" and len(body) >= 6:
            out["loops"] = int.from_bytes(body[4:6], "little")
    return out


def webp_info(data: bytes) -> dict:
    from rasterloom.metadata.previews import Walk

    three = lambda b, k: int.from_bytes(b[k : k + 3], "little") + 1
    size, sizes = (0, 0), []
    for kind, body in riff(data):
        if kind == b"VP8X" and len(body) >= 10:
            size = three(body, 4), three(body, 7)
        elif kind == b"ANMF" and len(body) >= 16:
            sizes.append((three(body, 6), three(body, 9)))
        elif kind == b"VP8 " and not size[0] and len(body) >= 10:
            size = tuple(x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
        elif kind == b"VP8L" and not size[0] and len(body) >= 5:
            bits = int.from_bytes(body[1:5], "little")
            size = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    meta = webp_metadata(data)
    out = {"width": size[0], "height": size[1], "sizes": sizes, "metadata": [k for k in ("exif", "icc", "xmp") if meta[k]]}
    if meta["exif"]:
        w = Walk(meta["exif"])
        out["orientation"] = (w.values(w.entries(w.u("I", 4)).get(0x0112)) or [1])[0]
    return out


def other_info(data: bytes, name: str, limits: Limits = DEFAULTS) -> dict:
    """What is known of a file that cannot be scrambled as it is."""
    out = {"gif": gif_info, "webp": webp_info}.get(name, lambda _: {"width": None, "height": None, "sizes": [], "metadata": []})(data)
    sizes = out.pop("sizes")
    if out["width"]:
        limits.pixels(out["width"], out["height"])
    for w, h in sizes:
        limits.pixels(w, h, "frame")
    if len(sizes) > 1:
        limits.frames(len(sizes), len(sizes) * out["width"] * out["height"])
    return {"format": name, "scrambled": False, **out, "frames": len(sizes) or None, "animated": len(sizes) > 1}


def is_lossless_avif(data: bytes) -> bool:
    """Whether its colour box says that samples were coded as they are (matrix 0)."""
    at = data.find(b"colrnclx", 0, 1 << 16)
    return at >= 0 and data[at + 12 : at + 14] == b"\0\0"
