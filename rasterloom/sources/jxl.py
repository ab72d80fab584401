"""JPEG XL files as boxes and a header; their pixels need a codec that there is none of here."""

from __future__ import annotations

import struct

from rasterloom.functions.errors import ImageError
from rasterloom.functions.limits import DEFAULTS, Limits

# Fixed values of the format: signatures, the type box, own boxes of this package, how numbers are laid out.
BARE, SIGNATURE = b"\xff\x0a", b"\0\0\0\x0cJXL \r\n\x87\n"
FTYP = b"jxl \0\0\0\0jxl "
MARKER, WATERMARK, STASH, SIZE = b"rlSc", b"rlWm", b"rlWs", b"rlSz"
STRUCTURE = (b"ftyp", b"jxlc", b"jxlp", b"jxli", b"jxll", b"jbrd", b"jhgm", b"JXL ")
RATIOS = (None, (1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))
DIMENSION = ((1, 9), (1, 13), (1, 18), (1, 30))
CUSTOM = ((0, 19), (524288, 19), (1048576, 20), (2097152, 21))
EXTRA = ("alpha", "depth", "spot colour", "selection mask", "black (CMYK)", "CFA", "thermal")


def bad(message: str) -> ImageError:
    return ImageError("BAD_JXL", message)


def is_jxl(data: bytes) -> bool:
    return data.startswith((BARE, SIGNATURE))


def read(data: bytes, limits: Limits = DEFAULTS) -> tuple[list[tuple[bytes, bytes]], bytes, bool]:
    """(boxes, codestream, whether there is a container)."""
    if data.startswith(BARE):
        return [], data, False
    if not data.startswith(SIGNATURE):
        raise bad("not a JPEG XL file")
    boxes, at = [], len(SIGNATURE)
    while at < len(data):
        limits.chunks(len(boxes) + 1, "boxes")
        size, head = int.from_bytes(data[at : at + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:  # up to the end
            size = len(data) - at
        if size < head or at + size > len(data):
            raise bad("a box is cut")
        boxes.append((data[at + 4 : at + 8], data[at + head : at + size]))
        at += size
    whole = next((d for k, d in boxes if k == b"jxlc"), None)
    parts = [d[4:] for k, d in boxes if k == b"jxlp"]
    if whole is None and not parts:
        raise bad("no codestream")
    return boxes, b"".join(parts) if whole is None else whole, True


def written(boxes: list[tuple[bytes, bytes]], codestream: bytes) -> bytes:
    """A container of metadata boxes and a codestream."""
    return SIGNATURE + b"".join(struct.pack(">I4s", len(d) + 8, k) + d for k, d in [(b"ftyp", FTYP), *boxes, (b"jxlc", codestream)])


def wrapped(boxes: list[tuple[bytes, bytes]], made: bytes) -> bytes:
    """Boxes around what an encoder made, whose level box is kept."""
    own, codestream, _ = read(made)
    return written([*((k, d) for k, d in own if k == b"jxll"), *boxes], codestream)


class Bits:
    """Bits from the least significant one of each byte on."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data[:4096], "little"), 8 * min(len(data), 4096)

    def u(self, n: int) -> int:
        if n > self.left:
            raise bad("the header is cut")
        out = self.value & (1 << n) - 1
        self.value, self.left = self.value >> n, self.left - n
        return out

    def flag(self) -> bool:
        return bool(self.u(1))

    def pick(self, layouts) -> int:
        """One of four (base, bits)."""
        base, n = layouts[self.u(2)]
        return base + self.u(n)

    def kind(self) -> int:
        return self.pick(((0, 0), (1, 0), (2, 4), (18, 6)))


def size_of(r: Bits) -> tuple[int, int]:
    small = r.flag()
    side = lambda: (r.u(5) + 1) * 8 if small else r.pick(DIMENSION)
    height = side()
    ratio = RATIOS[r.u(3)]
    return (height * ratio[0] // ratio[1] if ratio else side()), height


def depth_of(r: Bits) -> tuple[int, bool]:
    floating = r.flag()
    bits = r.pick(((32, 0), (16, 0), (24, 0), (1, 6)) if floating else ((8, 0), (10, 0), (12, 0), (1, 6)))
    if floating:
        r.u(4)
    return bits, floating


def is_srgb(r: Bits) -> bool:
    """Whether a colour encoding is grey or RGB under sRGB's white, primaries and curve."""
    if r.flag():
        return True
    if r.flag():  # a profile follows
        return False
    space = r.kind()
    good = space in (0, 1)
    if space != 2:
        white = r.kind()
        good &= white == 1
        for _ in range(2 if white == 2 else 0):
            r.pick(CUSTOM)
    if space not in (1, 2):
        primaries = r.kind()
        good &= primaries == 1
        for _ in range(6 if primaries == 2 else 0):
            r.pick(CUSTOM)
    if r.flag():  # a power
        r.u(24)
        return False
    return good and r.kind() == 13


def header(codestream: bytes, limits: Limits = DEFAULTS) -> dict:
    """What a codestream's header tells; fields after what cannot be read are null."""
    r = Bits(codestream)
    if r.left < 16 or r.u(16) != 0x0AFF:
        raise bad("not a JPEG XL codestream")
    width, height = size_of(r)
    limits.pixels(width, height)
    out = {"width": width, "height": height, "orientation": 1, "animated": False, "depth": 8, "float": False, "alpha": False, "extra": [], "lossy": None, "srgb": None}
    try:
        if r.flag():  # all as usual
            return {**out, "lossy": True, "srgb": True}
        if r.flag():
            out["orientation"] = r.u(3) + 1
            if r.flag():
                size_of(r)
            if r.flag():  # a preview's size
                sides = ((16, 0), (32, 0), (1, 5), (33, 9)) if r.flag() else ((1, 6), (65, 8), (321, 10), (1345, 12))
                r.pick(sides)
                if not r.u(3):
                    r.pick(sides)
            if r.flag():
                out["animated"] = True
                r.pick(((100, 0), (1000, 0), (1, 10), (1, 30)))
                r.pick(((1, 0), (1001, 0), (1, 8), (1, 10)))
                out["loops"] = r.pick(((0, 0), (0, 3), (0, 16), (0, 32)))
                r.flag()
        out["depth"], out["float"] = depth_of(r)
        r.flag()
        for _ in range(r.pick(((0, 0), (1, 0), (2, 4), (1, 12)))):
            kind = 0
            if not r.flag():
                kind = r.kind()
                depth_of(r)
                r.pick(((0, 0), (3, 0), (4, 0), (1, 3)))
                r.u(8 * r.pick(((0, 0), (0, 4), (16, 5), (48, 10))))
                if kind == 0:
                    r.flag()
                elif kind == 2:
                    r.u(64)
                elif kind == 5:
                    r.pick(((1, 0), (0, 2), (3, 4), (19, 8)))
            if kind or out["alpha"]:  # the first alpha is no extra
                out["extra"].append(EXTRA[kind] if kind < len(EXTRA) else "unknown")
            out["alpha"] |= kind == 0
        out["lossy"], out["srgb"] = r.flag(), is_srgb(r)
    except ImageError:
        pass
    return out


def extra_note(head: dict) -> str | None:
    """What samples beyond colour and one alpha there are."""
    names = list(dict.fromkeys(head["extra"]))
    return f"extra channels ({len(head['extra'])}: {', '.join(names)})" if names else None


def reencoding_notes(head: dict) -> list[str]:
    """What decoding to samples and coding again would lose."""
    notes = ["lossy source: coded again without loss, it grows"] if head["lossy"] else []
    if head["depth"] > 8 or head["float"]:
        notes.append(f"{head['depth']}-bit samples")
    return notes + [n for n in [extra_note(head)] if n]


def has_jpeg(data: bytes, limits: Limits = DEFAULTS) -> bool:
    """Whether a JPEG can be rebuilt of it bit by bit."""
    return any(k == b"jbrd" for k, _ in read(data, limits)[0])


def is_lossy(data: bytes, limits: Limits = DEFAULTS) -> bool | None:
    return header(read(data, limits)[1], limits)["lossy"]


def exif_block(body: bytes) -> bytes:
    """The EXIF block of a box, which begins with how far it is off."""
    return body[4 + int.from_bytes(body[:4], "big") :]


def unwrapped(body: bytes) -> tuple[bytes, None]:
    """(type, data) of a box compressed with Brotli, which cannot be unpacked here."""
    return body[:4], None


def own_part(boxes: list[tuple[bytes, bytes]], kind: bytes) -> bytes | None:
    return next((d for k, d in boxes if k == kind), None)


def sanitized(boxes: list[tuple[bytes, bytes]], keep_thumbnails: bool = False) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """Metadata boxes without previews; rebuilding data go, as they no longer match."""
    from rasterloom.metadata.previews import without_exif_previews, without_xmp_previews

    out, gone = [], []
    for kind, body in boxes:
        if kind in STRUCTURE:
            continue
        if not keep_thumbnails and kind == b"Exif" and len(body) > 4 and (got := without_exif_previews(exif_block(body))) is not None:
            body = bytes(4) + got[0]
            gone += got[1]
        elif not keep_thumbnails and kind == b"xml " and (got := without_xmp_previews(body.decode("utf-8", "replace"))) is not None:
            gone += got[1]
            if got[0] is None:
                continue
            body = got[0].encode()
        elif not keep_thumbnails and kind == b"brob" and body[:4] in (b"Exif", b"xml "):
            gone.append(f"compressed {body[:4].decode('latin-1').strip()} box")
            continue
        out.append((kind, body))
    return out, list(dict.fromkeys(gone))


def info(data: bytes, limits: Limits = DEFAULTS) -> dict:
    from rasterloom.functions.params import read_marker
    from rasterloom.watermark.carried import carried_info

    boxes, codestream, container = read(data, limits)
    head = header(codestream, limits)
    body = own_part(boxes, MARKER)
    p = read_marker(body)[0] if body is not None else None
    jpeg = any(k == b"jbrd" for k, _ in boxes)
    return {
        **head, "container": container, "boxes": [(k.decode("latin-1"), len(d)) for k, d in boxes], "jpeg_data": jpeg, "scrambled": p is not None,
        "mode": p.mode if p else None, "watermark": carried_info(own_part(boxes, WATERMARK), limits), "metadata": [n for n, k in (("exif", b"Exif"), ("xmp", b"xml ")) if any(b == k for b, _ in boxes)],
    }
