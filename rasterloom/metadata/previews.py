"""Previews within metadata, which would show a scrambled picture: where they are, and blocks without them.

Each function gives None where there is nothing to take out.
"""

from __future__ import annotations

import re
import struct

from rasterloom.functions.errors import ImageError
from rasterloom.metadata import iptc
from rasterloom.metadata.xmp import Packet, XmpError
from rasterloom.sources import jpeg

# Properties that hold a preview's data, what extended XMP begins with.
XMP_DATA = {"xmp:Thumbnails", "GImage:Data", "GDepth:Data", "GDepth:Confidence"}
XMP_TEXT = re.compile(r"<[\w.-]+:Thumbnails[\s>]|[\s<]GImage:Data\b|[\s<]GDepth:Data\b")
XMP, EXTENDED = b"http://ns.adobe.com/xap/1.0/\0", b"http://ns.adobe.com/xmp/extension/\0"


class Walk:
    """Directories of a block by place, without a model, as far as they can be read."""

    def __init__(self, block: bytes):
        self.block, self.order = block, {b"I": "<", b"M": ">"}.get(block[:1], "")

    def u(self, form: str, at: int) -> int:
        size = struct.calcsize(form)
        return struct.unpack_from(self.order + form, self.block, at)[0] if self.order and 0 <= at <= len(self.block) - size else 0

    def entries(self, ifd: int) -> dict[int, int]:
        """Where each tag's entry is."""
        n = self.u("H", ifd) if ifd else 0
        places = [ifd + 2 + 12 * k for k in range(n)]
        return {self.u("H", e): e for e in reversed(places) if e + 12 <= len(self.block)}

    def values(self, e: int | None) -> list[int]:
        form = {3: "H", 4: "I"}.get(self.u("H", e + 2)) if e is not None else None
        if form is None:
            return []
        n, size = min(self.u("I", e + 4), 65536), struct.calcsize(form)
        at = e + 8 if n * size <= 4 else self.u("I", e + 8)
        return [self.u(form, at + size * k) for k in range(n) if at + size * (k + 1) <= len(self.block)]


def zeroed(block: bytes, stretches: list[tuple[int, int]]) -> bytes:
    out = bytearray(block)
    for a, b in stretches:
        a, b = min(a, len(out)), min(b, len(out))
        out[a:b] = bytes(max(0, b - a))
    return bytes(out)


def without_exif_thumbnail(block: bytes) -> bytes | None:
    """The second directory unlinked, and its data zeroed; no byte moves."""
    w = Walk(block)
    first = w.u("I", 4)
    link = first + 2 + 12 * w.u("H", first)
    second = w.u("I", link)
    if not w.order or not first or not second or second + 2 > len(block):
        return None
    own = w.entries(second)
    stretches = [(second, second + 2 + 12 * w.u("H", second) + 4)]
    for at, length in ((0x0201, 0x0202), (0x0111, 0x0117), (0x0144, 0x0145)):
        stretches += [(a, a + n) for a, n in zip(w.values(own.get(at)), w.values(own.get(length))) if n]
    out = bytearray(zeroed(block, stretches))
    out[link : link + 4] = bytes(4)
    return bytes(out)


def complete_jpeg_end(data: bytes, begin: int, end: int) -> int | None:
    """Where a JPEG file that begins at a place ends, if it has a frame, a scan and an end before `end`."""
    at, frame, scan = begin + 2, False, False
    while at + 2 <= end and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        elif kind == 0xD9:
            return at + 2 if frame and scan else None
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if kind in (0, 1) or 0xD0 <= kind <= 0xD8 or size < 2 or at + 2 + size > end:
                return None
            frame |= jpeg.is_sof(kind)
            at += 2 + size
            if kind == 0xDA:
                if not frame:
                    return None
                scan, at = True, min(end, jpeg.scan_end(data, at))
    return None


def without_maker_previews(block: bytes) -> bytes | None:
    """Whole JPEG files within the maker's data zeroed."""
    w = Walk(block)
    pointer = w.entries(w.u("I", 4)).get(0x8769)
    note = w.entries(w.u("I", pointer + 8)).get(0x927C) if pointer is not None else None
    size = w.u("I", note + 4) if note is not None else 0
    if size <= 4:
        return None
    at = w.u("I", note + 8)
    end, found = min(len(block), at + size), []
    while 0 <= (at := block.find(b"\xff\xd8\xff", at, end)):
        stop = complete_jpeg_end(block, at, end)
        if stop is not None:
            found.append((at, stop))
        at = stop if stop is not None else at + 1
    return zeroed(block, found) if found else None


def without_exif_previews(block: bytes) -> tuple[bytes, list[str]] | None:
    first = without_exif_thumbnail(block)
    second = without_maker_previews(first if first is not None else block)
    if first is None and second is None:
        return None
    return (second if second is not None else first), [name for name, x in (("EXIF thumbnail", first), ("MakerNote preview (zeroed)", second)) if x is not None]


def without_xmp_previews(text: str) -> tuple[str | None, list[str]] | None:
    """(text, what went); a packet that cannot be read but names a preview goes as a whole."""
    try:
        packet = Packet(text)
    except XmpError:
        return (None, ["XMP (not readable, and it names a preview)"]) if XMP_TEXT.search(text) else None
    gone = packet.remove(XMP_DATA.__contains__)
    return (str(packet), [f"XMP preview ({', '.join(dict.fromkeys(gone))})"]) if gone else None


def names_preview(text: str) -> bool:
    try:
        return any(name in XMP_DATA for name, _ in Packet(text).properties())
    except XmpError:
        return bool(XMP_TEXT.search(text))


def extended_with_previews(bodies: list[bytes]) -> set[int]:
    """Which segments of extended XMP belong to a packet that holds a preview: parts of one id, in the order of their offsets."""
    groups: dict[bytes, list[int]] = {}
    begin = len(EXTENDED)
    for i, b in enumerate(bodies):
        if len(b) >= begin + 40:
            groups.setdefault(b[begin : begin + 32], []).append(i)
    out: set[int] = set()
    for own in groups.values():
        parts = sorted((int.from_bytes(bodies[i][begin + 36 : begin + 40], "big"), bodies[i][begin + 40 :]) for i in own)
        if names_preview(b"".join(p for _, p in parts).decode("utf-8", "replace")):
            out.update(own)
    return out


def without_photoshop_thumbnails(bodies: list[bytes]) -> list[bytes] | None:
    """APP13 segments without thumbnails; where a resource goes on in the next segment, the rest is cut anew."""
    sign = len(iptc.SIGNATURE)

    def cleaned(payload: bytes) -> bytes | None:
        found, rest = iptc.resources(payload)
        if not any(r.id in iptc.THUMBNAILS for r in found):
            return None
        keep = [r.written() if r.whole else r.head + payload[payload.find(r.head) + len(r.head) :] for r in found if r.id not in iptc.THUMBNAILS]
        return payload[:sign] + b"".join(keep) + rest

    apart = len(bodies) < 2 or all(iptc.readable(b) is not None for b in bodies)
    if apart:
        new = [cleaned(b) if b.startswith(iptc.SIGNATURE) else None for b in bodies]
        return [n if n is not None else b for n, b in zip(new, bodies)] if any(n is not None for n in new) else None
    joined = cleaned(iptc.SIGNATURE + b"".join(b[sign:] for b in bodies))
    if joined is None:
        return None
    body, room = joined[sign:], 65533 - sign
    return [iptc.SIGNATURE + body[k : k + room] for k in range(0, len(body), room)]


def without_jfif_thumbnail(body: bytes) -> bytes | None:
    if not body.startswith(b"JFIF\0") or len(body) < 14 or (len(body) == 14 and not body[12] and not body[13]):
        return None
    return body[:12] + b"\0\0"


def sanitized_jpeg(data: bytes, keep_thumbnails: bool = False) -> tuple[bytes, list[str]]:
    """(file, what went). What follows the image always goes, and with it the index to it; entropy-coded data stay as they are."""
    segments, trailing = jpeg.parsed(data)
    gone: list[str] = []
    note = lambda what: gone.append(what) if what not in gone else None
    out: list[jpeg.Segment | None] = list(segments)
    photoshop = [i for i, s in enumerate(segments) if s.marker == 0xED and s.body.startswith(iptc.SIGNATURE)]
    extended = [i for i, s in enumerate(segments) if s.marker == 0xE1 and s.body.startswith(EXTENDED)]
    for i, s in enumerate(segments):
        body: bytes | None = s.body
        if s.marker == 0xE2 and s.body.startswith(b"MPF\0"):
            note("MPF index")
            body = None
        elif keep_thumbnails:
            continue
        elif s.marker == 0xE0 and s.body.startswith(b"JFXX\0"):
            note("JFXX thumbnail")
            body = None
        elif s.marker == 0xE0 and (new := without_jfif_thumbnail(s.body)) is not None:
            note("JFIF thumbnail")
            body = new
        elif s.marker == 0xE1 and s.body.startswith(b"Exif\0\0") and (got := without_exif_previews(s.body[6:])) is not None:
            body = s.body[:6] + got[0]
            for what in got[1]:
                note(what)
        elif s.marker == 0xE1 and s.body.startswith(XMP) and (got := without_xmp_previews(s.body[len(XMP) :].decode("utf-8", "replace"))) is not None:
            body = None if got[0] is None else XMP + got[0].encode()
            for what in got[1]:
                note(what)
        if body is not s.body:
            out[i] = None if body is None else jpeg.Segment(s.marker, body)
    if not keep_thumbnails:
        new = without_photoshop_thumbnails([segments[i].body for i in photoshop])
        if new is not None:
            note("Photoshop thumbnail")
            for k, i in enumerate(photoshop):
                out[i] = jpeg.Segment(0xED, new[k]) if k < len(new) else None
        hidden = extended_with_previews([segments[i].body for i in extended])
        if hidden:
            note(f"extended XMP ({len(hidden)} segments with a preview)")
            for k in hidden:
                out[extended[k]] = None
    if trailing:
        note(f"{len(trailing)} bytes after the image")
    return (jpeg.written([s for s in out if s is not None]), gone) if gone else (data, gone)


def sanitized_parts(parts: list[tuple[bytes, bytes]], most: float = 16 << 20) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """PNG chunks without previews in EXIF and XMP."""
    from rasterloom.metadata.text import XMP_KEYWORD, read_text

    out, gone = [], []
    for kind, body in parts:
        if kind == b"eXIf" and (got := without_exif_previews(body)) is not None:
            body = got[0]
            gone += got[1]
        elif kind in (b"tEXt", b"zTXt", b"iTXt"):
            try:
                text = read_text(kind, body, most)
            except ImageError:
                text = None
            if text and text[0] == XMP_KEYWORD and (got := without_xmp_previews(text[1])) is not None:
                gone += got[1]
                if got[0] is None:
                    continue
                kind, body = b"iTXt", XMP_KEYWORD.encode() + b"\0\0\0\0\0" + got[0].encode()
        out.append((kind, body))
    return out, gone
