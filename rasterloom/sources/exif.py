"""EXIF blocks (TIFF directories) and the segments of JPEG files, as rows."""

from __future__ import annotations

import struct

from rasterloom.functions.errors import ImageError
from rasterloom.sources import jpeg

# Fixed values of the formats: bytes of each value type, tags that point to other directories.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
POINTERS = {0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}
LETTERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}


def tags(block: bytes) -> list[dict]:
    """ifd, ord, tag, type, count and raw data of each entry. Cut entries and loops end their directory."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(block[:4])
    if order is None or len(block) < 8:
        raise ImageError("CORRUPT", "not an EXIF block")
    u16, u32 = (lambda at: struct.unpack_from(order + "H", block, at)[0]), (lambda at: struct.unpack_from(order + "I", block, at)[0])
    todo, seen, out = [("ifd0", u32(4))], set(), []
    while todo:
        name, at = todo.pop(0)
        if at in seen or not 8 <= at <= len(block) - 2:
            continue
        seen.add(at)
        n = u16(at)
        for i in range(min(n, (len(block) - at - 2) // 12)):
            entry = at + 2 + 12 * i
            tag, kind, count = u16(entry), u16(entry + 2), u32(entry + 4)
            size = TYPE_BYTES.get(kind, 0) * count
            place = entry + 8 if size <= 4 else u32(entry + 8)
            if not size or place + size > len(block):
                continue
            if tag in POINTERS and kind in (4, 13):
                todo.append((POINTERS[tag], u32(entry + 8)))
            out.append({"ifd": name, "ord": i, "tag": tag, "type": kind, "count": count, "data": block[place : place + size], "text": shown(kind, block[place : place + size], order)})
        end = at + 2 + 12 * n
        if name == "ifd0" and end + 4 <= len(block):
            todo.append(("ifd1", u32(end)))
    return out


def shown(kind: int, data: bytes, order: str) -> str:
    """A value as text: strings to their first zero byte, numbers and n/d rationals by commas, the rest as hex."""
    if kind == 2:
        return data.split(b"\0")[0].decode("utf-8", "replace")
    if kind in (5, 10):
        pairs = struct.unpack(f"{order}{len(data) // 4}{'Ii'[kind == 10]}", data)
        return ",".join(f"{n}/{d}" for n, d in zip(pairs[::2], pairs[1::2]))
    if kind in LETTERS:
        return ",".join(map(str, struct.unpack(f"{order}{len(data) // TYPE_BYTES[kind]}{LETTERS[kind]}", data)))
    return data.hex()


def block_of(entries: list[tuple[str, int, int, bytes]], order: str = "<") -> bytes:
    """An EXIF block of (ifd, tag, type, data) with data in its byte order; pointers are added."""
    names = [n for n in ("ifd0", "exif", "gps", "interop") if n == "ifd0" or any(e[0] == n for e in entries)]
    home = {"exif": "ifd0", "gps": "ifd0", "interop": "exif"}
    if "interop" in names and "exif" not in names:
        names.insert(1, "exif")
    to = {v: k for k, v in POINTERS.items()}
    dirs = {n: sorted([e[1:] for e in entries if e[0] == n] + [(to[c], 4, None) for c in names[1:] if home[c] == n], key=lambda e: e[0]) for n in names}
    places, at = {}, 8
    for n, own in dirs.items():
        places[n] = at
        at += 6 + 12 * len(own)
    heads, tail = [], b""
    for own in dirs.values():
        head = struct.pack(order + "H", len(own))
        for tag, kind, data in own:
            if data is None:
                data = struct.pack(order + "I", places[POINTERS[tag]])
            head += struct.pack(order + "HHI", tag, kind, len(data) // TYPE_BYTES[kind])
            if len(data) <= 4:
                head += data.ljust(4, b"\0")
            else:
                head += struct.pack(order + "I", at + len(tail))
                tail += data + b"\0" * (len(data) % 2)
        heads.append(head + bytes(4))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + b"".join(heads) + tail


def orientation(found: list[dict]) -> int:
    """1 to 8; 1 where there is none or another value."""
    value = next((t["text"] for t in found if t["ifd"] == "ifd0" and t["tag"] == 0x0112), "1")
    return int(value) if value in "12345678" and len(value) == 1 else 1


def quick_orientation(block: bytes) -> int:
    """orientation() from the first directory alone; 1 where it cannot be read."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    try:
        (at,) = struct.unpack_from(order + "I", block, 4)
        for k in range(struct.unpack_from(order + "H", block, at)[0]):
            tag, kind, count, value = struct.unpack_from(order + "HHIH", block, at + 2 + 12 * k)
            if tag == 0x0112:
                return value if kind == 3 and count and 1 <= value <= 8 else 1
    except (struct.error, TypeError):
        pass
    return 1


def segments(data: bytes) -> list[dict]:
    """ord, marker, length, data of each JPEG segment, and the entropy-coded bytes that follow a scan's head."""
    return [{"ord": i, "marker": s.marker, "length": len(s.body), "coded": len(s.coded), "data": s.body} for i, s in enumerate(jpeg.parsed(data)[0])]
