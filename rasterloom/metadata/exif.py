"""EXIF blocks as a model: directories of entries, read, changed and written with all offsets made anew."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field, replace
from fractions import Fraction

from rasterloom.functions.errors import ImageError
from rasterloom.metadata.tags import NUMBER, TYPES, Tag, tag_by_name, tag_info, tag_name

# Tags that point to directories, to directories of previews, to data by offset and length; opaque data of the maker.
POINTERS = {"Exif": ("IFD0", 0x8769), "GPS": ("IFD0", 0x8825), "Interop": ("Exif", 0xA005)}
SUB_IFDS, MAKER_NOTE, ORIENTATION = 0x014A, 0x927C, 0x0112
OFFSETS = {0x0111: 0x0117, 0x0144: 0x0145, 0x0201: 0x0202}
VERSIONS = {("Exif", 0x9000), ("Exif", 0xA000), ("Interop", 0x0002)}
COMMENTS = {("Exif", 0x9286), ("GPS", 0x1B), ("GPS", 0x1C)}
WIDE_TEXT = (0x9C9B, 0x9C9C, 0x9C9D, 0x9C9E, 0x9C9F)
FIXED = {SUB_IFDS, MAKER_NOTE, 0x8773, 0x83BB, 0x02BC, 0xC634, 0xEA1C, *OFFSETS, *OFFSETS.values(), *(tag for _, tag in POINTERS.values())}
MOST_SUB_IFDS, MOST_STRIPS, MOST_SHOWN = 16, 4096, 32
FORMS = {"BYTE": "B", "SHORT": "H", "LONG": "I", "SBYTE": "b", "SSHORT": "h", "SLONG": "i", "FLOAT": "f", "DOUBLE": "d", "IFD": "I"}


def bad(message: str) -> ImageError:
    return ImageError("BAD_EXIF", f"EXIF cannot be read: {message}")


@dataclass(frozen=True)
class Entry:
    tag: int
    type: int
    count: int
    data: bytes
    blobs: tuple[bytes, ...] | None = None  # what an offset tag points to


@dataclass
class Exif:
    order: str = "<"
    ifds: dict[str, list[Entry]] = field(default_factory=lambda: {"IFD0": []})
    maker_note_at: int | None = None
    warnings: list[str] = field(default_factory=list)

    def __len__(self) -> int:
        return sum(map(len, self.ifds.values()))


class Reader:
    def __init__(self, block: bytes):
        if len(block) < 8 or block[:4] not in (b"II*\0", b"MM\0*"):
            raise bad("no header")
        self.block, self.out = block, Exif("<" if block[:1] == b"I" else ">", {})
        self.seen: set[int] = set()

    def number(self, form: str, at: int) -> int:
        return struct.unpack_from(self.out.order + form, self.block, at)[0]

    def directory(self, at: int, name: str) -> tuple[list[Entry], int] | None:
        """(entries, where the next one begins). What lies outside the block is left out with a warning."""
        warn, size = self.out.warnings, len(self.block)
        if at in self.seen or not 8 <= at <= size - 2:
            warn.append(f"{name} {'is a loop' if at in self.seen else 'lies outside'}")
            return None
        self.seen.add(at)
        n = self.number("H", at)
        if at + 2 + 12 * n > size:
            n = (size - at - 2) // 12
            warn.append(f"{name} is cut")
        found: dict[int, Entry] = {}
        for e in range(at + 2, at + 2 + 12 * n, 12):
            tag, kind, count = self.number("H", e), self.number("H", e + 2), self.number("I", e + 4)
            if kind not in TYPES:
                warn.append(f"{name} {tag_name(name, tag)}: unknown type {kind}")
                continue
            length = TYPES[kind][1] * count
            place = e + 8 if length <= 4 else self.number("I", e + 8)
            if place + length > size:
                warn.append(f"{name} {tag_name(name, tag)}: value outside")
            elif tag in found:
                warn.append(f"{name} {tag_name(name, tag)}: there twice")
            else:
                if tag == MAKER_NOTE and name == "Exif" and length > 4:
                    self.out.maker_note_at = place
                found[tag] = Entry(tag, kind, count, self.block[place : place + length])
        end = at + 2 + 12 * n
        return list(found.values()), self.number("I", end) if end + 4 <= size else 0

    def values(self, e: Entry) -> list[int] | None:
        form = {3: "H", 4: "I", 13: "I"}.get(e.type)
        return list(struct.unpack(f"{self.out.order}{e.count}{form}", e.data)) if form else None

    def with_data(self, entries: list[Entry], name: str) -> list[Entry]:
        """Offset tags take what they point to; those that point outside go, with their lengths."""
        own = {e.tag: e for e in entries}
        for at, length in OFFSETS.items():
            a, n = own.get(at), own.get(length)
            if a is None and n is None:
                continue
            places = list(zip(self.values(a) or [], self.values(n) or [])) if a and n and a.count == n.count <= MOST_STRIPS else []
            if places and all(p + k <= len(self.block) for p, k in places):
                own[at] = replace(a, blobs=tuple(self.block[p : p + k] for p, k in places))
            else:
                self.out.warnings.append(f"{name} {tag_name(name, at)}: data outside")
                own.pop(at, None)
                own.pop(length, None)
        return list(own.values())

    def read(self) -> Exif:
        out = self.out
        got = self.directory(self.number("I", 4), "IFD0")
        if got is None:
            raise bad("IFD0 lies outside")
        out.ifds["IFD0"], following = got
        for name, (home, tag) in POINTERS.items():
            pointer = next((e for e in out.ifds.get(home, []) if e.tag == tag), None)
            if pointer is None:
                continue
            out.ifds[home].remove(pointer)
            to = self.values(pointer)
            if not to or len(to) != 1:
                out.warnings.append(f"the pointer to {name} is no offset")
            elif (got := self.directory(to[0], name)) is not None:
                out.ifds[name] = got[0]
        subs = next((e for e in out.ifds["IFD0"] if e.tag == SUB_IFDS), None)
        if subs is not None:
            out.ifds["IFD0"].remove(subs)
            if subs.count > MOST_SUB_IFDS:
                out.warnings.append(f"more than {MOST_SUB_IFDS} sub-directories")
            for k, at in enumerate((self.values(subs) or [])[:MOST_SUB_IFDS]):
                if (got := self.directory(at, f"SubIFD{k}")) is not None:
                    out.ifds[f"SubIFD{k}"] = got[0]
        if following and (got := self.directory(following, "IFD1")) is not None:
            out.ifds["IFD1"] = got[0]
            if got[1]:
                out.warnings.append("directories after IFD1 are left out")
        for name in out.ifds:
            out.ifds[name] = self.with_data(out.ifds[name], name)
        return out


def parsed(block: bytes) -> Exif:
    return Reader(block).read()


def in_order(e: Entry, old: str, new: str) -> bytes:
    """An entry's data in another byte order; the maker's data are nobody else's."""
    unit = 4 if TYPES[e.type][0] in ("RATIONAL", "SRATIONAL") else TYPES[e.type][1]
    if old == new or unit == 1 or e.tag == MAKER_NOTE:
        return e.data
    return b"".join(e.data[k : k + unit][::-1] for k in range(0, len(e.data), unit))


def written(exif: Exif, order: str | None = None) -> tuple[bytes, list[str]]:
    """(block, notes). Directories first to last, each followed by its values and data; the maker's data go to where they were, if there is room."""
    order, notes = order or exif.order, []
    some = {name: entries for name, entries in exif.ifds.items() if entries}
    if "Interop" in some:
        some.setdefault("Exif", [])
    subs = [n for n in some if n.startswith("SubIFD")]
    names = ["IFD0", *(n for n in ("Exif", "Interop", "GPS") if n in some), *subs, *(["IFD1"] if "IFD1" in some else [])]
    rows: dict[str, list] = {}
    for name in names:
        own: list = [(e.tag, e.type, e.count, in_order(e, exif.order, order), e.blobs, None) for e in some.get(name, [])]
        own += [(tag, 4, 1, b"", None, [to]) for to, (home, tag) in POINTERS.items() if home == name and to in names]
        if name == "IFD0" and subs:
            own.append((SUB_IFDS, 4, len(subs), b"", None, subs))
        rows[name] = sorted(own, key=lambda r: r[0])
    size = lambda r: 4 * r[2] if r[4] is not None or r[5] else len(r[3])
    pinned, note = exif.maker_note_at, next((r for r in rows.get("Exif", []) if r[0] == MAKER_NOTE and len(r[3]) > 4), None)
    at, note_at, places = 8, None, {}

    def room(n: int) -> int:
        """A place for n bytes; the maker's data are put in as soon as the next thing would cover their old place."""
        nonlocal at, note_at
        if note is not None and note_at is None and pinned is not None and at <= pinned < at + n and pinned - at < 1 << 20:
            note_at, at = pinned, pinned + len(note[3]) + len(note[3]) % 2
        place, at = at, at + n + n % 2
        return place

    for name in names:
        places[name] = room(2 + 12 * len(rows[name]) + 4)
        for k, r in enumerate(rows[name]):
            if r is not note and size(r) > 4:
                places[name, k] = room(size(r))
        for k, r in enumerate(rows[name]):
            if r[4] is not None:
                places[name, k, "data"] = [room(len(b)) for b in r[4]]
    if note is not None and note_at is None:
        if pinned is not None and at <= pinned < at + (1 << 20):
            at = pinned
        elif pinned is not None and pinned != at:
            notes.append("the maker's data have moved; offsets within them may no longer hold")
        note_at, at = at, at + len(note[3]) + len(note[3]) % 2
    out = bytearray(at)
    out[:8] = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", places["IFD0"])
    for name in names:
        begin = places[name]
        struct.pack_into(order + "H", out, begin, len(rows[name]))
        for k, r in enumerate(rows[name]):
            tag, kind, count, data, blobs, to = r
            if to:
                data = struct.pack(f"{order}{len(to)}I", *(places[n] for n in to))
            elif blobs is not None:
                kind, data = 4, struct.pack(f"{order}{count}I", *places[name, k, "data"])
                for place, blob in zip(places[name, k, "data"], blobs):
                    out[place : place + len(blob)] = blob
            struct.pack_into(order + "HHI", out, begin + 2 + 12 * k, tag, kind, count)
            if len(data) > 4:
                place = note_at if r is note else places[name, k]
                struct.pack_into(order + "I", out, begin + 10 + 12 * k, place)
                out[place : place + len(data)] = data
            else:
                out[begin + 10 + 12 * k : begin + 10 + 12 * k + len(data)] = data
        following = places["IFD1"] if name == "IFD0" and "IFD1" in places else 0
        struct.pack_into(order + "I", out, begin + 2 + 12 * len(rows[name]), following)
    return bytes(out), notes


# ---- values


def plain_text(data: bytes) -> str:
    return re.sub("\0+", " / ", data.rstrip(b"\0").decode("utf-8", "replace"))


def shown(ifd: str, e: Entry, order: str):
    """A value for people: text, a number, or a list of numbers of which the first 32 are there."""
    kind = TYPES[e.type][0]
    if kind in ("ASCII", "UTF-8"):
        return plain_text(e.data)
    if e.tag in WIDE_TEXT and ifd in ("IFD0", "IFD1") and kind in ("BYTE", "UNDEFINED"):
        return e.data[: len(e.data) // 2 * 2].decode("utf-16-le", "replace").rstrip("\0")
    if kind == "UNDEFINED":
        if (ifd, e.tag) in VERSIONS and e.count == 4:
            return e.data.decode("latin-1")
        if (ifd, e.tag) in COMMENTS:
            code, body = e.data[:8].rstrip(b"\0"), e.data[8:]
            if code == b"UNICODE":
                return body[: len(body) // 2 * 2].decode("utf-16-le" if order == "<" else "utf-16-be", "replace").rstrip("\0")
            return plain_text(body).strip()
        return {"bytes": len(e.data)}
    n = min(e.count, MOST_SHOWN)
    if kind in ("RATIONAL", "SRATIONAL"):
        numbers = struct.unpack_from(f"{order}{2 * n}{'i' if kind[0] == 'S' else 'I'}", e.data)
        values = [float(f"{a / b:.8g}") if b else (float("inf") if a else 0) for a, b in zip(numbers[::2], numbers[1::2])]
        values = [int(v) if v == v // 1 and abs(v) < 1 << 53 else v for v in values]
    else:
        values = list(struct.unpack_from(f"{order}{n}{FORMS[kind]}", e.data))
    if e.count > MOST_SHOWN:
        values.append("…")
    return values[0] if len(values) == 1 else values


def orientation(exif: Exif) -> int:
    e = next((x for x in exif.ifds.get("IFD0", []) if x.tag == ORIENTATION), None)
    value = shown("IFD0", e, exif.order) if e and e.type == 3 and e.count else 1
    value = value[0] if isinstance(value, list) else value
    return value if value in range(1, 9) else 1


def refused(what: str) -> ImageError:
    return ImageError("BAD_METADATA", what)


def settable(name: str) -> Tag:
    info = tag_by_name(name)
    if info is None:
        raise refused(f"no EXIF tag {name!r}")
    if info.tag in FIXED or info.ifd == "Interop" or info.type not in ("ASCII", "SHORT", "LONG", "RATIONAL", "SRATIONAL", "BYTE", "UNDEFINED"):
        raise refused(f"EXIF {info.name} cannot be set")
    return info


def best_fraction(value, signed: bool) -> tuple[int, int] | None:
    """A number, or a text n/d, as two whole numbers; of others than whole numbers the last convergent with a denominator of at most a million."""
    most = (1 << 31) - 1 if signed else (1 << 32) - 1
    if isinstance(value, str):
        parts = re.fullmatch(r"\s*(-?\d+)/(\d+)\s*", value)
        if not parts:
            return None
        n, d = int(parts[1]), int(parts[2])
        return (n, d) if 0 < d <= most and abs(n) <= most and (signed or n >= 0) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or abs(value) > most or (value < 0 and not signed):
        return None
    if value == int(value):
        return int(value), 1
    rest, before, now = abs(float(value)), (0, 1), (1, 0)
    for _ in range(32):
        whole = int(rest)
        following = (whole * now[0] + before[0], whole * now[1] + before[1])
        if following[1] > 1_000_000 or following[0] > most:
            break
        before, now = now, following
        if rest - whole < 1e-12:
            break
        rest = 1 / (rest - whole)
    exact = Fraction(*now)
    return (-now[0] if value < 0 else now[0]), exact.denominator if now[1] else 1


def encoded(info: Tag, value, order: str) -> Entry:
    """An entry of a value, checked."""
    no = lambda why: refused(f"EXIF {info.name}: {why}")
    values = value if isinstance(value, list) else [value]
    wide = info.tag in WIDE_TEXT and info.ifd == "IFD0"
    if info.count and info.type not in ("ASCII", "UNDEFINED") and not wide and len(values) != info.count:
        raise no(f"needs {info.count} values")
    if info.type in ("ASCII", "UNDEFINED") or wide:
        if not isinstance(value, str):
            raise no("has to be text")
    if wide:
        data = value.encode("utf-16-le", "surrogatepass") + b"\0\0"
        return Entry(info.tag, NUMBER["BYTE"], len(data), data)
    if info.type == "ASCII":
        if info.name in ("DateTime", "DateTimeOriginal", "DateTimeDigitized") and not re.fullmatch(r"\d{4}:\d\d:\d\d \d\d:\d\d:\d\d", value):
            raise no("has to be of the form 2024:01:31 12:00:00")
        if "\0" in value:
            raise no("must not hold null characters")
        data = value.encode("utf-8", "replace") + b"\0"
        return Entry(info.tag, NUMBER["ASCII"], len(data), data)
    if info.type == "UNDEFINED":
        if (info.ifd, info.tag) in VERSIONS:
            if not re.fullmatch(r"\d{4}", value):
                raise no("has to be four digits")
            return Entry(info.tag, NUMBER["UNDEFINED"], 4, value.encode())
        if re.fullmatch(r"[\x20-\x7e\n\t]*", value):
            data = b"ASCII\0\0\0" + value.encode()
        else:
            data = b"UNICODE\0" + value.encode("utf-16-le" if order == "<" else "utf-16-be", "surrogatepass")
        return Entry(info.tag, NUMBER["UNDEFINED"], len(data), data)
    if info.type in ("RATIONAL", "SRATIONAL"):
        pairs = [best_fraction(v, info.type == "SRATIONAL") for v in values]
        if not pairs or None in pairs:
            raise no("has to be numbers or fractions n/d" + ("" if info.type == "SRATIONAL" else ", none negative"))
        data = struct.pack(f"{order}{2 * len(pairs)}{'i' if info.type == 'SRATIONAL' else 'I'}", *(x for p in pairs for x in p))
        return Entry(info.tag, NUMBER[info.type], len(pairs), data)
    most = 256 ** TYPES[NUMBER[info.type]][1] - 1
    if not values or any(isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= most for v in values):
        raise no(f"has to be whole numbers from 0 to {most}")
    if info.tag == ORIENTATION and values[0] not in range(1, 9):
        raise no("has to be from 1 to 8")
    return Entry(info.tag, NUMBER[info.type], len(values), struct.pack(f"{order}{len(values)}{FORMS[info.type]}", *values))


def with_orientation(block: bytes | None, value: int) -> bytes | None:
    """A block that says how a picture is shown; none is needed for one that is shown as stored."""
    if block is None:
        if value == 1:
            return None
        return written(Exif("<", {"IFD0": [encoded(tag_info("IFD0", ORIENTATION), value, "<")]}))[0]
    try:
        exif = parsed(block)
    except ImageError:
        return with_orientation(None, value)
    if orientation(exif) == value:
        return block
    exif.ifds["IFD0"] = [*(e for e in exif.ifds["IFD0"] if e.tag != ORIENTATION), encoded(tag_info("IFD0", ORIENTATION), value, exif.order)]
    return written(exif)[0]


def info(block: bytes) -> dict:
    """What a block holds, for people: order, tags, size of the thumbnail, warnings; or why it cannot be read."""
    try:
        exif = parsed(block)
    except ImageError as e:
        return {"bytes": len(block), "error": str(e), "orientation": 1}
    rows = []
    for ifd, entries in exif.ifds.items():
        for e in entries:
            value = {"bytes": sum(map(len, e.blobs))} if e.blobs is not None else shown(ifd, e, exif.order)
            rows.append({"ifd": ifd, "tag": f"0x{e.tag:04x}", "name": tag_name(ifd, e.tag), "type": TYPES[e.type][0], "value": value})
    thumbnail = next((len(e.blobs[0]) for e in exif.ifds.get("IFD1", []) if e.tag == 0x0201 and e.blobs), None)
    return {"byte_order": "II" if exif.order == "<" else "MM", "bytes": len(block), "tags": rows, "thumbnail": thumbnail, "warnings": exif.warnings, "orientation": orientation(exif)}
