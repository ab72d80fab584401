"""Photoshop's resources in a JPEG's APP13 segments, and the IPTC datasets in one of them."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

from rasterloom.metadata.text import latin

# What a segment begins with, resource numbers, names of the second record's datasets.
SIGNATURE, IPTC, DIGEST, THUMBNAILS = b"Photoshop 3.0\0", 0x0404, 0x0425, (0x0409, 0x040C)
COPIES = {0x0422: "EXIF copy", 0x0423: "EXIF copy", 0x0424: "XMP copy"}
DATASETS = {
    0: "RecordVersion", 3: "ObjectTypeReference", 4: "ObjectAttributeReference", 5: "ObjectName", 7: "EditStatus",
    10: "Urgency", 12: "SubjectReference", 15: "Category", 20: "SupplementalCategories", 22: "FixtureIdentifier",
    25: "Keywords", 26: "ContentLocationCode", 27: "ContentLocationName", 30: "ReleaseDate", 35: "ReleaseTime",
    37: "ExpirationDate", 38: "ExpirationTime", 40: "SpecialInstructions", 42: "ActionAdvised", 45: "ReferenceService",
    47: "ReferenceDate", 50: "ReferenceNumber", 55: "DateCreated", 60: "TimeCreated", 62: "DigitalCreationDate",
    63: "DigitalCreationTime", 65: "OriginatingProgram", 70: "ProgramVersion", 75: "ObjectCycle", 80: "By-line",
    85: "By-lineTitle", 90: "City", 92: "Sub-location", 95: "Province-State", 100: "Country-PrimaryLocationCode",
    101: "Country-PrimaryLocationName", 103: "OriginalTransmissionReference", 105: "Headline", 110: "Credit",
    115: "Source", 116: "CopyrightNotice", 118: "Contact", 120: "Caption-Abstract", 121: "LocalCaption",
    122: "Writer-Editor", 130: "ImageType", 131: "ImageOrientation", 135: "LanguageIdentifier",
}
NUMBERS = {name.lower(): number for number, name in DATASETS.items()}
UTF8, SHOWN = b"\x1b%G", 2000


def dataset_number(name: str) -> int | None:
    return NUMBERS.get(str(name).lower())


@dataclass(frozen=True)
class Resource:
    id: int
    head: bytes  # up to its length
    data: bytes
    whole: bool = True

    def written(self) -> bytes:
        return self.head + struct.pack(">I", len(self.data)) + self.data + b"\0" * (len(self.data) % 2)


def resources(payload: bytes, at: int = len(SIGNATURE)) -> tuple[list[Resource], bytes]:
    """(resources, what cannot be read of the rest). The last one may be cut."""
    out: list[Resource] = []
    while payload[at : at + 4] == b"8BIM" and at + 12 <= len(payload):
        name = payload[at + 6]
        begin = at + 7 + name + (name + 1) % 2
        if begin + 4 > len(payload):
            break
        size = int.from_bytes(payload[begin : begin + 4], "big")
        end = begin + 4 + size
        out.append(Resource(int.from_bytes(payload[at + 4 : at + 6], "big"), payload[at:begin], payload[begin + 4 : end], end <= len(payload)))
        if end > len(payload):
            return out, b""
        at = min(len(payload), end + size % 2)
    return out, payload[at:]


def readable(payload: bytes) -> list[Resource] | None:
    """All resources of a segment; None where some cannot be read."""
    if not payload.startswith(SIGNATURE):
        return None
    found, rest = resources(payload)
    return found if not rest and all(r.whole for r in found) else None


@dataclass(frozen=True)
class Dataset:
    record: int
    number: int
    value: bytes

    @property
    def name(self) -> str:
        return DATASETS.get(self.number, f"2:{self.number}") if self.record == 2 else f"{self.record}:{self.number}"

    def written(self) -> bytes:
        n = len(self.value)
        return bytes([0x1C, self.record, self.number]) + (struct.pack(">H", n) if n < 0x8000 else struct.pack(">HI", 0x8004, n)) + self.value


def datasets(data: bytes) -> list[Dataset] | None:
    """None where they are malformed."""
    out, at = [], 0
    while at < len(data) and data[at]:
        if data[at] != 0x1C or at + 5 > len(data):
            return None
        n, begin = int.from_bytes(data[at + 3 : at + 5], "big"), at + 5
        if n & 0x8000:  # a longer length follows
            wide = n & 0x7FFF
            if wide > 4 or begin + wide > len(data):
                return None
            n, begin = int.from_bytes(data[begin : begin + wide], "big"), begin + wide
        if begin + n > len(data):
            return None
        out.append(Dataset(data[at + 1], data[at + 2], data[begin : begin + n]))
        at = begin + n
    return out


def is_utf8(found: list[Dataset]) -> bool:
    return any(d.record == 1 and d.number == 90 and d.value == UTF8 for d in found)


def listed(payload: bytes) -> list[dict] | None:
    """name and value of the second record's datasets."""
    own = next((r for r in readable(payload) or [] if r.id == IPTC), None)
    found = datasets(own.data) if own else None
    if found is None:
        return None
    text = (lambda v: v.decode("utf-8", "replace")) if is_utf8(found) else latin
    return [{"name": d.name, "value": text(d.value)[:SHOWN]} for d in found if d.record == 2 and d.number]


def edited(payload: bytes, goes: Callable[[str], bool], put: dict[str, str] | None = None) -> tuple[bytes, list[str], list[str]] | None:
    """(payload, names that went, names that were set): datasets that are there get other texts. None where it cannot be read."""
    parts = readable(payload)
    if parts is None:
        return None
    own = next((r for r in parts if r.id == IPTC), None)
    if own is None:
        return payload, [], []
    found = datasets(own.data)
    if found is None:
        return None
    code = "utf-8" if is_utf8(found) else "latin-1"
    new = {k.lower(): v for k, v in (put or {}).items()}
    kept, gone, done = [], [], []
    for d in found:
        if d.record == 2 and goes(d.name):
            gone.append(d.name)
        elif d.record == 2 and d.name.lower() in new:
            if d.name not in done:
                kept.append(Dataset(2, d.number, new[d.name.lower()].encode(code, "replace")[:32767]))
                done.append(d.name)
        else:
            kept.append(d)
    if not gone and not done:
        return payload, [], []
    data = b"".join(d.written() for d in kept)
    # the digest of the datasets no longer holds
    out = b"".join(Resource(r.id, r.head, data if r is own else r.data).written() for r in parts if r.id != DIGEST)
    return SIGNATURE + out, gone, done


def without(payload: bytes, numbers) -> tuple[bytes, list[int]] | None:
    """(payload without resources of some numbers, those that were there); None where it cannot be read."""
    parts = readable(payload)
    if parts is None:
        return None
    gone = [r.id for r in parts if r.id in numbers]
    return (SIGNATURE + b"".join(r.written() for r in parts if r.id not in numbers) if gone else payload), gone
