"""Metadata policies: what is kept, stripped by kind, removed by group or pattern, and set.

A policy is resolved once, on the driver. Why a name goes is a function of names only, so that it can be
asked of a table of names as well as of a file.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from rasterloom.functions.errors import ImageError
from rasterloom.metadata import exif, xmp
from rasterloom.metadata.tags import IFDS, Tag
from rasterloom.metadata.text import is_keyword

# Kinds, groups, presets, and what each group holds; names are patterns with * and ?.
KINDS = ("exif", "xmp", "icc", "colour", "text", "density", "orientation", "other")
GROUPS = ("gps", "serials", "makernote", "owner", "timestamps", "history", "thumbnail", "c2pa")
BARE = ("exif", "xmp", "text", "density", "other")
PRESETS = {"keep": ((), ()), "strip-all": (BARE, ()), "privacy": ((), GROUPS), "web": (BARE, ())}
EXIF_TAGS = {
    "serials": (0xA431, 0xA435, 0xC62F), "makernote": (0x927C, 0xC634), "owner": (0x013B, 0xA430, 0x9C9D, 0x013C, 0xA437, 0xA438),
    "timestamps": (0x0132, 0x9003, 0x9004, 0x9010, 0x9011, 0x9012, 0x9290, 0x9291, 0x9292), "history": (0xA420,),
}
EXIF_IFDS = {"gps": "GPS", "thumbnail": "IFD1"}
GPS_TAGS = {"timestamps": (0x07, 0x1D)}
NAMES = {
    "xmp": {
        "gps": ("exif:GPS*", "photoshop:City", "photoshop:State", "photoshop:Country", "Iptc4xmpCore:Location", "Iptc4xmpCore:CountryCode", "Iptc4xmpExt:LocationCreated", "Iptc4xmpExt:LocationShown"),
        "serials": ("aux:SerialNumber", "aux:LensSerialNumber", "aux:ImageNumber", "exifEX:BodySerialNumber", "exifEX:LensSerialNumber"),
        "owner": (
            "dc:creator", "dc:contributor", "photoshop:AuthorsPosition", "photoshop:CaptionWriter", "aux:OwnerName", "exifEX:CameraOwnerName", "exifEX:Photographer",
            "exifEX:ImageEditor", "xmpRights:Owner", "Iptc4xmpCore:CreatorContactInfo", "tiff:Artist", "plus:ImageCreator", "plus:CopyrightOwner",
        ),
        "timestamps": ("xmp:CreateDate", "xmp:ModifyDate", "xmp:MetadataDate", "photoshop:DateCreated", "exif:DateTimeOriginal", "exif:DateTimeDigitized", "tiff:DateTime", "dc:date"),
        "history": ("xmpMM:*", "photoshop:DocumentAncestors", "exif:ImageUniqueID"),
        "thumbnail": ("xmp:Thumbnails", "GImage:*", "GDepth:*"),
    },
    "iptc": {
        "gps": ("City", "Sub-location", "Province-State", "Country-PrimaryLocationCode", "Country-PrimaryLocationName", "ContentLocationCode", "ContentLocationName"),
        "owner": ("By-line", "By-lineTitle", "Contact", "Writer-Editor"),
        "timestamps": ("DateCreated", "TimeCreated", "DigitalCreationDate", "DigitalCreationTime"),
        "history": ("OriginalTransmissionReference",),
    },
    "text": {"owner": ("Author",), "timestamps": ("Creation Time", "date:*")},
    "other": {"timestamps": ("tIME",), "c2pa": ("caBX", "APP11", "jumb")},
}
# Where the fields that go to several places are put.
COMMON = {
    "artist": {"exif": "Artist", "xmp": "dc:creator", "text": "Author", "iptc": "By-line"},
    "copyright": {"exif": "Copyright", "xmp": "dc:rights", "text": "Copyright", "iptc": "CopyrightNotice"},
    "title": {"exif": "ImageTitle", "xmp": "dc:title", "text": "Title", "iptc": "ObjectName"},
    "description": {"exif": "ImageDescription", "xmp": "dc:description", "text": "Description", "iptc": "Caption-Abstract"},
    "software": {"exif": "Software", "xmp": "xmp:CreatorTool", "text": "Software"},
}
FIELDS = ("id", "name", "description", "preset", "keep", "strip", "remove", "set")
SET_FIELDS = (*COMMON, "comment", "orientation", "icc", "exif", "xmp", "xmpPacket", "text")
PROFILE_ID = r"[a-z0-9](?:[a-z0-9-]{0,46}[a-z0-9])?"


def refuse(why: str):
    raise ImageError("BAD_METADATA", f"metadata policy: {why}")


def pattern(text: str) -> re.Pattern:
    """A name with * and ? as an expression for the whole of a name, in either case."""
    return re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in text), re.I | re.S)


GROUP_PATTERNS = {kind: {g: [pattern(n) for n in names] for g, names in groups.items()} for kind, groups in NAMES.items()}


@dataclass(frozen=True)
class Removal:
    kind: str
    source: str
    names: re.Pattern
    ifd: str | None = None


@dataclass
class Put:
    """What a policy sets. None as a value takes a field away."""

    common: dict[str, str] = field(default_factory=dict)
    exif: list[tuple[Tag, object]] = field(default_factory=list)
    xmp: dict[str, object] = field(default_factory=dict)
    text: dict[str, str | None] = field(default_factory=dict)
    comments: list[str] | None = None
    packet: str | None = None
    icc: bool = False
    orientation: int | None = None

    def to(self, kind: str) -> dict[str, str]:
        """The common fields under their names in a kind."""
        return {COMMON[k][kind]: v for k, v in self.common.items() if kind in COMMON[k]}


@dataclass
class Policy:
    name: str
    preset: str
    stripped: frozenset[str]
    drop_srgb: bool
    groups: tuple[str, ...]
    removals: tuple[Removal, ...]
    put: Put

    @property
    def idle(self) -> bool:
        return not (self.stripped or self.drop_srgb or self.groups or self.removals) and self.put == Put()

    def exif_reason(self, ifd: str, tag: int, name: str) -> str | None:
        """Why an EXIF tag goes; null where it stays."""
        for g in self.groups:
            own = GPS_TAGS if ifd == "GPS" else EXIF_TAGS
            if EXIF_IFDS.get(g) == ifd or tag in own.get(g, ()):
                return g
        for r in self.removals:
            at_home = r.ifd in (None, ifd) or (r.ifd == "SubIFD" and ifd.startswith("SubIFD"))
            if r.kind == "exif" and at_home and (r.names.fullmatch(name) or r.names.fullmatch(f"0x{tag:04x}")):
                return r.source
        if "orientation" in self.stripped and (ifd, tag) == ("IFD0", exif.ORIENTATION):
            return "orientation"
        return next((f"set.exif.{t.name}" for t, v in self.put.exif if v is None and (t.ifd, t.tag) == (ifd, tag)), None)

    def reason(self, kind: str, name: str) -> str | None:
        """Why an XMP property, IPTC dataset, text or other block of a name goes."""
        for g in self.groups:
            if any(p.fullmatch(name) for p in GROUP_PATTERNS[kind].get(g, ())):
                return g
        for r in self.removals:
            if r.kind == kind and r.names.fullmatch(name):
                return r.source
        if kind == "xmp" and name == "tiff:Orientation" and "orientation" in self.stripped:
            return "orientation"
        taken = {"xmp": self.put.xmp, "text": self.put.text}.get(kind, {})
        return f"set.{kind}.{name}" if name in taken and taken[name] is None else None

    def touches(self, kind: str) -> bool:
        """Whether it may change anything of a kind, so that blocks of others need not be read."""
        if any(r.kind == kind for r in self.removals):
            return True
        if kind == "exif":
            return bool(self.groups) or "orientation" in self.stripped or bool(self.put.exif)
        if any(g in NAMES[kind] for g in self.groups):
            return True
        if kind == "xmp":
            return "orientation" in self.stripped or bool(self.put.xmp)
        return kind == "text" and None in self.put.text.values()


def text_of(value, where: str, most: int = 2000) -> str:
    if not isinstance(value, str) or len(value) > most or "\0" in value:
        refuse(f"{where} has to be text of at most {most} characters without null")
    return value


def kinds_of(value, where: str) -> tuple[str, ...]:
    if value is None:
        return ()
    if not isinstance(value, list) or any(k not in KINDS for k in value):
        refuse(f"{where} has to be a list of kinds ({', '.join(KINDS)})")
    return tuple(dict.fromkeys(value))


def removal_of(entry) -> str | Removal:
    """A group, or a pattern: exif:[IFD/]name, xmp:prefix:name, iptc:name, text:name, other:name."""
    if entry in GROUPS:
        return entry
    m = re.fullmatch(r"(exif|xmp|iptc|text|other):(.+)", entry, re.S) if isinstance(entry, str) and len(entry) <= 100 else None
    if not m:
        refuse(f"remove entry {entry!r} is neither a group ({', '.join(GROUPS)}) nor of the form kind:name")
    kind, rest, ifd = m[1], m[2], None
    if kind == "exif" and "/" in rest:
        home, rest = rest.split("/", 1)
        ifd = "SubIFD" if re.fullmatch(r"(?i)subifd\d*", home) else next((x for x in IFDS if x.lower() == home.lower()), None)
        if ifd is None or not rest:
            refuse(f"{entry!r} names no directory and tag")
    if kind == "xmp" and not re.fullmatch(r"[^:]+:.+", rest, re.S):
        refuse(f"{entry!r} has to be of the form xmp:prefix:name")
    return Removal(kind, entry, pattern(rest), ifd)


def put_of(value) -> Put:
    if value is None:
        return Put()
    if not isinstance(value, dict) or set(value) - set(SET_FIELDS):
        refuse(f"set has to be an object of {', '.join(SET_FIELDS)}")
    out = Put(common={k: text_of(value[k], f"set.{k}") for k in COMMON if k in value})

    def named(field_name: str, most: int) -> dict:
        inside = value.get(field_name, {})
        if not isinstance(inside, dict) or len(inside) > most:
            refuse(f"set.{field_name} has to be an object of at most {most} fields")
        return inside

    if "comment" in value:
        several = value["comment"] if isinstance(value["comment"], list) else [value["comment"]]
        if len(several) > 16:
            refuse("set.comment has more than 16 comments")
        out.comments = [text_of(c, "set.comment", 16384) for c in several]
    if "orientation" in value:
        if isinstance(value["orientation"], bool) or value["orientation"] not in range(1, 9):
            refuse("set.orientation has to be from 1 to 8")
        out.orientation = value["orientation"]
    if "icc" in value:
        if value["icc"] != "srgb":
            refuse("set.icc can be srgb only")
        out.icc = True
    for name, v in named("exif", 64).items():
        info = exif.settable(name)
        if v is not None:
            exif.encoded(info, v, "<")
        out.exif.append((info, v))
    for name, v in named("xmp", 64).items():
        if not xmp.known_property(name):
            refuse(f"set.xmp: {name!r} is not prefix:name with a known prefix")
        several = v if isinstance(v, list) else [v]
        if v is not None and not 1 <= len(several) <= 64:
            refuse(f"set.xmp.{name} needs 1 to 64 values")
        out.xmp[name] = None if v is None else [text_of(x, f"set.xmp.{name}") for x in several] if isinstance(v, list) else text_of(v, f"set.xmp.{name}")
    if "xmpPacket" in value:
        out.packet = text_of(value["xmpPacket"], "set.xmpPacket", 60000)
        try:
            xmp.Packet(out.packet)
        except xmp.XmpError as e:
            refuse(f"set.xmpPacket: {e}")
    for word, v in named("text", 32).items():
        if not is_keyword(word) or word == "XML:com.adobe.xmp" or re.match(r"(?i)raw profile type ", word) or word == "Comment":
            refuse(f"set.text: {word!r} is no keyword that can be set")
        out.text[word] = None if v is None else text_of(v, f"set.text.{word}", 16384)
    return out


def policy(given: str | dict | Policy) -> Policy:
    """A policy of a preset's name, an object or a profile, checked."""
    if isinstance(given, Policy):
        return given
    given = {"preset": given} if isinstance(given, str) else given
    if not isinstance(given, dict) or set(given) - set(FIELDS):
        refuse(f"it has to be a preset or an object of {', '.join(FIELDS)}")
    preset = given.get("preset", "keep")
    if preset not in PRESETS:
        refuse(f"no preset {preset!r}; there are {', '.join(PRESETS)}")
    keep, strip = kinds_of(given.get("keep"), "keep"), kinds_of(given.get("strip"), "strip")
    if set(keep) & set(strip):
        refuse(f"{', '.join(sorted(set(keep) & set(strip)))} in both keep and strip")
    entries = given.get("remove") or []
    if not isinstance(entries, list) or len(entries) > 64:
        refuse("remove has to be a list of at most 64 entries")
    removals = [removal_of(e) for e in entries]
    stripped = frozenset({*PRESETS[preset][0], *strip} - {*keep})
    groups = tuple(dict.fromkeys([*PRESETS[preset][1], *(r for r in removals if isinstance(r, str))]))
    own = any(given.get(k) for k in ("keep", "strip", "remove", "set"))
    return Policy(given.get("id") or ("custom" if own else preset), preset, stripped, preset == "web" and "icc" not in stripped and "icc" not in keep, groups, tuple(r for r in removals if isinstance(r, Removal)), put_of(given.get("set")))


def profile(given: dict) -> dict:
    """A saved policy in its normal form: fields in order, empty ones left out, names sorted."""
    policy(given)
    own = given.get("id")
    if not isinstance(own, str) or not re.fullmatch(PROFILE_ID, own) or own in PRESETS:
        refuse(f"profile id {own!r} has to be of lower-case letters, digits and dashes, and no preset")
    out: dict = {"id": own}
    for name, most in (("name", 80), ("description", 500)):
        if name in given:
            out[name] = text_of(given[name], name, most)
    if given.get("preset", "keep") != "keep":
        out["preset"] = given["preset"]
    for name in ("keep", "strip"):
        if given.get(name):
            out[name] = [k for k in KINDS if k in given[name]]
    if given.get("remove"):
        out["remove"] = list(dict.fromkeys(given["remove"]))
    put = given.get("set") or {}
    by_name = lambda d: {k: d[k] for k in sorted(d, key=lambda k: (k.lower(), k.swapcase()))}
    inside = {k: by_name(put[k]) if isinstance(put[k], dict) else put[k] for k in SET_FIELDS if put.get(k) not in (None, {})}
    return {**out, "set": inside} if inside else out


def profile_text(given: dict) -> str:
    return json.dumps(profile(given), indent=2, ensure_ascii=False) + "\n"
