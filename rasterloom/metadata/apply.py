"""Policies applied to files. Image data, structure and this package's own parts are copied; a block that a
policy leaves alone keeps its bytes; one that it would change and that cannot be read goes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from rasterloom.functions.errors import ImageError
from rasterloom.functions.limits import DEFAULTS, Limits
from rasterloom.metadata import exif, icc, iptc, xmp
from rasterloom.metadata.policy import Policy, policy
from rasterloom.metadata.previews import EXTENDED, XMP, without_maker_previews, without_photoshop_thumbnails
from rasterloom.metadata.tags import tag_name
from rasterloom.metadata.text import SEGMENT, XMP_KEYWORD, app_label, bounded, comment_bytes, read_text, text_chunk
from rasterloom.sources import jpeg, jxl, png
from rasterloom.sources.detect import format_of

# Chunks that decoding needs, that say what colours are, that new ones go before; profiles as text.
STRUCTURE = {b"IHDR", b"PLTE", b"IDAT", b"IEND", b"tRNS", b"acTL", b"fcTL", b"fdAT"}
COLOUR = {b"sRGB", b"gAMA", b"cHRM", b"cICP", b"mDCV", b"cLLI"}
AFTER_METADATA = {b"PLTE", b"tRNS", b"bKGD", b"hIST", b"sPLT", b"acTL", b"fcTL", b"IDAT", png.MARKER, png.WATERMARK}
RAW = re.compile(r"Raw profile type (exif|app1|xmp|icc|icm|iptc|8bim)", re.I)
RAW_KINDS = {"exif": "exif", "app1": "exif", "xmp": "xmp", "icc": "icc", "icm": "icc", "iptc": "other", "8bim": "other"}
ICC, EXIF = b"ICC_PROFILE\0", b"Exif\0\0"


@dataclass
class Report:
    policy: str
    removed: list[str] = field(default_factory=list)
    set: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    def note(self, what: str) -> None:
        if what not in self.notes:
            self.notes.append(what)

    def gone(self, kind: str, names: list[tuple[str, str]]) -> None:
        """Names by why they went."""
        by: dict[str, list[str]] = {}
        for name, why in names:
            by.setdefault(why, []).append(name)
        self.removed += [f"{kind} {shortened(own)} ({why})" for why, own in by.items()]


def shortened(names: list[str]) -> str:
    """At most eight names, and how many there are."""
    return ", ".join(names) if len(names) <= 8 else f"{', '.join(names[:8])}, … ({len(names)})"


@dataclass
class Job:
    policy: Policy
    report: Report
    format: str
    limits: Limits = DEFAULTS
    strip_thumbnails: bool = False
    srgb_tagged: bool = False
    icc_in_codestream: bool = False

    # Each gives (block, whether it changed); None is no block.

    def exif(self, block: bytes | None) -> tuple[bytes | None, bool]:
        p, r = self.policy, self.report
        puts = self.exif_puts()
        stripped = "exif" in p.stripped
        if block is None and not puts or block is not None and not (stripped or puts or p.touches("exif") or self.strip_thumbnails):
            return block, False
        previews, why_previews = self.strip_thumbnails or "thumbnail" in p.groups, "thumbnail" if "thumbnail" in p.groups else "embedded preview"
        model, changed, zeroed = exif.Exif(), False, False
        if block is not None:
            cleaned = without_maker_previews(block) if previews and not stripped else None
            if cleaned is not None:
                block, zeroed = cleaned, True
                r.removed.append(f"MakerNote preview ({why_previews})")
            try:
                model = exif.parsed(block)
            except ImageError as e:
                r.removed.append(f"EXIF (unreadable: {e})")
                model, changed, stripped = exif.Exif(), True, False
        if stripped and block is not None:
            all_tags, keep = len(model), []
            if "orientation" not in p.stripped and self.format != "jxl" and exif.orientation(model) != 1:
                keep = [e for e in model.ifds["IFD0"] if e.tag == exif.ORIENTATION]
            if keep and len(keep) == all_tags and not puts:
                return block, zeroed
            model, changed = exif.Exif(model.order, {"IFD0": keep}), True
            r.removed.append(f"EXIF ({all_tags - len(keep)} of {all_tags} tags; Orientation kept)" if keep else f"EXIF ({all_tags} tags)")
        elif not stripped:
            gone: list[tuple[str, str]] = []
            if previews and "IFD1" in model.ifds:
                del model.ifds["IFD1"]
                gone.append(("IFD1 thumbnail", why_previews))
            for ifd, entries in model.ifds.items():
                why = {id(e): p.exif_reason(ifd, e.tag, tag_name(ifd, e.tag)) for e in entries}
                gone += [(tag_name(ifd, e.tag) if ifd in ("IFD0", "Exif") else f"{ifd}:{tag_name(ifd, e.tag)}", why[id(e)]) for e in entries if why[id(e)]]
                model.ifds[ifd] = [e for e in entries if not why[id(e)]]
            r.gone("EXIF", gone)
            changed |= bool(gone)
        for info, value in puts:
            entry, home = exif.encoded(info, value, model.order), model.ifds.setdefault(info.ifd, [])
            at = next((k for k, e in enumerate(home) if e.tag == info.tag), len(home))
            if at < len(home) and (home[at].type, home[at].count, home[at].data) == (entry.type, entry.count, entry.data):
                continue
            home[at : at + 1] = [entry]
            r.set.append(f"EXIF {info.name}")
            changed = True
        if not changed:
            return block, zeroed
        if model.warnings:
            r.note(f"EXIF: what cannot be read is left out ({shortened(model.warnings)})")
        if not len(model):
            return None, True
        out, notes = exif.written(model)
        for n in notes:
            r.note(f"EXIF: {n}")
        return out, True

    def exif_puts(self) -> list:
        """Tags to set; those named win over the common fields."""
        put = self.policy.put
        out = {exif.settable(name).tag: (exif.settable(name), v) for name, v in put.to("exif").items()}
        out |= {info.tag: (info, v) for info, v in put.exif if v is not None}
        if put.orientation:
            if self.format == "jxl":
                self.report.note("orientation: in JPEG XL it is in the codestream, and is not set")
            else:
                out[exif.ORIENTATION] = (exif.settable("Orientation"), put.orientation)
        return list(out.values())

    def xmp(self, text: str | None) -> tuple[str | None, bool]:
        p, r = self.policy, self.report
        named = {n: v for n, v in p.put.xmp.items() if v is not None}
        common = p.put.to("xmp")
        if text is None and not named and not p.put.packet:
            return None, False
        if text is not None and not ("xmp" in p.stripped or p.touches("xmp") or common or named or p.put.packet):
            return text, False
        packet, changed = None, False
        if text is not None and "xmp" in p.stripped:
            r.removed.append("XMP")
            changed = True
        elif text is not None:
            try:
                packet = xmp.Packet(text)
                gone = packet.remove(lambda n: p.reason("xmp", n) is not None)
                r.gone("XMP", [(n, p.reason("xmp", n)) for n in gone])
                changed |= bool(gone)
            except xmp.XmpError as e:
                r.removed.append(f"XMP (unreadable: {e})")
                changed = True
        if p.put.packet:
            packet, changed = xmp.Packet(p.put.packet), True
            r.set.append("XMP packet (replaced)")
        for name, value in {**(common if packet is not None else {}), **named}.items():
            packet = packet or xmp.Packet(xmp.EMPTY)
            old = dict(reversed(packet.properties())).get(name)
            if old == (value if isinstance(value, list) or name not in xmp.LISTS else [value]):
                continue
            packet.set(name, value)
            r.set.append(f"XMP {name}")
            changed = True
        if not changed:
            return text, False
        return (None if packet is None or not (packet.properties() or p.put.packet) else str(packet)), True

    def icc(self, data: bytes | None) -> tuple[bytes | str | None, bool]:
        """'srgb' as a profile asks for whatever says sRGB best in a format."""
        p, r = self.policy, self.report
        about = icc.described(data)
        title = f'"{about["description"]}"' if about and about["description"] else "unnamed"
        if p.put.icc:
            if (data and icc.is_srgb(data) and self.format != "png") or (not data and self.srgb_tagged):
                return data, False
            if data and not icc.is_srgb(data):
                r.note(f"profile {title} replaced by sRGB: samples stay, so colours look different")
            r.set.append("ICC profile: sRGB")
            return "srgb", True
        if not data:
            return data, False
        if "icc" in p.stripped:
            r.removed.append(f"ICC profile ({title})")
            if not icc.is_srgb(data):
                r.note("profile removed: viewers take the samples for sRGB")
            return None, True
        if p.drop_srgb and icc.is_srgb(data):
            r.removed.append(f"ICC profile ({title}, plain sRGB)")
            return None, True
        return data, False


# ---- PNG


def png_kind(kind: bytes, body: bytes) -> tuple[str, str]:
    """(kind, name) of a chunk: raw profiles are of the kind that they hold, named by their keyword."""
    if kind in png.OWN:
        return "own", ""
    if kind in STRUCTURE:
        return "structure", ""
    fixed = {b"eXIf": "exif", b"iCCP": "icc", b"pHYs": "density"}.get(kind) or ("colour" if kind in COLOUR else None)
    if fixed:
        return fixed, ""
    if kind in (b"tEXt", b"zTXt", b"iTXt"):
        word = body.partition(b"\0")[0].decode("latin-1") if b"\0" in body else ""
        raw = RAW.fullmatch(word)
        return ("xmp", "") if word == XMP_KEYWORD else ("raw " + RAW_KINDS[raw[1].lower()], word) if raw else ("text", word)
    return ("structure" if not kind[0] & 0x20 else "other"), ""


def xmp_chunk(text: str) -> tuple[bytes, bytes]:
    return b"iTXt", XMP_KEYWORD.encode() + b"\0\0\0\0\0" + text.encode()


def png_profile(body: bytes, limits: Limits) -> bytes | None:
    try:
        return bounded(body.partition(b"\0")[2][1:], limits.max_metadata_bytes, "a profile") or None
    except ImageError as e:
        if e.code == "LIMIT":
            raise
        return None


def applied_png(data: bytes, job: Job) -> bytes:
    p, r = job.policy, job.report
    parts = png.chunks(data)
    kinds = [png_kind(*c) for c in parts]
    out: list = list(parts)
    extra: list[tuple[bytes, bytes]] = []
    of = lambda kind: [i for i, (k, _) in enumerate(kinds) if k == kind]

    for i, (kind, word) in enumerate(kinds):  # profiles as text cannot be edited
        if kind.startswith("raw "):
            own = kind[4:]
            if own in p.stripped or (p.touches("iptc") or p.touches("other") if own == "other" else own != "icc" and p.touches(own)):
                out[i] = None
                r.removed.append(f'text chunk "{word}" (a profile that cannot be edited)')

    def replaced(kind: str, new: tuple[bytes, bytes] | None) -> None:
        """The first block of a kind is the new one; there are no others."""
        places = of(kind)
        for i in places:
            out[i] = None
        if new is not None and places:
            out[places[0]] = new
        elif new is not None:
            extra.append(new)

    block, changed = job.exif(parts[of("exif")[0]][1] if of("exif") else None)
    if changed:
        replaced("exif", None if block is None else (b"eXIf", block))
    packet = read_text(*parts[of("xmp")[0]], job.limits.max_metadata_bytes) if of("xmp") else None
    text, changed = job.xmp((packet[1] if packet else "") if of("xmp") else None)
    if changed:
        replaced("xmp", None if text is None else xmp_chunk(text))
    at = of("icc")
    profile = png_profile(parts[at[0]][1], job.limits) if at else None
    names = [k for k, _ in parts]
    job.srgb_tagged = not at and b"sRGB" in names and b"cICP" not in names
    new, changed = job.icc(profile)
    if at and profile is None and "icc" in p.stripped:
        out[at[0]] = None
        r.removed.append("ICC profile (unreadable)")
    if changed:
        for i in at:
            out[i] = None
        if new == "srgb":
            old = [i for i in of("colour") if out[i]]
            for i in old:
                out[i] = None
            if old:
                r.removed.append(f"colour chunks {', '.join(names[i].decode() for i in old)} (replaced by sRGB)")
            extra += [(b"sRGB", b"\0"), (b"gAMA", (45455).to_bytes(4, "big"))]
    colour = [i for i in of("colour") if out[i] and "colour" in p.stripped]
    for i in colour:
        out[i] = None
    for i in of("density"):
        if "density" in p.stripped:
            out[i] = None
            r.removed.append("density (pHYs)")
    for i in of("other"):
        name = names[i].decode("latin-1")
        why = "other" if "other" in p.stripped else p.reason("other", name)
        if why:
            out[i] = None
            r.removed.append(f"chunk {name} ({why})")
    if colour:
        r.removed.append(f"colour chunks {', '.join(names[i].decode() for i in colour)}")
    png_texts(parts, kinds, out, extra, job)
    if not extra and all(a is b for a, b in zip(out, parts)):
        return data
    first = next((i for i, (k, _) in enumerate(parts) if k in AFTER_METADATA), len(parts))
    return png.joined([c for c in [*out[:first], *extra, *out[first:]] if c is not None])


def png_texts(parts: list, kinds: list, out: list, extra: list, job: Job) -> None:
    """Texts by keyword: those set take the place of the first of their keyword, comments are set all together."""
    p, r = job.policy, job.report
    put = {**(p.put.to("text") if "text" not in p.stripped else {}), **{k: v for k, v in p.put.text.items() if v is not None}}
    read = lambda i: (read_text(*parts[i], job.limits.max_metadata_bytes) or (None, None))[1]
    done, gone, comments = set(), [], []
    for i, (kind, word) in enumerate(kinds):
        if kind != "text" or out[i] is None:
            continue
        if word == "Comment" and p.put.comments is not None:
            comments.append(i)
        elif word in put:
            if word in done:
                out[i] = None
            elif read(i) != put[word]:
                out[i] = text_chunk(word, put[word])
                r.set.append(f"text {word}")
            done.add(word)
        elif why := "text" if "text" in p.stripped else p.reason("text", word):
            gone.append((word, why))
            out[i] = None
    for word, text in put.items():
        if word not in done:
            extra.append(text_chunk(word, text))
            r.set.append(f"text {word}")
    if p.put.comments is not None and [read(i) for i in comments] != p.put.comments:
        for i in comments:
            out[i] = None
        extra += [text_chunk("Comment", c) for c in p.put.comments]
        r.set.append(f"text Comment ({len(p.put.comments)})")
    r.gone("text", list(dict.fromkeys(gone)))


# ---- JPEG


def jpeg_kind(s: jpeg.Segment) -> str:
    body, m = s.body, s.marker
    if m == jpeg.APP15 and body.startswith(jpeg.OWN):
        return "own"
    for marker, begin, kind in ((0xE0, b"JFIF\0", "jfif"), (0xE1, b"Exif\0", "exif"), (0xE1, XMP, "xmp"), (0xE1, EXTENDED, "extended"), (0xE2, ICC, "icc"), (0xEE, b"Adobe", "structure")):
        if m == marker and body.startswith(begin):
            return kind
    return "text" if m == jpeg.COM else "other" if jpeg.is_app(m) else "structure"


def jpeg_profile(bodies: list[bytes]) -> bytes | None:
    parts = sorted((b for b in bodies if len(b) > 14), key=lambda b: b[12])
    return b"".join(b[14:] for b in parts) or None


def applied_jpeg(data: bytes, job: Job) -> bytes:
    p, r = job.policy, job.report
    segments, trailing = jpeg.parsed(data, job.limits)
    kinds = [jpeg_kind(s) for s in segments]
    out: list = list(segments)
    new: dict[int, list[jpeg.Segment]] = {}
    of = lambda kind: [i for i, k in enumerate(kinds) if k == kind]
    head = 1 if kinds[:1] == ["jfif"] else 0
    after_apps = max((i for i, s in enumerate(segments) if jpeg.is_app(s.marker)), default=-1) + 1

    def replaced(kind: str, body: bytes | None, where: int) -> None:
        if body is not None and len(body) > SEGMENT:
            r.note(f"{kind.upper()} is larger than a segment: removed")
            body = None
        places = of(kind)
        for i in places:
            out[i] = None
        if body is not None and places:
            out[places[0]] = jpeg.Segment(0xE1, body)
        elif body is not None:
            new.setdefault(where, []).append(jpeg.Segment(0xE1, body))

    block, changed = job.exif(segments[of("exif")[0]].body[6:] if of("exif") else None)
    if changed:
        replaced("exif", None if block is None else EXIF + block, head)
    text, changed = job.xmp(segments[of("xmp")[0]].body[len(XMP) :].decode("utf-8", "replace") if of("xmp") else None)
    more = of("extended")
    if changed:
        replaced("xmp", None if text is None else XMP + text.encode(), max(head, (of("exif") or [-1])[0] + 1))
    if more and (changed or (not of("xmp") and ("xmp" in p.stripped or p.touches("xmp")))):
        for i in more:
            out[i] = None
        r.removed.append(f"extended XMP ({len(more)} segments, which are not edited)")
    places = of("icc")
    profile, changed = job.icc(jpeg_profile([segments[i].body for i in places]))
    if changed:
        for i in places:
            out[i] = None
        if profile == "srgb":
            new.setdefault(places[0] if places else after_apps, []).append(jpeg.Segment(0xE2, ICC + b"\1\1" + icc.srgb()))
    for i in of("jfif")[:1]:
        body = segments[i].body
        if "density" in p.stripped and len(body) >= 12 and body[7:12] != b"\0\0\1\0\1":
            out[i] = jpeg.Segment(0xE0, body[:7] + b"\0\0\1\0\1" + body[12:])
            r.removed.append("density (JFIF)")
    jpeg_comments(segments, of("text"), out, new, after_apps, job)
    jpeg_others(segments, of("other"), out, job)
    if trailing and "thumbnail" in p.groups:
        r.removed.append(f"{len(trailing)} bytes after the image (thumbnail)")
        trailing = b""
        changed = True
    elif not new and all(a is b for a, b in zip(out, segments)):
        return data
    rows = [s for i in range(len(out) + 1) for s in [*new.get(i, []), *([out[i]] if i < len(out) and out[i] is not None else [])]]
    return jpeg.written(rows, trailing)


def jpeg_comments(segments: list, places: list[int], out: list, new: dict, after: int, job: Job) -> None:
    p, r = job.policy, job.report
    why = "text" if "text" in p.stripped else p.reason("text", "Comment")
    if p.put.comments is not None:
        want = [comment_bytes(c) for c in p.put.comments]
        if [segments[i].body for i in places] != want:
            for i in places:
                out[i] = None
            new.setdefault(places[0] if places else after, []).extend(jpeg.Segment(jpeg.COM, w) for w in want)
            r.set.append(f"comments ({len(want)})")
    elif places and why:
        for i in places:
            out[i] = None
        r.removed.append(f"comments ({len(places)}; {why})")
    words = [k for k, v in p.put.text.items() if v is not None]
    if words:
        r.note(f"text {', '.join(words)}: JPEG has comments only")


def jpeg_others(segments: list, places: list[int], out: list, job: Job) -> None:
    """APPn segments of no kind of their own, Photoshop's among them, whose datasets are edited."""
    p, r = job.policy, job.report
    photoshop = [i for i in places if segments[i].body.startswith(iptc.SIGNATURE)]
    bodies = {i: segments[i].body for i in photoshop}
    if photoshop and "thumbnail" in p.groups and "other" not in p.stripped and not p.reason("other", "APP13"):
        cleaned = without_photoshop_thumbnails([segments[i].body for i in photoshop])
        if cleaned is not None:
            bodies = {i: cleaned[k] if k < len(cleaned) else None for k, i in enumerate(photoshop)}
            r.removed.append("Photoshop thumbnail (thumbnail)")
    put = p.put.to("iptc")
    for i in places:
        s = segments[i]
        label, name = app_label(s.marker, s.body), f"APP{s.marker - 0xE0}"
        preview = label.endswith(("JFXX thumbnail", "MPF")) and "thumbnail" in p.groups
        why = "other" if "other" in p.stripped else p.reason("other", name) or ("thumbnail" if preview else None)
        if why:
            out[i] = None
            r.removed.append(f"{label} ({why})")
            continue
        if i not in bodies:
            continue
        body = bodies[i]
        if body is not None and (p.touches("iptc") or put):
            got = iptc.edited(body, lambda n: p.reason("iptc", n) is not None, put)
            if got is None:
                r.removed.append(f"{label} (unreadable)")
                body = None
            else:
                body = got[0]
                r.gone("IPTC", [(n, p.reason("iptc", n)) for n in got[1]])
                r.set += [f"IPTC {n}" for n in got[2]]
        if body is not None and (p.touches("exif") or p.touches("xmp")):
            got = iptc.without(body, iptc.COPIES)
            if got is not None and got[1]:
                body = got[0]
                r.removed.append(f"Photoshop {', '.join(dict.fromkeys(iptc.COPIES[n] for n in got[1]))} (not edited)")
        if body is not None and len(body) > SEGMENT:
            r.removed.append(f"{label} (too large once edited)")
            body = None
        if body is not s.body:
            out[i] = None if body is None else jpeg.Segment(s.marker, body)


# ---- JPEG XL


def applied_boxes(boxes: list[tuple[bytes, bytes]], job: Job, profile: bytes | None | bool = False) -> tuple[list[tuple[bytes, bytes]], bytes | None | bool, bool]:
    """(boxes, profile, whether they changed); a profile of False is in the codestream and stays."""
    p, r = job.policy, job.report
    out: list = list(boxes)
    extra = []
    inner = [b[1][:4] if b[0] == b"brob" else b[0] for b in boxes]
    for name, kind in (("exif", b"Exif"), ("xmp", b"xml ")):
        places = [i for i, k in enumerate(inner) if k == kind]
        if places and boxes[places[0]][0] == b"brob":
            if name in p.stripped or p.touches(name):
                for i in places:
                    out[i] = None
                r.removed.append(f"{name.upper()} (compressed, cannot be read here)")
            continue
        body = boxes[places[0]][1] if places else None
        if name == "exif":
            value, changed = job.exif(jxl.exif_block(body) if body is not None and len(body) > 4 else None)
            made = None if value is None else (b"Exif", bytes(4) + value)
        else:
            value, changed = job.xmp(body.decode("utf-8", "replace") if body is not None else None)
            made = None if value is None else (b"xml ", value.encode())
        if changed:
            for i in places:
                out[i] = None
            if made is not None and places:
                out[places[0]] = made
            elif made is not None:
                extra.append(made)
    for i, kind in enumerate(inner):
        if out[i] is None or kind in jxl.STRUCTURE or kind in (b"Exif", b"xml ", jxl.MARKER, jxl.WATERMARK, jxl.STASH, jxl.SIZE):
            continue
        name = kind.decode("latin-1").strip()
        why = "other" if "other" in p.stripped else p.reason("other", name)
        if why:
            out[i] = None
            r.removed.append(f"box {name} ({why})")
    if p.put.comments is not None or any(v is not None for v in p.put.text.values()):
        r.note("text and comments: JPEG XL has no place for them")
    changed = bool(extra) or any(a is not b for a, b in zip(out, boxes))
    if profile is not False:
        job.srgb_tagged = profile is None
        new, other = job.icc(profile)
        profile, changed = (None if new == "srgb" else new), changed or other
    elif ("icc" in p.stripped or p.put.icc or p.drop_srgb) and job.icc_in_codestream:
        r.note("ICC profile: it is in the codestream and stays")
    return [b for b in out if b is not None] + extra, profile, changed


def applied_jxl(data: bytes, job: Job) -> bytes:
    boxes, codestream, _ = jxl.read(data, job.limits)
    job.icc_in_codestream = jxl.header(codestream, job.limits)["srgb"] is not True
    kept, _, changed = applied_boxes([b for b in boxes if b[0] not in (b"ftyp", b"jxlc", b"jxlp")], job)
    if not changed:
        return data
    if any(k == b"jbrd" for k, _ in kept):
        job.report.removed.append("JPEG reconstruction data (it no longer matches)")
        kept = [b for b in kept if b[0] != b"jbrd"]
    return jxl.written(kept, codestream)


APPLIED = {"png": applied_png, "jpeg": applied_jpeg, "jxl": applied_jxl}


def applied(data: bytes, given: str | dict | Policy, limits: Limits = DEFAULTS, strip_thumbnails: bool = False) -> tuple[bytes, Report]:
    """(file, report); the file itself where nothing changes."""
    p = policy(given)
    report = Report(p.name)
    if p.idle and not strip_thumbnails:
        return data, report
    name = format_of(data)
    if name not in APPLIED:
        raise ImageError("UNSUPPORTED", f"policies are for PNG, JPEG and JPEG XL, not {name}")
    return APPLIED[name](data, Job(p, report, name, limits, strip_thumbnails)), report
