"""All metadata of a file as one record, for people; and what a conversion carries over."""

from __future__ import annotations

from rasterloom.functions.errors import ImageError
from rasterloom.functions.limits import DEFAULTS, Limits
from rasterloom.metadata import exif, icc, iptc, xmp
from rasterloom.metadata.apply import COLOUR, STRUCTURE, jpeg_kind, jpeg_profile, png_profile
from rasterloom.metadata.previews import XMP
from rasterloom.metadata.text import XMP_KEYWORD, app_label, color_chunk, comment, read_text, time_text
from rasterloom.sources import jpeg, jxl, png
from rasterloom.sources.detect import format_of, webp_metadata

SHOWN = 2000
UNITS = ("none", "dpi", "dpcm")


def cut(text: str) -> str:
    return text if len(text) <= SHOWN else text[:SHOWN] + "…"


def blank(name: str | None) -> dict:
    return {"format": name, "exif": None, "xmp": None, "icc": None, "colour": [], "text": [], "density": None, "orientation": 1, "iptc": None, "other": [], "own": []}


def with_exif(out: dict, block: bytes) -> None:
    if out["exif"] is None:
        out["exif"] = exif.info(block)
        out["orientation"] = out["exif"]["orientation"]


def profile_info(data: bytes | None, source: str) -> dict:
    found = icc.described(data)
    return {"source": source, **(found or {"bytes": len(data or b""), "error": "not a profile"})}


def png_record(data: bytes, limits: Limits) -> dict:
    out = blank("png")
    for kind, body in png.chunks(data):
        name = kind.decode("latin-1")
        if kind in png.OWN:
            out["own"].append(name)
        elif kind == b"eXIf":
            with_exif(out, body)
        elif kind == b"iCCP":
            out["icc"] = out["icc"] or profile_info(png_profile(body, limits), name)
        elif kind == b"pHYs" and len(body) == 9:
            out["density"] = {"x": int.from_bytes(body[:4], "big"), "y": int.from_bytes(body[4:8], "big"), "unit": "meter" if body[8] == 1 else "none"}
        elif kind in COLOUR:
            out["colour"].append({"type": name, "value": color_chunk(kind, body)})
        elif kind in (b"tEXt", b"zTXt", b"iTXt"):
            found = read_text(kind, body, limits.max_metadata_bytes)
            if found and found[0] == XMP_KEYWORD:
                out["xmp"] = out["xmp"] or xmp.info(found[1])
            else:
                word = found[0] if found else body.partition(b"\0")[0].decode("latin-1")
                out["text"].append({"keyword": word, "text": cut(found[1]) if found else "", "type": name} | ({} if found else {"error": "unreadable"}))
        elif kind == b"tIME" and len(body) == 7:
            out["other"].append({"type": name, "bytes": 7, "value": time_text(body)})
        elif kind not in STRUCTURE and kind[0] & 0x20:
            out["other"].append({"type": name, "label": "caBX C2PA manifest" if kind == b"caBX" else name, "bytes": len(body)})
    return out


def jpeg_record(data: bytes, limits: Limits) -> dict:
    out, profile, extended = blank("jpeg"), [], 0
    segments, trailing = jpeg.parsed(data, limits)
    for s in segments:
        kind, body = jpeg_kind(s), s.body
        if kind == "own":
            out["own"].append(f"APP15 {body.partition(bytes(1))[0].decode('latin-1')}")
        elif kind == "jfif" and len(body) >= 12:
            unit, x, y = body[7], int.from_bytes(body[8:10], "big"), int.from_bytes(body[10:12], "big")
            if x and y and (unit, x, y) != (0, 1, 1):
                out["density"] = {"x": x, "y": y, "unit": UNITS[unit] if unit < 3 else "none"}
        elif kind == "exif" and out["exif"] is None:
            with_exif(out, body[6:])
        elif kind == "xmp" and out["xmp"] is None:
            out["xmp"] = xmp.info(body[len(XMP) :].decode("utf-8", "replace"))
        elif kind == "extended":
            extended += 1
        elif kind == "icc":
            profile.append(body)
        elif kind == "text":
            out["text"].append({"keyword": "Comment", "text": cut(comment(body)), "type": "COM"})
        elif kind in ("other", "exif", "xmp"):
            out["other"].append({"type": f"APP{s.marker - 0xE0}", "label": app_label(s.marker, body), "bytes": len(body)})
            if body.startswith(iptc.SIGNATURE) and out["iptc"] is None:
                out["iptc"] = iptc.listed(body)
    if extended and out["xmp"]:
        out["xmp"]["extended"] = extended
    if profile:
        out["icc"] = profile_info(jpeg_profile(profile), "APP2")
    if trailing:
        out["other"].append({"type": "trailing", "label": "data after the image", "bytes": len(trailing)})
    return out


LABELS = {b"jumb": "JUMBF (e.g. C2PA)", b"jbrd": "JPEG reconstruction data", b"jhgm": "HDR gain map"}


def jxl_record(data: bytes, limits: Limits) -> dict:
    out = blank("jxl")
    boxes, codestream, _ = jxl.read(data, limits)
    head = jxl.header(codestream, limits)
    for kind, body in boxes:
        name = kind.decode("latin-1").strip()
        if kind == b"brob":
            inner = body[:4].decode("latin-1").strip()
            out["other"].append({"type": f"brob {inner}", "label": f"compressed {inner} box (cannot be read here)", "bytes": len(body)})
        elif kind in (jxl.MARKER, jxl.WATERMARK, jxl.STASH, jxl.SIZE):
            out["own"].append(name)
        elif kind == b"Exif" and len(body) > 4:
            with_exif(out, jxl.exif_block(body))
        elif kind == b"xml ":
            out["xmp"] = out["xmp"] or xmp.info(body.decode("utf-8", "replace"))
        elif kind not in (b"ftyp", b"jxlc", b"jxlp", b"jxli", b"jxll"):
            out["other"].append({"type": name, "label": f"{name} {LABELS.get(kind, '')}".strip(), "bytes": len(body)})
    return {**out, "orientation": head["orientation"], "icc": {"source": "codestream", "srgb": head["srgb"]}}


def metadata_of(data: bytes, limits: Limits = DEFAULTS) -> dict:
    """format, exif, xmp, icc, colour, text, density, orientation, iptc, other, own. Formats without blocks that are known have a blank record."""
    name = format_of(data)
    return {"png": png_record, "jpeg": jpeg_record, "jxl": jxl_record}.get(name, lambda *_: blank(name))(data, limits)


# ---- what a conversion carries over: exif, icc, xmp, comments, density as (x, y, unit), and what is dropped


def carried_png(data: bytes, limits: Limits) -> dict:
    out: dict = {"comments": [], "dropped": []}
    words, parts = [], png.chunks(data)
    profiled = any(k == b"iCCP" for k, _ in parts)
    for kind, body in parts:
        if kind == b"eXIf":
            out["exif"] = body
        elif kind == b"iCCP":
            out["icc"] = png_profile(body, limits)
            if out["icc"] is None:
                out["dropped"].append("ICC profile (damaged)")
        elif kind == b"pHYs" and len(body) == 9:
            out["density"] = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), "meter" if body[8] == 1 else "none")
        elif kind in (b"tEXt", b"zTXt", b"iTXt") and (found := read_text(kind, body, limits.max_metadata_bytes)):
            if found[0] == XMP_KEYWORD:
                out["xmp"] = found[1]
            elif found[0] == "Comment":
                out["comments"].append(found[1])
            else:
                words.append(found[0])
        elif kind in (b"gAMA", b"cHRM") and not profiled:
            out["dropped"].append("gamma/chromaticity")
    out["dropped"] = list(dict.fromkeys(out["dropped"])) + ([f"text chunks ({', '.join(dict.fromkeys(words))})"] if words else [])
    return out


def carried_jpeg(data: bytes, limits: Limits) -> dict:
    out: dict = {"comments": [], "dropped": []}
    profile = []
    for s in jpeg.parsed(data, limits)[0]:
        kind, body = jpeg_kind(s), s.body
        if s.marker == jpeg.SOS:
            break
        if kind == "jfif" and len(body) >= 12:
            unit, x, y = body[7], int.from_bytes(body[8:10], "big"), int.from_bytes(body[10:12], "big")
            scale = {1: 1 / 0.0254, 2: 100.0}.get(unit, 1.0)
            if x and y:
                out["density"] = (int(x * scale + 0.5), int(y * scale + 0.5), "meter" if unit else "none")
        elif kind == "exif":
            out.setdefault("exif", body[6:])
        elif kind == "xmp":
            out.setdefault("xmp", body[len(XMP) :].decode("utf-8", "replace"))
        elif kind == "extended" and "extended XMP" not in out["dropped"]:
            out["dropped"].append("extended XMP")
        elif kind == "icc":
            profile.append(body)
        elif kind == "text":
            out["comments"].append(comment(body))
    if profile:
        out["icc"] = jpeg_profile(profile)
    return out


def carried_jxl(data: bytes, limits: Limits) -> dict:
    out: dict = {"comments": [], "dropped": []}
    boxes, codestream, _ = jxl.read(data, limits)
    note = jxl.extra_note(jxl.header(codestream, limits))
    if note:
        out["dropped"].append(note)
    for kind, body in boxes:
        if kind == b"brob":
            out["dropped"].append(f"compressed {body[:4].decode('latin-1').strip()} box")
        elif kind == b"Exif" and len(body) > 4:
            out["exif"] = jxl.exif_block(body)
        elif kind == b"xml ":
            out["xmp"] = body.decode("utf-8", "replace")
    return out


def carried_webp(data: bytes, limits: Limits) -> dict:
    found = webp_metadata(data)
    return {"comments": [], "dropped": [], **{k: v for k, v in found.items() if v is not None and k != "loops"}}


def carried_over(data: bytes, limits: Limits = DEFAULTS) -> dict:
    name = format_of(data)
    if name not in ("png", "jpeg", "jxl", "webp", "gif"):
        raise ImageError("UNSUPPORTED", f"no metadata of {name} files is read")
    return {"png": carried_png, "jpeg": carried_jpeg, "jxl": carried_jxl, "webp": carried_webp}.get(name, lambda *_: {"comments": [], "dropped": []})(data, limits)
