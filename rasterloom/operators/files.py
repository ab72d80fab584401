"""The verbs over whole files: scramble, restore, change the key, describe, convert, apply a policy.

Each is a function of bytes that raises ImageError alone for what it does not do. images.py makes column
functions of them. JPEG XL files are read as boxes and headers; what needs their pixels has code UNSUPPORTED.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from rasterloom.functions.errors import ImageError
from rasterloom.functions.limits import Limits, checked, resolved
from rasterloom.functions.params import key_bytes
from rasterloom.metadata.apply import Report, applied
from rasterloom.metadata.policy import policy
from rasterloom.metadata.previews import sanitized_jpeg, sanitized_parts, without_exif_previews, without_xmp_previews
from rasterloom.metadata.read import carried_over, metadata_of
from rasterloom.sources import gif, jpeg, jpeg_pixels, jxl, png, raster
from rasterloom.sources.detect import format_of, is_lossless_avif, other_info, riff, target_format
from rasterloom.sources.raster import Picture
from rasterloom.watermark.carried import read_carried
from rasterloom.watermark.definition import ID, compiled

#: What a decoder is: formats, and a function of a file and limits that gives a Picture. The first that has a file's format is asked.
Decoder = tuple[tuple[str, ...], Callable[[bytes, Limits], Picture], str]


def no_codec(what: str) -> ImageError:
    return ImageError("UNSUPPORTED", f"{what} needs a JPEG XL codec, and there is none")


def checked_options(options: dict) -> None:
    """Refuses options on the driver, before any file is read."""
    checked(options)
    resolved(options.get("limits"))
    if options.get("metadata") is not None:
        policy(options["metadata"])


def known_format(data: bytes) -> str:
    name = format_of(data)
    if name is None:
        raise ImageError("UNSUPPORTED", "no format that is known")
    return name


def is_scrambled(data: bytes) -> bool:
    """Whether a file has a marker; nothing else is read."""
    name = format_of(data)
    if name == "png":
        return png.own_part(png.chunks(data), png.MARKER) is not None
    if name == "jpeg":
        return jpeg.own_part(jpeg.parsed(data)[0], jpeg.SIGNATURE) is not None
    return name == "jxl" and jxl.own_part(jxl.read(data)[0], jxl.MARKER) is not None


# ---- conversion


@dataclass
class Converted:
    content: bytes
    format: str
    source: str
    decoder: str
    transferred: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    report: Report | None = None


def decoded_jpeg(data: bytes, limits: Limits) -> Picture:
    rgb, segments, _ = jpeg_pixels.decoded(data, limits)
    inks = sum(1 for s in segments if jpeg.is_sof(s.marker) and len(s.body) > 5 and s.body[5] == 4)
    alpha = np.full((*rgb.shape[:2], 1), 255, np.uint8)
    return Picture(np.concatenate([rgb, alpha], 2), dropped=["CMYK colours (made RGB without a profile)"] if inks else [])


BUILT_IN: tuple[Decoder, ...] = ((("png",), raster.decoded, "png"), (("jpeg",), decoded_jpeg, "jpeg"), (("gif",), gif.decoded, "gif"))


def picture_of(data: bytes, name: str, decoders: tuple[Decoder, ...], limits: Limits) -> tuple[Picture, str, list[str]]:
    """(picture, decoder, notes): the first decoder for a format, and the built-in one where that fails, but for limits."""
    able = [d for d in (*decoders, *BUILT_IN) if name in d[0]]
    if not able:
        raise no_codec("decoding") if name == "jxl" else ImageError("UNSUPPORTED", f"no decoder for {name} files")
    notes: list[str] = []
    tries = [able[0]] + [d for d in BUILT_IN if name in d[0] and d is not able[0]]
    for k, (_, decode, title) in enumerate(tries):
        try:
            return checked_picture(decode(data, limits), name, limits), title, notes
        except Exception as e:  # a decoder that is given may raise whatever it likes
            code = e.code if isinstance(e, ImageError) else f"BAD_{name.upper()}"
            if code == "LIMIT" or k == len(tries) - 1:
                raise e if isinstance(e, ImageError) else ImageError(code, f"{title} could not decode the file: {e}") from e
            notes.append(f"{title} could not decode the file ({e}); the built-in decoder was used")
    raise AssertionError


def checked_picture(picture: Picture, name: str, limits: Limits) -> Picture:
    """A decoder's picture, if it is one of the size that it says."""
    data = getattr(picture, "rgba", None)
    if data is None or data.ndim != 3 or not data.size or data.shape[2] != 4 or data.dtype != (np.uint16 if picture.depth == 16 else np.uint8):
        raise ImageError("DECODER" if data is not None else f"BAD_{name.upper()}", "the decoder gave no RGBA samples")
    height, width = data.shape[:2]
    limits.pixels(width, height)
    frames = picture.animation.frames if picture.animation else []
    if len(frames) > 1:
        limits.frames(len(frames), len(frames) * width * height)
    if any(f.shape != data.shape for f in frames):
        raise ImageError("DECODER", "the decoder's frames have other sizes")
    return picture


def to_8_bit(picture: Picture) -> Picture:
    if picture.depth == 8:
        return picture
    return Picture(((picture.rgba.astype(np.uint32) + 128) // 257).astype(np.uint8), 8, picture.animation, picture.meta, [*picture.dropped, "16-bit precision (8 bits are kept)"])


def merged_meta(data: bytes, picture: Picture, keep_thumbnails: bool, limits: Limits) -> tuple[dict, list[str]]:
    """(metadata, what is dropped): what the file's own reader finds goes before what the decoder gave; previews go."""
    name = format_of(data)
    found = carried_over(data, limits) if name in ("png", "jpeg", "jxl", "webp", "gif") else {}
    meta = {**picture.meta, **{k: v for k, v in found.items() if v is not None}}
    dropped = [*found.get("dropped", []), *picture.dropped]
    if not keep_thumbnails and meta.get("exif") and (got := without_exif_previews(meta["exif"])) is not None:
        meta["exif"] = got[0]
        dropped += got[1]
    if not keep_thumbnails and meta.get("xmp") and (got := without_xmp_previews(meta["xmp"])) is not None:
        meta["xmp"] = got[0]
        dropped += got[1]
    shown = meta.pop("orientation", None)
    if shown:
        from rasterloom.metadata.exif import with_orientation

        meta["exif"] = with_orientation(meta.get("exif"), shown)
    return meta, list(dict.fromkeys(dropped))


def jpeg_density(density: tuple[int, int, str] | None) -> tuple[int, int, int] | None:
    """(unit, x, y): inches where they map back to the same density a metre, else centimetres."""
    if not density:
        return None
    x, y, unit = density
    half_up = lambda v: int(v + 0.5)
    if unit != "meter":
        out = (0, x, y)
    else:
        inches = [half_up(v * 0.0254) for v in (x, y)]
        exact = all(half_up(i / 0.0254) == v for i, v in zip(inches, (x, y)))
        out = (1, *inches) if exact else (2, half_up(x / 100), half_up(y / 100))
    return out if all(0 < v < 65536 for v in out[1:]) else None


def jpeg_of(picture: Picture, options: dict) -> tuple[bytes, list[str], list[str]]:
    """(file, carried over, dropped)."""
    picture = to_8_bit(picture)
    meta, dropped, carried = dict(picture.meta), list(picture.dropped), []
    background = options.get("background") or "#ffffff"
    if (picture.rgba[:, :, 3] != 255).any():
        dropped.append(f"transparency (shown on {background})")
    rgb = jpeg_pixels.over(picture.rgba, background)
    grey = bool((rgb[:, :, 0] == rgb[:, :, 1]).all() and (rgb[:, :, 1] == rgb[:, :, 2]).all())
    profile = meta.get("icc")
    space = profile[16:20].decode("latin-1") if profile and len(profile) >= 20 else None
    if profile and (space not in ("RGB ", "GRAY") or (space == "GRAY" and not grey)):
        dropped.append(f"ICC profile ({(space or 'damaged').strip()} on these samples)")
        meta["icc"] = profile = None
    grey &= space != "RGB " or not profile
    meta["density"] = jpeg_density(meta.get("density"))
    for key, title, extra in (("exif", "EXIF", 6), ("xmp", "XMP", 29)):
        size = len(meta[key].encode() if isinstance(meta.get(key), str) else meta.get(key) or b"")
        if size + extra > 65533:
            dropped.append(f"{title} (larger than a segment)")
            meta[key] = None
    carried += [title for key, title in (("density", "density"), ("exif", "EXIF"), ("xmp", "XMP"), ("icc", "ICC profile"), ("comments", "comments")) if meta.get(key)]
    out = jpeg_pixels.jpeg_file(rgb, meta, options.get("quality") or 90, options.get("subsampling") or "4:2:0", progressive=options.get("progressive") is True, grey=grey)
    return out, carried, dropped


def size_notes(data: bytes, source: str, target: str) -> list[str]:
    """That a lossy source grows where it is written without loss."""
    lossy = source in ("jpeg", "heic") or (source == "avif" and not is_lossless_avif(data)) or (source == "webp" and any(k == b"VP8 " for k, _ in riff(data)))
    return [f"{source} is lossy: {target} without loss is several times its size; jpeg stays small"] if lossy and target != "jpeg" else []


def sanitized(data: bytes, name: str, keep_thumbnails: bool, limits: Limits) -> tuple[bytes, list[str]]:
    """A file of its own format without previews."""
    if name == "jpeg":
        return sanitized_jpeg(data, keep_thumbnails)
    if keep_thumbnails:
        return data, []
    if name == "jxl":
        boxes, codestream, container = jxl.read(data, limits)
        own = [b for b in boxes if b[0] not in (b"ftyp", b"jxlc", b"jxlp")]
        kept, gone = jxl.sanitized([b for b in own if b[0] not in jxl.STRUCTURE])
        return (jxl.written([b for b in own if b[0] in jxl.STRUCTURE] + kept, codestream), gone) if gone and container else (data, [])
    parts = png.chunks(data, limits)
    kept, gone = sanitized_parts(parts, limits.max_metadata_bytes)
    return (png.joined(kept), gone) if gone else (data, [])


def convert(data: bytes, decoders: tuple[Decoder, ...] = (), **options) -> Converted:
    """A plain file in another format, or in its own without previews. Options: format, quality, subsampling,
    background, progressive, keep_thumbnails, metadata (a policy), limits."""
    limits, options = resolved(options.pop("limits", None)), checked(options)
    limits.input_size(data)
    given = policy(options["metadata"]) if options.get("metadata") is not None else None
    source = known_format(data)
    target, keep = target_format(source, options.get("format")), bool(options.get("keep_thumbnails"))
    if source == target:
        content, dropped = sanitized(data, source, keep, limits)
        out = Converted(content, target, source, "none", ["all metadata"], dropped)
    else:
        if is_scrambled(data):
            raise ImageError("ALREADY_SCRAMBLED", "the file is scrambled; another format would lose the picture")
        if target == "jxl":
            raise no_codec("writing")
        picture, title, notes = picture_of(data, source, decoders, limits)
        picture.meta, picture.dropped = merged_meta(data, picture, keep, limits)
        content, carried, dropped = jpeg_of(picture, options) if target == "jpeg" else raster.png_file(picture)
        out = Converted(content, target, source, title, carried, list(dict.fromkeys(dropped)), [*notes, *size_notes(data, source, target)])
    if given is not None:
        out.content, out.report = applied(out.content, given, limits, strip_thumbnails=not keep)
    return out


# ---- the verbs


def watermark_option(mark) -> dict | None:
    """A watermark to carry: an id, or a compiled one."""
    if mark is None:
        return None
    if isinstance(mark, str) or set(mark) == {"id"}:
        import re

        name = mark if isinstance(mark, str) else mark["id"]
        if not isinstance(name, str) or not re.fullmatch(ID, name):
            raise ImageError("BAD_WATERMARK", f"no watermark id: {name!r}")
        return {"id": name}
    return compiled(mark)


def encode(data: bytes, key: str | bytes, salt: bytes | None = None, decoders: tuple[Decoder, ...] = (), **options) -> bytes:
    """A picture of any format scrambled as the target format, without previews and under a policy.

    Options besides convert()'s: mode (PNG: block or pixel), block, transforms, level, progressive,
    watermark (to carry), visible_watermark (to show while scrambled).
    """
    key, options = key_bytes(key), dict(options)
    mark, visible = watermark_option(options.pop("watermark", None)), options.pop("visible_watermark", None)
    visible = None if visible is None else compiled(visible)
    limits = resolved(options.get("limits"))
    limits.input_size(data)
    source = known_format(data)
    target = target_format(source, options.get("format"))
    mode = options.get("mode")
    if (target == "jpeg" and mode not in (None, "mcu")) or (target == "png" and mode == "mcu"):
        raise ImageError("BAD_OPTION", f"mode {mode} is not for {target}")
    if is_scrambled(data):
        raise ImageError("ALREADY_SCRAMBLED", "the file is scrambled; change its key instead")
    if target == "jxl":
        raise no_codec("scrambling")
    plain = convert(data, decoders, **{**options, "format": target}).content
    turned = options.get("transforms")
    if target == "jpeg":
        again = options.get("progressive")
        return jpeg.scrambled(plain, key, salt, turned is not False, "auto" if again is None else again, mark, visible, limits)
    level = options.get("level")
    return png.scrambled(plain, key, salt, mode or "block", options.get("block") or 16, turned is not False, 6 if level is None else level, mark, visible, True, limits)


def chosen_watermark(asked, carried: dict | None, find: Callable[[str], dict | None] | None = None) -> dict | None:
    """The watermark to draw: none, the one that the file carries (True), one by id, or the one given."""
    if not asked:
        return None

    def looked_up(name: str) -> dict:
        got = find(name) if find else None
        if got is None:
            raise ImageError("BAD_WATERMARK", f"watermark {name!r} is not found")
        return got

    if asked is True or asked == "embedded":
        return None if carried is None else carried["compiled"] or looked_up(carried["id"])
    if isinstance(asked, str):
        return looked_up(asked)
    return looked_up(asked["id"]) if set(asked) == {"id"} else asked


def decode(data: bytes, key: str | bytes, watermark=None, find: Callable[[str], dict | None] | None = None, metadata=None, limits=None) -> bytes:
    """A scrambled file restored in its format, under a policy, with a watermark drawn if one is asked for."""
    key, limits = key_bytes(key), resolved(limits)
    limits.input_size(data)
    name = known_format(data)
    if name == "jxl":
        raise no_codec("restoring")
    if name not in ("png", "jpeg"):
        raise ImageError("UNSUPPORTED", f"{name} files are never scrambled")
    if metadata is not None:
        data, _ = applied(data, metadata, limits)
    body = png.own_part(png.chunks(data, limits), png.WATERMARK) if name == "png" else jpeg.own_part(jpeg.parsed(data, limits)[0], jpeg.WATERMARK)
    carried, error = read_carried(body, limits)
    if error is not None and watermark in (True, "embedded"):
        raise error
    paint = chosen_watermark(watermark, carried, find)
    return png.restored(data, key, paint=paint, limits=limits) if name == "png" else jpeg.restored(data, key, paint=paint, limits=limits)


def rekey(data: bytes, old: str | bytes, new: str | bytes, salt: bytes | None = None, metadata=None, limits=None, **options) -> bytes:
    """A scrambled file under a new key, in its format; mode, block and transforms as they were unless given."""
    old, new, limits, options = key_bytes(old), key_bytes(new), resolved(limits), checked(options)
    limits.input_size(data)
    name = known_format(data)
    if options.get("format") not in (None, name):
        raise ImageError("BAD_OPTION", f"a change of key keeps the format ({name})")
    if name == "jxl":
        raise no_codec("a change of key")
    if name not in ("png", "jpeg"):
        raise ImageError("UNSUPPORTED", f"{name} files are never scrambled")
    if (name == "png" and options.get("mode") == "mcu") or (name == "jpeg" and options.get("mode") not in (None, "mcu")):
        raise ImageError("BAD_OPTION", f"mode {options['mode']} is not for {name}")
    if metadata is not None:
        data, _ = applied(data, metadata, limits)
    if name == "jpeg":
        return jpeg.rekeyed(data, old, new, salt, options.get("transforms"), options.get("progressive", "auto"), limits)
    return png.rekeyed(data, old, new, salt, options.get("mode"), options.get("block"), options.get("transforms"), limits=limits)


def inspect(data: bytes, metadata: bool = False, limits=None) -> dict:
    """What the heads of a file tell: format, size, frames, whether it is scrambled and how; its metadata if asked for."""
    limits = resolved(limits)
    limits.input_size(data)
    name = known_format(data)
    own = {"png": png.info, "jpeg": jpeg.info, "jxl": jxl.info}.get(name)
    if own is None:
        return other_info(data, name, limits)
    out = {"format": name, **own(data, limits)}
    if name == "jpeg":
        from rasterloom.watermark.carried import carried_info

        out["watermark"] = carried_info(jpeg.own_part(jpeg.parsed(data, limits)[0], jpeg.WATERMARK), limits)
    return {**out, "meta": metadata_of(data, limits)} if metadata else out


def apply_metadata(data: bytes, given, limits=None, strip_thumbnails: bool = False) -> tuple[bytes, Report]:
    limits = resolved(limits)
    limits.input_size(data)
    return applied(data, given, limits, strip_thumbnails)
