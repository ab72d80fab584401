"""Samples of PNG files as RGBA and back: the smallest colour type that loses nothing, animations as whole frames."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field, replace

import numpy as np

from rasterloom.functions.errors import ImageError
from rasterloom.functions.geometry import apng_delay
from rasterloom.functions.limits import DEFAULTS, Limits
from rasterloom.metadata.text import XMP_KEYWORD, text_chunk
from rasterloom.sources import png
from rasterloom.sources.png import Header

#: Chunks that hold for a palette or few bits only, and what a grey file loses besides.
OF_SAMPLES = (b"PLTE", b"tRNS", b"bKGD", b"hIST", b"sBIT")


@dataclass
class Animation:
    frames: list[np.ndarray]  # whole pictures
    delays: list[tuple[int, int]]
    plays: int = 0
    hidden: bool = False  # whether the still picture is none of them


@dataclass
class Picture:
    """RGBA samples (height, width, 4), 8 or 16 bits, with what goes with them."""

    rgba: np.ndarray
    depth: int = 8
    animation: Animation | None = None
    meta: dict = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)


def transparent_key(parts: list[tuple[bytes, bytes]], channels: int) -> np.ndarray | None:
    data = png.own_part(parts, b"tRNS") or b""
    return np.frombuffer(data[: 2 * channels], ">u2").astype(np.int64) if len(data) >= 2 * channels else None


def rgba(head: Header, raster: np.ndarray, parts: list[tuple[bytes, bytes]], depth: int = 8) -> np.ndarray:
    """Samples of any kind as RGBA of 8 bits (of 16 the high byte), or of 16."""
    most = (1 << depth) - 1
    if head.color_type == 3:
        palette, alphas = png.own_part(parts, b"PLTE"), png.own_part(parts, b"tRNS") or b""
        if palette is None:
            raise ImageError("CORRUPT", "no palette")
        table = np.zeros((256, 4), np.uint8)
        table[: len(palette) // 3, :3] = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)[:256]
        table[: len(palette) // 3, 3] = 255
        table[: len(alphas), 3] = np.frombuffer(alphas, np.uint8)[:256]
        return table[raster[:, :, 0]]
    values = np.ascontiguousarray(raster).view(">u2").astype(np.int64) if head.depth == 16 else raster.astype(np.int64)
    channels = values.shape[2]
    color = channels - (channels in (2, 4))
    key = transparent_key(parts, color) if channels == color else None
    alpha = values[:, :, color:] if channels > color else np.where((values == key).all(2, keepdims=True) if key is not None else False, 0, (1 << head.depth) - 1) * np.ones(values.shape[:2] + (1,), np.int64)
    out = np.concatenate([np.repeat(values[:, :, :1], 3, 2) if color == 1 else values[:, :, :3], alpha], 2)
    if head.depth == 16:
        return (out >> 8).astype(np.uint8) if depth == 8 else out.astype(np.uint16)
    scaled = out * most // ((1 << head.depth) - 1)
    return scaled.astype(np.uint8 if depth == 8 else np.uint16)


def composed(parts: list[tuple[bytes, bytes]], head: Header, sizes: list[Header], rasters: list[np.ndarray]) -> Animation | None:
    """An animation's frames as they are seen: each drawn over what the ones before have left."""
    control = [body for kind, body in parts if kind == b"fcTL"]
    if not control:
        return None
    kinds = [kind for kind, _ in parts]
    hidden = kinds.index(b"fcTL") > kinds.index(b"IDAT")
    canvas, out = np.zeros((head.height, head.width, 4), np.uint8), Animation([], [], 0, hidden)
    counts = png.own_part(parts, b"acTL")
    out.plays = int.from_bytes(counts[4:8], "big") if counts and len(counts) == 8 else 0
    for k, body in enumerate(control):
        if k + hidden >= len(rasters):
            break
        w, h, x, y, n, d, dispose, blend = struct.unpack_from(">4IHHBB", body, 4)
        own = rgba(sizes[k + hidden], rasters[k + hidden], parts)
        area = canvas[y : y + h, x : x + w]
        before = area.copy()
        if blend:
            top, under = own.astype(np.float64), area.astype(np.float64)
            a = top[:, :, 3:]
            rest = under[:, :, 3:] * (255 - a) / 255
            whole = a + rest
            color = np.divide(top[:, :, :3] * a + under[:, :, :3] * rest, whole, out=np.zeros(top[:, :, :3].shape), where=whole > 0)
            mixed = np.floor(np.concatenate([color, whole], 2) + 0.5).astype(np.uint8)
            area[...] = np.where(a == 255, own, np.where(a == 0, area, mixed))
        else:
            area[...] = own[: area.shape[0], : area.shape[1]]
        out.frames.append(canvas.copy())
        out.delays.append((n, d or 100))
        if dispose == 2 and k:
            area[...] = before
        elif dispose:
            area[...] = 0
    return out


def decoded(data: bytes, limits: Limits = DEFAULTS) -> Picture:
    """A PNG file's picture; 16 bits stay where it is no animation."""
    parts = png.chunks(data, limits)
    head = png.header(parts, limits.max_pixels)
    sizes, rasters = png.rasters_of(parts, head, limits)
    animation = composed(parts, head, sizes, rasters)
    dropped = ["animation (first frame kept)"] if animation else []
    if animation and animation.hidden:
        return Picture(animation.frames[0], 8, animation, dropped=dropped + (["precision above 8 bits"] if head.depth == 16 else []))
    depth = 16 if head.depth == 16 else 8
    return Picture(rgba(sizes[0], rasters[0], parts, depth), depth, animation, dropped=dropped)


# ---- the smallest kind of file


def smallest(pixels: np.ndarray, depth: int, space: str | None) -> tuple[Header, np.ndarray, list[tuple[bytes, bytes]]] | None:
    """(head of a frame's kind, samples, palette chunks) for RGBA rows; None where a grey profile has coloured samples.

    A profile of RGB forbids grey files, one of grey demands them.
    """
    rows, width = pixels.shape[:2]
    grey = bool((pixels[:, :, 0] == pixels[:, :, 1]).all() and (pixels[:, :, 0] == pixels[:, :, 2]).all())
    opaque = bool((pixels[:, :, 3] == (1 << depth) - 1).all())
    if space == "GRAY" and not grey:
        return None
    grey &= space != "RGB "
    made = lambda kind, bits, x: (Header(width, rows, bits, kind), np.ascontiguousarray(x), [])
    if depth == 16:
        keep = ([0] if grey else [0, 1, 2]) + ([] if opaque else [3])
        kind = {1: 0, 2: 4, 3: 2, 4: 6}[len(keep)]
        return made(kind, 16, np.ascontiguousarray(pixels[:, :, keep]).astype(">u2").view(np.uint8).reshape(rows, width, -1))
    if grey and opaque:
        level = pixels[:, :, :1]
        bits = next((b for b in (1, 2, 4) if not (level % (255 // ((1 << b) - 1))).any()), 8)
        return made(0, bits, level // (255 // ((1 << bits) - 1)))
    if grey:
        return made(4, 8, pixels[:, :, [0, 3]])
    packed = np.ascontiguousarray(pixels).view("<u4").reshape(-1)
    colors, first, index = np.unique(packed, return_index=True, return_inverse=True)
    if len(colors) <= 256:  # numbered as they first appear
        order = np.argsort(first)
        number = np.empty(len(colors), np.uint8)
        number[order] = np.arange(len(colors))
        table = colors[order].astype("<u4").view(np.uint8).reshape(-1, 4)
        bits = next(b for b in (1, 2, 4, 8) if len(colors) <= 1 << b)
        clear = np.flatnonzero(table[:, 3] != 255)
        extra = [(b"PLTE", table[:, :3].tobytes())] + ([(b"tRNS", table[: clear[-1] + 1, 3].tobytes())] if len(clear) else [])
        return Header(width, rows, bits, 3), number[index].reshape(rows, width, 1), extra
    return made(2, 8, pixels[:, :, :3]) if opaque else made(6, 8, pixels)


def png_file(picture: Picture, level: int = 6) -> tuple[bytes, list[str], list[str]]:
    """(file, what was carried over, what was dropped) of a picture with its metadata."""
    depth, meta, dropped = picture.depth, picture.meta, list(picture.dropped)
    frames = picture.animation.frames if picture.animation and len(picture.animation.frames) > 1 else None
    if frames:
        dropped = [d for d in dropped if not d.startswith("animation")]
    data, depth = (np.concatenate(frames), 8) if frames else (picture.rgba, depth)
    if depth == 16 and not (data % 257).any():
        data, depth = (data // 257).astype(np.uint8), 8
    profile = meta.get("icc")
    space = profile[16:20].decode("latin-1") if profile and len(profile) >= 20 else None
    if profile and space not in ("RGB ", "GRAY"):
        dropped.append(f"ICC profile ({(space or 'damaged').strip()} colour space)")
        profile = None
    got = smallest(data, depth, space if profile else None)
    if got is None:
        dropped.append("ICC profile (of grey, on a coloured picture)")
        profile, got = None, smallest(data, depth, None)
    kind, samples, extra = got
    height, width = picture.rgba.shape[:2]
    head = replace(kind, height=height)
    parts, carried = [(b"IHDR", struct.pack(">IIBBBBB", width, height, head.depth, head.color_type, 0, 0, 0))], ["animation"] if frames else []
    if profile:
        parts.append((b"iCCP", b"ICC profile\0\0" + zlib.compress(profile, 9)))
        carried.append("ICC profile")
    if meta.get("density"):
        x, y, unit = meta["density"]
        parts.append((b"pHYs", struct.pack(">IIB", x, y, unit == "meter")))
        carried.append("density")
    if meta.get("exif"):
        parts.append((b"eXIf", meta["exif"]))
        carried.append("EXIF")
    if meta.get("xmp"):
        parts.append((b"iTXt", XMP_KEYWORD.encode() + b"\0\0\0\0\0" + meta["xmp"].encode()))
        carried.append("XMP")
    parts += [text_chunk("Comment", c) for c in meta.get("comments", ())]
    carried += ["comments"] if meta.get("comments") else []
    parts += extra
    if frames:
        parts.append((b"acTL", struct.pack(">II", len(frames), picture.animation.plays)))
        number = 0
        for k, delay in enumerate(picture.animation.delays):
            n, d = apng_delay(*delay)
            parts.append((b"fcTL", struct.pack(">5IHHBB", number, width, height, 0, 0, n, d, 0, 0)))
            stream = png.encoded(head, samples[k * height : (k + 1) * height], level)
            number += 1
            parts.append((b"fdAT", number.to_bytes(4, "big") + stream) if k else (b"IDAT", stream))
            number += k > 0
    else:
        parts.append((b"IDAT", png.encoded(head, samples, level)))
    return png.joined([*parts, (b"IEND", b"")]), carried, dropped


def painted(parts, head: Header, sizes: list[Header], rasters: list[np.ndarray], mark: dict, orientation: int, limits: Limits = DEFAULTS):
    """(parts, sizes, rasters) with a watermark over each frame that holds it. Palettes and few bits become
    8-bit RGBA, as they do not have its colours."""
    from rasterloom.watermark.definition import compiled
    from rasterloom.watermark.paint import color_key, holds, painted_samples
    from rasterloom.watermark.render import rendered_stored

    patch = rendered_stored(compiled(mark), head.width, head.height, orientation, limits)
    if patch is None:
        return parts, sizes, rasters
    if head.color_type == 3 or head.depth < 8:
        rasters = [rgba(s, r, parts) for s, r in zip(sizes, rasters)]
        sizes = [replace(s, depth=8, color_type=6) for s in sizes]
        gone = OF_SAMPLES + ((b"iCCP",) if head.color_type == 0 else ())
        parts = [(k, d[:8] + b"\x08\x06" + d[10:] if k == b"IHDR" else d) for k, d in parts if k not in gone]
        head = replace(head, depth=8, color_type=6)
    at, key = png.places(parts), color_key(parts, head.color_type)
    return parts, sizes, [r if i and not holds(x, y, r.shape[1], r.shape[0], patch) else painted_samples(r, head.depth, patch, x, y, key) for i, (r, (x, y)) in enumerate(zip(rasters, at))]
