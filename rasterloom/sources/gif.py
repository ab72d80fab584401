"""GIF files: frames by LZW, drawn over each other as their disposal says."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from rasterloom.functions.errors import ImageError
from rasterloom.functions.limits import DEFAULTS, Limits
from rasterloom.sources.raster import Animation, Picture

# First row and step of each interlace pass.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


def bad(message: str) -> ImageError:
    return ImageError("BAD_GIF", message)


@dataclass
class Image:
    x: int
    y: int
    width: int
    height: int
    interlaced: bool
    palette: bytes
    transparent: int | None
    disposal: int
    delay: int
    size: int
    data: bytes


def read(data: bytes, limits: Limits = DEFAULTS) -> tuple[int, int, list[Image], int | None]:
    """(width, height, images, repeats: null without the extension that counts them)."""
    if len(data) < 13 or data[:4] != b"GIF8":
        raise bad("not a GIF file")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    limits.pixels(width, height)
    at = 13

    def table(bits: int) -> bytes:
        nonlocal at
        size = 3 << (bits & 7) + 1 if bits & 0x80 else 0
        at += size
        return data[at - size : at]

    def blocks() -> bytes:
        nonlocal at
        out = []
        while at < len(data) and data[at]:
            out.append(data[at + 1 : at + 1 + data[at]])
            at += data[at] + 1
        at += 1
        return b"".join(out)

    shared, images, repeats = table(flags), [], None
    control = (0, 0, None)  # disposal, delay, transparent index
    while at < len(data) and data[at] in (0x21, 0x2C):
        if data[at] == 0x21:
            kind, first = data[at + 1 : at + 2], data[at + 3 : at + 14]
            at += 2
            body = blocks()
            if kind == b"\xf9" and len(body) >= 4:
                control = (body[0] >> 2 & 7, int.from_bytes(body[1:3], "little"), body[3] if body[0] & 1 else None)
            elif kind == b"\xff" and first == b"NETSCAPE2.0" and len(body) >= 14 and body[11] == 1:
                repeats = int.from_bytes(body[12:14], "little")
            continue
        if at + 10 > len(data):
            break
        x, y, w, h, bits = struct.unpack_from("<4HB", data, at + 1)
        at += 10
        own = table(bits)
        size = data[at] if at < len(data) else 0
        at += 1
        disposal, delay, clear = control
        images.append(Image(x, y, w, h, bool(bits & 0x40), own or shared, clear, disposal, delay, size, blocks()))
        limits.pixels(w, h, "frame")
        control = (0, 0, None)
    if len(images) > 1:
        limits.frames(len(images), len(images) * width * height)
    if not images:
        raise bad("no image")
    return width, height, images, repeats


def unpacked(size: int, data: bytes, most: int) -> np.ndarray:
    """Palette indices of LZW data, as far as they can be read, and no more than `most`."""
    if not 1 <= size <= 11:
        raise bad(f"code size {size}")
    clear = 1 << size
    plain = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, out, got = list(plain), [], 0
    width, before, bits, held = size + 1, None, 0, 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & (1 << width) - 1
            held >>= width
            bits -= width
            if code == clear:
                table, width, before = list(plain), size + 1, None
                continue
            if code == clear + 1:
                return joined(out, most)
            if before is None:
                if code > clear:
                    return joined(out, most)
                now = table[code]
            else:
                if code > len(table) or (code == len(table) and len(table) >= 4096):
                    return joined(out, most)
                now = table[code] if code < len(table) else before + before[:1]
                if len(table) < 4096:
                    table.append(before + now[:1])
                    if len(table) == 1 << width and width < 12:
                        width += 1
            out.append(now)
            before = now
            got += len(now)
            if got >= most:
                return joined(out, most)
    return joined(out, most)


def joined(parts: list[bytes], most: int) -> np.ndarray:
    return np.frombuffer(b"".join(parts)[:most], np.uint8)


def draw(canvas: np.ndarray, image: Image) -> None:
    """An image over a canvas; transparent pixels and what lies outside are left out."""
    index = unpacked(image.size, image.data, image.width * image.height)
    rows = np.arange(image.height)
    if image.interlaced:
        rows = np.concatenate([np.arange(first, image.height, step) for first, step in PASSES])
    place = np.arange(len(index))
    y, x = image.y + rows[place // max(1, image.width)], image.x + place % max(1, image.width)
    colors = np.frombuffer(image.palette[: len(image.palette) // 3 * 3], np.uint8).reshape(-1, 3)
    seen = (y < canvas.shape[0]) & (x < canvas.shape[1]) & (index < len(colors))
    if image.transparent is not None:
        seen &= index != image.transparent
    canvas[y[seen], x[seen], :3] = colors[index[seen]]
    canvas[y[seen], x[seen], 3] = 255


def decoded(data: bytes, limits: Limits = DEFAULTS) -> Picture:
    """The picture, or the animation's frames as whole pictures. Delays of at most a hundredth of a second are played as ten."""
    width, height, images, repeats = read(data, limits)
    canvas, frames, delays = np.zeros((height, width, 4), np.uint8), [], []
    for image in images:
        before = canvas.copy() if image.disposal == 3 else None
        draw(canvas, image)
        frames.append(canvas.copy())
        delays.append((image.delay if image.delay > 1 else 10, 100))
        if image.disposal == 2:
            canvas[image.y : image.y + image.height, image.x : image.x + image.width] = 0
        elif before is not None:
            canvas = before
    if len(frames) == 1:
        return Picture(frames[0])
    plays = 1 if repeats is None else repeats + 1 if repeats else 0
    return Picture(frames[0], 8, Animation(frames, delays, plays), dropped=["animation (first frame kept)"])
