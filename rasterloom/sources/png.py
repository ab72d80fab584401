"""PNG and animated PNG files as bytes: chunks, rasters, keyed scrambling.

A raster is an array (height, width, bytes of a pixel); depths under 8 take one byte a pixel, 16-bit
samples two, high byte first. Errors carry a code; the column functions of images.py turn them into a
status instead of failing a job.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, replace

import numpy as np

from rasterloom.functions.errors import ImageError, wrong_key
from rasterloom.functions.keys import TRANSFORMS, layout, seed
from rasterloom.functions.limits import DEFAULTS, Limits
from rasterloom.functions.params import STASHED, Params, fitted, marker, params, read_marker, same_check

# Fixed values of the format: signature, channels and depths by colour type, the interlace passes (first column and row, steps).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: Own chunks: the parameters of a scrambled file, a carried watermark, what a visible one covers.
MARKER, WATERMARK, STASH = b"rlSc", b"rlWm", b"rlWs"
OWN = (MARKER, WATERMARK, STASH)
MAX_PIXELS = DEFAULTS.max_pixels
#: Rows that are filtered at a time.
BAND = 256


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    depth: int
    color_type: int
    interlace: int = 0

    @property
    def pixel_bytes(self) -> int:
        return max(1, CHANNELS[self.color_type] * self.depth // 8)

    def passes(self) -> list[tuple[slice, slice, int, int]]:
        """(rows, columns, width, height) of each pass that has pixels."""
        steps = ADAM7 if self.interlace else ((0, 0, 1, 1),)
        sizes = [(slice(y, None, dy), slice(x, None, dx), -((x - self.width) // dx), -((y - self.height) // dy)) for x, y, dx, dy in steps]
        return [p for p in sizes if p[2] > 0 and p[3] > 0]

    def row_bytes(self, width: int) -> int:
        return -(-width * CHANNELS[self.color_type] * self.depth // 8)


def is_png(data: bytes) -> bool:
    return data.startswith(SIGNATURE)


def chunks(data: bytes, limits: Limits = DEFAULTS) -> list[tuple[bytes, bytes]]:
    """(type, data) up to IEND; a wrong checksum or a cut chunk is an error."""
    if not data.startswith(SIGNATURE):
        raise ImageError("UNSUPPORTED_FORMAT", "not a PNG file")
    out, at = [], len(SIGNATURE)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ImageError("CORRUPT", f"chunk at {at} is cut or has a wrong checksum")
        out.append((kind, body))
        limits.chunks(len(out))
        at += 12 + size
        if kind == b"IEND":
            return out
    raise ImageError("CORRUPT", "no IEND chunk")


def joined(parts: list[tuple[bytes, bytes]]) -> bytes:
    return SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def header(parts: list[tuple[bytes, bytes]], max_pixels: float = MAX_PIXELS) -> Header:
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise ImageError("CORRUPT", "IHDR is missing")
    width, height, depth, color, method, filters, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if not 0 < width < 1 << 31 or not 0 < height < 1 << 31 or depth not in DEPTHS.get(color, ()) or method or filters or interlace > 1:
        raise ImageError("CORRUPT", "IHDR holds values outside the format")
    if width * height > max_pixels:
        raise ImageError("LIMIT", f"{width} x {height} pixels; the limit is {max_pixels}")
    return Header(width, height, depth, color, interlace)


def guesses(rows: np.ndarray, bpp: int):
    """What each of the five filters predicts for whole rows (height, bytes), one after the other."""
    up, left, corner = (np.zeros(rows.shape, np.int16) for _ in range(3))
    up[1:], left[:, bpp:], corner[1:, bpp:] = rows[:-1], rows[:, :-bpp], rows[:-1, :-bpp]
    yield np.zeros(rows.shape, np.int16)
    yield left
    yield up
    yield (left + up) >> 1
    yield nearest(left, up, corner)


def nearest(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of three neighbours that nearest to left + up - corner; ties in the order given."""
    far = np.stack([np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)])
    return np.choose(far.argmin(0), [left, up, corner])


def filtered_rows(rows: np.ndarray, bpp: int, adaptive: bool) -> bytes:
    """Rows with their filter bytes: per row the filter of the least sum of magnitudes, the first of equals."""
    out = np.zeros((len(rows), rows.shape[1] + 1), np.uint8)
    if not adaptive:
        out[:, 1:] = rows
        return out.tobytes()
    for lo in range(0, len(rows), BAND):  # a band of rows with the one above it
        top = max(0, lo - 1)
        band = rows[top : lo + BAND]
        here = slice(lo - top, len(band))
        best = np.full(len(band) - (lo - top), 1 << 62)
        for kind, guess in enumerate(guesses(band, bpp)):
            left = (band[here] - guess[here]).astype(np.uint8)
            cost = np.minimum(left, 256 - left.astype(np.int16)).sum(1, dtype=np.int64)
            won = np.flatnonzero(cost < best)
            best[won] = cost[won]
            out[lo + won, 0], out[lo + won, 1:] = kind, left[won]
    return out.tobytes()


def unfiltered_rows(raw: np.ndarray, bpp: int) -> np.ndarray:
    """Undoes filtered_rows. Pixels of one anti-diagonal depend on earlier diagonals only, so each is one step."""
    kinds, (h, n) = raw[:, 0], raw[:, 1:].shape
    if kinds.max(initial=0) > 4:
        raise ImageError("CORRUPT", "unknown filter")
    if not kinds.any():
        return raw[:, 1:]
    if kinds.max() <= 2:  # sums along a row, or with the row above
        out = raw[:, 1:].copy()
        for y, kind in enumerate(kinds.tolist()):
            if kind == 1:
                out[y] = np.cumsum(out[y].reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
            elif kind == 2 and y:
                out[y] += out[y - 1]
        return out
    w = n // bpp
    given, out = raw[:, 1:].reshape(h, w, bpp).astype(np.int16), np.zeros((h + 1, w + 1, bpp), np.int16)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = np.choose(kinds[y][:, None], [np.int16(0), left, up, (left + up) >> 1, nearest(left, up, corner)])
        out[y + 1, x + 1] = (given[y, x] + guess) & 255
    return out[1:, 1:].reshape(h, n).astype(np.uint8)


def decoded(head: Header, stream: bytes) -> np.ndarray:
    """The raster of a compressed stream. No more is inflated than the header's size needs."""
    sizes = [(p, head.row_bytes(p[2]) + 1) for p in head.passes()]
    need = sum(p[3] * n for p, n in sizes)
    try:
        raw = zlib.decompressobj().decompress(stream, need)
    except zlib.error as e:
        raise ImageError("CORRUPT", f"image data: {e}") from e
    if len(raw) < need:
        raise ImageError("CORRUPT", "image data is too short")
    out, at = np.zeros((head.height, head.width, head.pixel_bytes), np.uint8), 0
    for (ys, xs, w, h), n in sizes:
        rows = unfiltered_rows(np.frombuffer(raw, np.uint8, h * n, at).reshape(h, n), head.pixel_bytes)
        at += h * n
        if head.depth < 8:
            shifts = np.arange(8 - head.depth, -1, -head.depth, dtype=np.uint8)
            rows = ((rows[:, :, None] >> shifts) & np.uint8((1 << head.depth) - 1)).reshape(h, -1)[:, :w]
        out[ys, xs] = rows.reshape(h, w, head.pixel_bytes)
    return out


def encoded(head: Header, raster: np.ndarray, level: int = 6, adaptive: bool = True) -> bytes:
    """The compressed stream of a raster. Filters are chosen only for whole-byte samples without a palette."""
    out = []
    for ys, xs, w, h in head.passes():
        rows = np.ascontiguousarray(raster[ys, xs]).reshape(h, -1)
        if head.depth < 8:
            per = 8 // head.depth
            wide = np.pad(rows, ((0, 0), (0, -w % per))).reshape(h, -1, per).astype(np.uint16)
            rows = (wide << np.arange(8 - head.depth, -1, -head.depth)).sum(2).astype(np.uint8)
        out.append(filtered_rows(rows, head.pixel_bytes, adaptive and head.depth >= 8 and head.color_type != 3))
    return zlib.compress(b"".join(out), level)


def png_file(head: Header, raster: np.ndarray, extra: tuple[tuple[bytes, bytes], ...] = (), level: int = 6) -> bytes:
    ihdr = struct.pack(">IIBBBBB", head.width, head.height, head.depth, head.color_type, 0, 0, head.interlace)
    return joined([(b"IHDR", ihdr), *extra, (b"IDAT", encoded(head, raster, level)), (b"IEND", b"")])


def frames(parts: list[tuple[bytes, bytes]], head: Header, limits: Limits = DEFAULTS) -> list[tuple[Header, bytes]]:
    """(header of its size, stream) of the still image, or of each animation frame in order; a still
    image that the animation leaves out is the first."""
    out: list[tuple[Header, bytes]] = []
    check_frames(parts, limits)
    size = head
    fresh = True
    for kind, body in parts:
        if kind == b"fcTL":
            if len(body) != 26:
                raise ImageError("CORRUPT", "fcTL has a wrong size")
            size, fresh = replace(head, width=int.from_bytes(body[4:8], "big"), height=int.from_bytes(body[8:12], "big")), True
            if not (0 < size.width <= head.width and 0 < size.height <= head.height):
                raise ImageError("CORRUPT", "a frame is larger than its image")
        elif kind in (b"IDAT", b"fdAT"):
            data = body[4:] if kind == b"fdAT" else body
            if fresh:
                out.append((size, data))
                fresh = False
            else:
                out[-1] = (out[-1][0], out[-1][1] + data)
    if not out:
        raise ImageError("CORRUPT", "no image data")
    return out


def check_frames(parts: list[tuple[bytes, bytes]], limits: Limits = DEFAULTS) -> None:
    """Sizes and number of animation frames, which their heads tell without decoding."""
    sizes = [struct.unpack_from(">II", body, 4) for kind, body in parts if kind == b"fcTL" and len(body) == 26]
    for w, h in sizes:
        limits.pixels(w, h, "frame")
    limits.frames(len(sizes), sum(w * h for w, h in sizes))


def places(parts: list[tuple[bytes, bytes]]) -> list[tuple[int, int]]:
    """Where each of frames() lies in the picture."""
    out, at, fresh = [], (0, 0), True
    for kind, body in parts:
        if kind == b"fcTL":
            at, fresh = struct.unpack_from(">II", body, 12), True
        elif kind in (b"IDAT", b"fdAT") and fresh:
            out.append(at)
            fresh = False
    return out


def with_streams(parts: list[tuple[bytes, bytes]], streams: list[bytes], own: dict[bytes, bytes] | None = None) -> bytes:
    """The file with each frame's data in one chunk, other chunks kept in order, sequence numbers made
    anew; own chunks go before image data, what a watermark covers to the end."""
    out, left, fresh, number, own = [], iter(streams), True, 0, dict(own or {})
    stash = own.pop(STASH, None)
    for kind, body in parts:
        if kind in OWN:
            continue
        if kind == b"IEND" and stash is not None:
            out.append((STASH, stash))
        if kind == b"fcTL":
            fresh = True
            out.append((kind, number.to_bytes(4, "big") + body[4:]))
            number += 1
        elif kind in (b"IDAT", b"fdAT"):
            if not fresh:
                continue
            if kind == b"IDAT":
                out += own.items()
                own = {}
            data = next(left)
            out.append((kind, data if kind == b"IDAT" else number.to_bytes(4, "big") + data))
            number += kind == b"fdAT"
            fresh = False
        else:
            out.append((kind, body))
    return joined(out)


def own_part(parts: list[tuple[bytes, bytes]], kind: bytes) -> bytes | None:
    return next((d for k, d in parts if k == kind), None)


def marker_of(parts: list[tuple[bytes, bytes]]) -> dict | None:
    """Mode, block, salt, flags and check of a scrambled file."""
    body = own_part(parts, MARKER)
    if body is None:
        return None
    p, check = read_marker(body)
    return {"mode": p.mode, "block": p.block, "salt": p.salt, "flags": p.flags, "check": check, "params": p}


def orientation_of(parts: list[tuple[bytes, bytes]]) -> int:
    from rasterloom.sources import exif

    block = own_part(parts, b"eXIf")
    return exif.quick_orientation(block) if block else 1


def rasters_of(parts: list[tuple[bytes, bytes]], head: Header, limits: Limits = DEFAULTS) -> tuple[list[Header], list[np.ndarray]]:
    """(size, samples) of all frames."""
    found = frames(parts, head, limits)
    need = sum(h.row_bytes(p[2]) * p[3] + p[3] for h, _ in found for p in h.passes())
    if need > limits.max_decompressed_bytes:
        raise ImageError("LIMIT", f"image data inflate to {need} bytes; the limit is max_decompressed_bytes")
    return [h for h, _ in found], [decoded(h, s) for h, s in found]


def file_of(parts, head: Header, sizes: list[Header], rasters: list[np.ndarray], key: bytes, p: Params, level: int = 6, watermark=None, visible=None) -> bytes:
    """Plain samples as a scrambled file."""
    mixed = []
    for i, (size, raster) in enumerate(zip(sizes, rasters)):
        order = layout(key, p.salt, size.width, size.height, p.mode, p.block, i)
        mixed.append(raster.reshape(-1, raster.shape[2])[order].reshape(raster.shape))
    own = {}
    if visible is not None:
        from rasterloom.watermark.paint import stashed_pixels

        mixed, stash = stashed_pixels(mixed, places(parts), head.color_type, head.depth, parts, visible, orientation_of(parts), key, p.salt)
        if stash:
            own[STASH] = stash
            p = replace(p, flags=p.flags | STASHED)
    if watermark is not None:
        from rasterloom.watermark.carried import encoded as carried_data

        own = {WATERMARK: carried_data(watermark), **own}
    check = seed(key, p.salt, p.mode, p.block, head.width, head.height)[2]
    # shuffled pixels have no neighbours worth a filter
    streams = [encoded(s, r, 1 if p.mode == "pixel" else level, p.mode != "pixel") for s, r in zip(sizes, mixed)]
    return with_streams(parts, streams, {MARKER: marker(p, check), **own})


def scrambled(data: bytes, key: bytes, salt: bytes | None = None, mode: str = "pixel", block: int = 16, transforms: bool | None = None, level: int = 6, watermark=None, visible=None, keep_thumbnails: bool = False, limits: Limits = DEFAULTS) -> bytes:
    """Scrambled under a key; tiles shrink until frames have enough of them, and previews of the plain
    picture go. The block may have the bit that says that tiles are turned, too."""
    limits.input_size(data)
    parts = chunks(data, limits)
    head = header(parts, limits.max_pixels)
    if own_part(parts, MARKER) is not None:
        raise ImageError("ALREADY_SCRAMBLED", "the file has a marker")
    if mode == "mcu":
        raise ImageError("BAD_OPTION", "mode mcu is for JPEG")
    turned = bool(block & TRANSFORMS) if transforms is None else transforms
    p = params(mode, block & ~TRANSFORMS, turned, salt=salt)
    if not keep_thumbnails:
        from rasterloom.metadata.previews import sanitized_parts

        parts = sanitized_parts(parts, limits.max_metadata_bytes)[0]
    sizes, rasters = rasters_of(parts, head, limits)
    return file_of(parts, head, sizes, rasters, key, fitted(p, [(h.width, h.height) for h in sizes]), level, watermark, visible)


def plain(data: bytes, key: bytes, limits: Limits = DEFAULTS) -> dict:
    """Everything that restoring gives: parts, head, sizes, rasters, params, and the JSON of the visible watermark that was on it."""
    limits.input_size(data)
    parts = chunks(data, limits)
    head, m = header(parts, limits.max_pixels), marker_of(parts)
    if m is None:
        raise ImageError("NOT_SCRAMBLED", "the file has no marker")
    p = m["params"]
    if not same_check(seed(key, p.salt, p.mode, p.block, head.width, head.height)[2], m["check"]):
        raise wrong_key()
    sizes, rasters = rasters_of(parts, head, limits)
    visible = None
    if p.flags & STASHED:
        from rasterloom.watermark.carried import unstashed_pixels

        stash = own_part(parts, STASH)
        if stash is None:
            raise ImageError("CORRUPT", "the samples under the visible watermark are lost")
        rasters, visible = unstashed_pixels(rasters, stash, key, p.salt, limits)
    out = []
    for i, (size, raster) in enumerate(zip(sizes, rasters)):
        back = np.empty_like(raster).reshape(-1, raster.shape[2])
        back[layout(key, p.salt, size.width, size.height, p.mode, p.block, i)] = raster.reshape(-1, raster.shape[2])
        out.append(back.reshape(raster.shape))
    return {"parts": parts, "head": head, "sizes": sizes, "rasters": out, "params": p, "visible": visible, "watermark": own_part(parts, WATERMARK)}


def restored(data: bytes, key: bytes, level: int = 6, paint: dict | None = None, limits: Limits = DEFAULTS) -> bytes:
    got = plain(data, key, limits)
    parts, sizes, rasters = got["parts"], got["sizes"], got["rasters"]
    if paint is not None:
        from rasterloom.sources.raster import painted

        parts, sizes, rasters = painted(parts, got["head"], sizes, rasters, paint, orientation_of(parts), limits)
    return with_streams(parts, [encoded(s, r, level) for s, r in zip(sizes, rasters)])


def rekeyed(data: bytes, old: bytes, new: bytes, salt: bytes | None = None, mode: str | None = None, block: int | None = None, transforms: bool | None = None, level: int = 6, limits: Limits = DEFAULTS) -> bytes:
    """Under a new key, with the mode, tiles, turns and watermarks that it had unless they are given."""
    from rasterloom.watermark.carried import carried, drawn

    got = plain(data, old, limits)
    p = got["params"]
    mode = mode or p.mode
    size = block if block is not None else (p.tile if p.mode == "block" else 16)
    turned = transforms if transforms is not None else (p.transforms if p.mode == "block" else True)
    q = fitted(params(mode, size, turned, salt=salt), [(h.width, h.height) for h in got["sizes"]])
    visible = drawn(got["visible"], limits) if got["visible"] is not None else None
    return file_of(got["parts"], got["head"], got["sizes"], got["rasters"], new, q, level, carried(got["watermark"]), visible)


def info(data: bytes, limits: Limits = DEFAULTS) -> dict:
    """What the heads tell, without decoding."""
    from rasterloom.watermark.carried import carried_info

    parts = chunks(data, limits)
    head, m = header(parts, limits.max_pixels), marker_of(parts) or {}
    check_frames(parts, limits)
    shown = sum(k == b"fcTL" for k, _ in parts) or 1
    p = m.get("params")
    return {
        **{k: getattr(head, k) for k in ("width", "height", "depth", "color_type", "interlace")}, "frames": shown, "scrambled": bool(m), "mode": m.get("mode"), "block": m.get("block"),
        "transforms": p.transforms if p else None, "visible": bool(p and p.flags & STASHED), "watermark": carried_info(own_part(parts, WATERMARK), limits), "orientation": orientation_of(parts),
    }
