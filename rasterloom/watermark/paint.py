"""Painting patches: into samples of any depth, palette indices and JPEG coefficients, with what they cover kept."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from rasterloom.functions.errors import ImageError
from rasterloom.functions.limits import DEFAULTS, Limits
from rasterloom.watermark.carried import covered_bytes, mcu_bytes, stash
from rasterloom.watermark.definition import compiled
from rasterloom.watermark.render import Patch, rendered_stored


def part_of(patch: Patch, x: int, y: int, width: int, height: int) -> tuple[slice, slice, np.ndarray] | None:
    """(rows, columns, patch) of a target that lies at x, y, where the patch reaches it."""
    h, w = patch.data.shape[:2]
    x0, y0, x1, y1 = max(0, patch.x - x), max(0, patch.y - y), min(width, patch.x + w - x), min(height, patch.y + h - y)
    if x1 <= x0 or y1 <= y0:
        return None
    return slice(y0, y1), slice(x0, x1), patch.data[y0 + y - patch.y : y1 + y - patch.y, x0 + x - patch.x : x1 + x - patch.x]


def holds(x: int, y: int, width: int, height: int, patch: Patch) -> bool:
    """Whether a frame holds the whole patch."""
    h, w = patch.data.shape[:2]
    return x <= patch.x and y <= patch.y and x + width >= patch.x + w and y + height >= patch.y + h


def color_key(parts: list[tuple[bytes, bytes]], color_type: int) -> np.ndarray | None:
    """The samples that a tRNS chunk makes transparent, of grey and RGB files."""
    n = {0: 1, 2: 3}.get(color_type, 0)
    data = next((d for k, d in parts if k == b"tRNS"), b"")
    return np.frombuffer(data[: 2 * n], ">u2").astype(np.int64) if n and len(data) >= 2 * n else None


def samples_of(raster: np.ndarray, depth: int) -> np.ndarray:
    return raster.view(">u2").astype(np.int64) if depth == 16 else raster.astype(np.int64)


def painted_samples(raster: np.ndarray, depth: int, patch: Patch, x: int = 0, y: int = 0, key: np.ndarray | None = None) -> np.ndarray:
    """A raster (height, width, bytes of a pixel) of 1, 2, 3 or 4 channels with a patch over it."""
    height, width = raster.shape[:2]
    part = part_of(patch, x, y, width, height)
    if part is None:
        return raster
    rows, cols, top = part
    raster = np.ascontiguousarray(raster).copy()
    old = samples_of(np.ascontiguousarray(raster[rows, cols]), depth)
    most = (1 << depth) - 1
    channels = old.shape[2]
    n = channels - (channels in (2, 4))
    ink = top[:, :, :3] @ np.array([[0.299], [0.587], [0.114]]) if n == 1 else top[:, :, :3]
    a = top[:, :, 3:]
    keyed = (old[:, :, :n] == key).all(2, keepdims=True) if key is not None and channels == n == len(key) else np.zeros(a.shape, bool)
    under = np.where(keyed, 0.0, old[:, :, n:] / most if channels > n else 1.0)
    whole = np.where(keyed, 1.0, a + under * (1 - a))
    mixed = np.divide(ink + old[:, :, :n] / most * under * (1 - a), np.where(keyed, np.maximum(a, 1e-300), whole), out=np.zeros(old[:, :, :n].shape), where=whole > 0)
    level = lambda v: np.floor(np.clip(v, 0, 1) * most + 0.5).astype(np.int64)
    new = np.concatenate([level(mixed), level(whole)], 2) if channels > n else level(mixed)
    if key is not None and channels == n == len(key):  # painted pixels have to stay visible
        hit = (new == key).all(2)
        new[hit, n - 1] += 1 if key[-1] < most else -1
    # a transparent pixel takes colour only where the patch covers half of it
    change = (a > 0) & ~(keyed & (a < 0.5))
    new = np.where(change, new, old)
    raster[rows, cols] = new.astype(">u2").view(np.uint8).reshape(*new.shape[:2], -1) if depth == 16 else new.astype(np.uint8)
    return raster


def painted_indices(raster: np.ndarray, palette: bytes, alphas: bytes, patch: Patch, x: int = 0, y: int = 0) -> np.ndarray:
    """Palette indices with a patch over them: each pixel takes the nearest entry that there is."""
    part = part_of(patch, x, y, raster.shape[1], raster.shape[0])
    if part is None:
        return raster
    rows, cols, top = part
    entries = np.full((len(palette) // 3, 4), 255.0)
    entries[:, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    entries[: len(alphas), 3] = np.frombuffer(alphas, np.uint8)[: len(entries)]
    raster = raster.copy()
    own = raster[rows, cols, 0]
    old = entries[np.minimum(own, len(entries) - 1)] / 255
    a = top[:, :, 3:]
    whole = a + old[:, :, 3:] * (1 - a)
    color = np.divide(top[:, :, :3] + old[:, :, :3] * old[:, :, 3:] * (1 - a), whole, out=np.zeros(top[:, :, :3].shape), where=whole > 0)
    want = np.concatenate([color, whole], 2) * 255
    best, least = own.copy(), np.full(own.shape, np.inf)
    for k, entry in enumerate(entries):  # at most 256
        far = ((want - entry) ** 2).sum(2)
        best, least = np.where(far < least, k, best), np.minimum(far, least)
    raster[rows, cols, 0] = np.where(a[:, :, 0] > 0, best, own)
    return raster


def painted_rgba(frames: list[np.ndarray], mark: dict, orientation: int = 1, depth: int = 8, limits: Limits = DEFAULTS) -> list[np.ndarray]:
    """Whole frames of RGBA with a watermark over each."""
    height, width = frames[0].shape[:2]
    patch = rendered_stored(compiled(mark), width, height, orientation, limits)
    return frames if patch is None else [painted_samples(f, depth, patch) for f in frames]


def stashed_pixels(rasters, sizes, color_type: int, depth: int, parts, mark: dict, orientation: int, key: bytes, salt: bytes):
    """(rasters with the watermark, what it covers, enciphered) of PNG frames; sizes are (x, y) by frame. None without a place."""
    mark = compiled(mark)
    height, width = rasters[0].shape[:2]
    patch = rendered_stored(mark, width, height, orientation)
    if patch is None:
        return rasters, None
    regions = []
    for i, (raster, (x, y)) in enumerate(zip(rasters, sizes)):
        if i and not holds(x, y, raster.shape[1], raster.shape[0], patch):
            continue
        part = part_of(patch, x, y, raster.shape[1], raster.shape[0])
        if part is not None:
            rows, cols, _ = part
            regions.append((i, cols.start, rows.start, cols.stop - cols.start, rows.stop - rows.start))
    covered = covered_bytes(rasters, regions)
    palette, alphas = (next((d for k, d in parts if k == kind), b"") for kind in (b"PLTE", b"tRNS"))
    out = list(rasters)
    for i, *_ in regions:
        x, y = sizes[i]
        out[i] = painted_indices(rasters[i], palette, alphas, patch, x, y) if color_type == 3 else painted_samples(rasters[i], depth, patch, x, y, color_key(parts, color_type))
    return out, stash(mark, regions, covered, key, salt)


# ---- JPEG


def jpeg_color(segments, frame) -> str:
    from rasterloom.sources.jpeg_pixels import color_model

    model = color_model(segments, frame)
    if len(frame.components) not in (1, 3):
        raise ImageError("UNSUPPORTED", "watermarks go on grey, YCbCr and RGB pictures")
    return model


def painted_frame(patch: Patch, frame, segments):
    """The frame with a patch over it. Only blocks that hold a painted sample get new coefficients."""
    from rasterloom.sources.jpeg_pixels import FORWARD, rounded, tables_of

    model, tables = jpeg_color(segments, frame), tables_of(segments)
    hmax, vmax = frame.hmax, frame.vmax
    if any(hmax % c.h or vmax % c.v for c in frame.components):
        raise ImageError("UNSUPPORTED", "unusual factors of colour")
    if any(c.tq not in tables for c in frame.components):
        raise ImageError("BAD_JPEG", "a quantisation table is missing")
    wide, high = 8 * hmax, 8 * vmax
    h, w = patch.data.shape[:2]
    mx0, my0 = patch.x // wide, patch.y // high
    mx1, my1 = min(frame.mcus_x, -(-(patch.x + w) // wide)), min(frame.mcus_y, -(-(patch.y + h) // high))
    rows, cols = (my1 - my0) * high, (mx1 - mx0) * wide
    top = np.zeros((rows, cols, 4))
    part = part_of(patch, mx0 * wide, my0 * high, min(cols, frame.width - mx0 * wide), min(rows, frame.height - my0 * high))
    if part is None:
        return frame
    top[part[0], part[1]] = part[2]
    touched, keep = top[:, :, 3] > 0, 1 - top[:, :, 3]
    planes, places = [], []
    for c in frame.components:
        at = (slice(my0 * c.v, my1 * c.v), slice(mx0 * c.h, mx1 * c.h))
        blocks = c.coefs[at].reshape(-1, 64) * tables[c.tq] @ FORWARD
        own = blocks.reshape((my1 - my0) * c.v, (mx1 - mx0) * c.h, 8, 8).swapaxes(1, 2).reshape((my1 - my0) * c.v * 8, -1)
        planes.append(np.repeat(np.repeat(own, vmax // c.v, 0), hmax // c.h, 1))
        places.append(at)
    ink, seen = top[:, :, :3] * 255, lambda p: np.clip(p, 0, 255) * keep
    if model == "grey":
        new = [ink @ np.array([0.299, 0.587, 0.114]) + seen(planes[0] + 128) - 128]
    elif model == "rgb":
        new = [ink[:, :, k] + seen(p + 128) - 128 for k, p in enumerate(planes)]
    else:
        y, b, r = planes[0] + 128, planes[1], planes[2]
        red, green, blue = (ink[:, :, k] + seen(p) for k, p in enumerate((y + 1.402 * r, y - 0.344136286 * b - 0.714136286 * r, y + 1.772 * b)))
        new = [0.299 * red + 0.587 * green + 0.114 * blue - 128, -0.168735892 * red - 0.331264108 * green + 0.5 * blue, 0.5 * red - 0.418687589 * green - 0.081312411 * blue]
    parts = []
    for c, p, old, at in zip(frame.components, new, planes, places):
        fy, fx = vmax // c.v, hmax // c.h
        p = np.where(touched, p, old).reshape(rows // fy, fy, cols // fx, fx).mean((1, 3))
        hit = touched.reshape(rows // (8 * fy), 8 * fy, cols // (8 * fx), 8 * fx).any((1, 3))
        blocks = p.reshape(hit.shape[0], 8, hit.shape[1], 8).swapaxes(1, 2)[hit].reshape(-1, 64)
        coefs = c.coefs.copy()
        coefs[at][hit] = np.clip(rounded(blocks @ FORWARD.T / tables[c.tq]), -32767, 32767)
        parts.append(replace(c, coefs=coefs))
    return replace(frame, components=tuple(parts))


def painted_jpeg(frame, segments, mark: dict, orientation: int = 1, limits: Limits = DEFAULTS):
    patch = rendered_stored(compiled(mark), frame.width, frame.height, orientation, limits)
    return frame if patch is None else painted_frame(patch, frame, segments)


def stashed_jpeg(frame, segments, mark: dict, orientation: int, key: bytes, salt: bytes):
    """(frame with the watermark over it, what it covers, enciphered); None without a place."""
    mark = compiled(mark)
    patch = rendered_stored(mark, frame.width, frame.height, orientation)
    if patch is None:
        return frame, None
    wide, high = 8 * frame.hmax, 8 * frame.vmax
    h, w = patch.data.shape[:2]
    x, y = patch.x // wide, patch.y // high
    r = (0, x, y, min(frame.mcus_x, -(-(patch.x + w) // wide)) - x, min(frame.mcus_y, -(-(patch.y + h) // high)) - y)
    return painted_frame(patch, frame, segments), stash(mark, [r], mcu_bytes(frame, r), key, salt)
