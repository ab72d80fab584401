"""Pixels of JPEG files: inverse and forward cosine transforms, colour, quantisation, files made of pixels."""

from __future__ import annotations

import struct
from dataclasses import replace

import numpy as np

from rasterloom.functions.errors import ImageError
from rasterloom.functions.limits import DEFAULTS, Limits, color
from rasterloom.sources import jpeg
from rasterloom.sources.jpeg import APP0, COM, DQT, SOF0, ZIGZAG, Component, Frame, Segment

# The format's example tables for brightness and colour, in natural order.
BRIGHTNESS = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
])
COLOR = np.array([
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    *[99] * 32,
])
# Adobe's segment, factors by layout, weights of brightness.
ADOBE = b"Adobe"
FACTORS = {"4:4:4": (1, 1), "4:2:2": (2, 1), "4:2:0": (2, 2)}
RED, GREEN, BLUE = 0.299, 0.587, 0.114
#: Blocks that are transformed at a time.
STEP = 1 << 15


def cosines() -> np.ndarray:
    """The 64 x 64 matrix that takes a block's samples to its coefficients."""
    k, x = np.arange(8)[:, None], np.arange(8)
    one = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    out = np.kron(one, one)
    # what is an eighth but for rounding is one, so that sums that end halfway are rounded alike everywhere
    return np.where(np.abs(np.abs(out) - 0.125) < 1e-12, np.sign(out) * 0.125, out)


FORWARD = cosines()


def rounded(x: np.ndarray) -> np.ndarray:
    """To the nearest whole number, halves away from zero."""
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)


def tables_of(segments: list[Segment]) -> dict[int, np.ndarray]:
    """Quantisation tables by id, in natural order."""
    return {number: jpeg.quant_values(precision, data) for s in segments if s.marker == DQT for precision, number, data in jpeg.quant_tables(s.body)}


def plane(c: Component, table: np.ndarray) -> np.ndarray:
    """The samples of a component, whole blocks, 0 to 255."""
    rows, cols = c.coefs.shape[:2]
    flat, out = c.coefs.reshape(-1, 64), np.empty((rows * cols, 64), np.uint8)
    for lo in range(0, len(flat), STEP):
        out[lo : lo + STEP] = np.clip(np.floor((flat[lo : lo + STEP] * table).astype(np.float64) @ FORWARD + 128.5), 0, 255)
    return out.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)


def color_model(segments: list[Segment], frame: Frame) -> str:
    """grey, ycc, rgb, inks, or cmyk and ycck as Adobe stores them (inverted): as an Adobe segment says, else a JFIF one, else the components' names."""
    n = len(frame.components)
    if n in (1, 2):
        return "grey"
    adobe = next((s.body for s in segments if s.marker == 0xEE and s.body.startswith(ADOBE) and len(s.body) >= 12), None)
    if n == 4:
        return "inks" if not adobe else "ycck" if adobe[11] == 2 else "cmyk"
    if any(s.marker == APP0 and s.body.startswith(b"JFIF\0") for s in segments):
        return "ycc"
    if adobe:
        return "rgb" if adobe[11] == 0 else "ycc"
    return "rgb" if bytes(c.id for c in frame.components) == b"RGB" else "ycc"


def pixels_of(segments: list[Segment], frame: Frame) -> np.ndarray:
    """RGB samples (height, width, 3). Colour of fewer samples is repeated."""
    tables = tables_of(segments)
    planes = []
    for c in frame.components:
        if c.tq not in tables:
            raise ImageError("BAD_JPEG", "a quantisation table is missing")
        own = plane(c, tables[c.tq])
        rows, cols = (np.arange(frame.height) * c.v // frame.vmax, np.arange(frame.width) * c.h // frame.hmax)
        planes.append(own[rows[:, None], cols])
    model = color_model(segments, frame)
    if model == "grey":
        return np.repeat(planes[0][:, :, None], 3, 2)
    if model in ("ycc", "ycck"):
        y, b, r = (p.astype(np.float64) for p in planes[:3])
        rgb = [y + 1.402 * (r - 128), y - (0.114 * 1.772 * (b - 128) + 0.299 * 1.402 * (r - 128)) / 0.587, y + 1.772 * (b - 128)]
        planes[:3] = [np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8) for x in rgb]
    if model != "ycc" and model != "rgb":
        light = [p.astype(np.int64) if model == "cmyk" else 255 - p.astype(np.int64) for p in planes[:3]]
        black = 255 - planes[3].astype(np.int64) if model == "inks" else planes[3].astype(np.int64)
        planes = [(p * black + 127) // 255 for p in light]
    return np.stack(planes[:3], 2).astype(np.uint8)


def decoded(data: bytes, limits: Limits = DEFAULTS) -> tuple[np.ndarray, list[Segment], bool]:
    """(RGB samples as stored, segments, whether data was damaged)."""
    segments, frame, _ = jpeg.read(data, limits)
    return pixels_of(segments, frame), segments, frame.damaged


def scaled(base: np.ndarray, quality: float) -> np.ndarray:
    """A table at a quality from 1 to 100; 50 is the table itself."""
    factor = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip(np.floor((base * factor + 50) / 100), 1, 255).astype(np.int64)


def downsampled(p: np.ndarray, fx: int, fy: int) -> np.ndarray:
    """Means of fx x fy samples; the last row and column are repeated to fill."""
    p = np.pad(p, ((0, -len(p) % fy), (0, -p.shape[1] % fx)), mode="edge")
    return p.reshape(len(p) // fy, fy, p.shape[1] // fx, fx).mean((1, 3))


def blocks_of(p: np.ndarray, rows: int, cols: int, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of a plane filled to rows x cols blocks by its edge."""
    p = np.pad(p, ((0, rows * 8 - len(p)), (0, cols * 8 - p.shape[1])), mode="edge")
    flat = p.reshape(rows, 8, cols, 8).swapaxes(1, 2).reshape(-1, 64)
    out = np.empty(flat.shape, np.int16)
    for lo in range(0, len(flat), STEP):
        out[lo : lo + STEP] = rounded(((flat[lo : lo + STEP] - 128.0) @ FORWARD.T) / table)
    return out.reshape(rows, cols, 64)


def frame_of_pixels(rgb: np.ndarray, quality: float = 90, subsampling: str = "4:2:0", grey: bool = False) -> tuple[list[Segment], Frame]:
    """(table segments, frame) of RGB samples."""
    height, width = rgb.shape[:2]
    if max(height, width) > 65535:
        raise ImageError("UNSUPPORTED", "a JPEG has at most 65535 pixels a side")
    r, g, b = (rgb[:, :, k].astype(np.float64) for k in range(3))
    y = r if grey and (r == g).all() and (g == b).all() else RED * r + GREEN * g + BLUE * b
    planes = [y] if grey else [y, (b - y) / 1.772 + 128, (r - y) / 1.402 + 128]
    hmax, vmax = (1, 1) if grey else FACTORS[subsampling]
    tables = [scaled(BRIGHTNESS, quality), scaled(COLOR, quality)][: 1 if grey else 2]
    mcus_x, mcus_y = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    parts, body = [], struct.pack(">BHHB", 8, height, width, len(planes))
    for i, p in enumerate(planes):
        h, v, tq = (hmax, vmax, 0) if i == 0 else (1, 1, 1)
        body += bytes([i + 1, h << 4 | v, tq])
        own = downsampled(p, hmax // h, vmax // v)
        # a real block is one that the picture reaches
        real_w, real_h = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
        parts.append(Component(i + 1, h, v, tq, real_w, real_h, blocks_of(own, mcus_y * v, mcus_x * h, tables[tq])))
    dqt = b"".join(bytes([k]) + t[ZIGZAG].astype(np.uint8).tobytes() for k, t in enumerate(tables))
    return [Segment(DQT, dqt)], Frame(SOF0, body, width, height, tuple(parts), hmax, vmax, mcus_x, mcus_y)


def over(rgba: np.ndarray, background: str = "#ffffff") -> np.ndarray:
    """RGB of RGBA shown on a colour."""
    if rgba.shape[2] == 3:
        return rgba
    back = np.array([int(color(background)[k : k + 2], 16) for k in (1, 3, 5)])
    alpha = rgba[:, :, 3:].astype(np.int64)
    return ((rgba[:, :, :3] * alpha + back * (255 - alpha) + 127) // 255).astype(np.uint8)


def header_segments(meta: dict) -> list[Segment]:
    """JFIF with the density, EXIF, XMP, ICC in numbered parts, IPTC and comments, as far as meta has them."""
    unit, x, y = meta.get("density") or (0, 1, 1)
    out = [Segment(APP0, b"JFIF\0" + struct.pack(">BBBHHBB", 1, 1, unit, x, y, 0, 0))]
    if meta.get("exif"):
        out.append(Segment(0xE1, b"Exif\0\0" + meta["exif"]))
    if meta.get("xmp"):
        out.append(Segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + meta["xmp"].encode()))
    icc = meta.get("icc") or b""
    parts = [icc[k : k + 65519] for k in range(0, len(icc), 65519)]
    out += [Segment(0xE2, b"ICC_PROFILE\0" + bytes([k + 1, len(parts)]) + p) for k, p in enumerate(parts)]
    if meta.get("iptc"):
        out.append(Segment(0xED, b"Photoshop 3.0\0" + meta["iptc"]))
    for text in meta.get("comments", ()):
        data = text.encode()
        out += [Segment(COM, data[k : k + 65533]) for k in range(0, max(1, len(data)), 65533)]
    return [s for s in out if len(s.body) <= 65533]


def jpeg_file(rgba: np.ndarray, meta: dict | None = None, quality: float = 90, subsampling: str = "4:2:0", background: str = "#ffffff", progressive: bool = False, grey: bool | None = None) -> bytes:
    """A JPEG file of RGB or RGBA samples; without a choice, grey if all pixels are."""
    rgb = over(rgba, background)
    if grey is None:
        grey = bool((rgb[:, :, 0] == rgb[:, :, 1]).all() and (rgb[:, :, 1] == rgb[:, :, 2]).all())
    tables, frame = frame_of_pixels(rgb, quality, subsampling, grey)
    return jpeg.assembled([*header_segments(meta or {}), *tables], replace(frame), progressive=progressive)
