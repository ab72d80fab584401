"""What a scrambled file carries of watermarks: one for the restored picture, and the samples or
coefficients that a visible one covers, enciphered under the key."""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import replace

import numpy as np

from rasterloom.functions.errors import ImageError, limit_error
from rasterloom.functions.keys import hkdf, keystream
from rasterloom.functions.limits import DEFAULTS, Limits

#: Context of the keys that cover samples are enciphered with, and the longest watermark that is written.
STASH_CONTEXT, MOST_JSON = b"rasterloom/watermark-stash", 512 * 1024


def bad(what: str) -> ImageError:
    return ImageError("BAD_WATERMARK", f"watermark data is damaged ({what})")


def encoded(mark: dict | bytes) -> bytes:
    """A reference by id alone, a compiled watermark, or what a file has carried, as it is stored."""
    if isinstance(mark, bytes):
        return mark
    by_id = set(mark) == {"id"} and isinstance(mark["id"], str)
    body = (mark["id"] if by_id else json.dumps(mark, ensure_ascii=False, separators=(",", ":"))).encode()
    if len(body) > MOST_JSON:
        raise ImageError("BAD_WATERMARK", "the watermark is too large to be carried")
    return bytes([1, 0 if by_id else 1]) + body


def decoded(data: bytes, limits: Limits = DEFAULTS) -> dict:
    """id, name and compiled (null for a reference)."""
    if len(data) < 3 or data[0] != 1 or data[1] > 1:
        raise bad("head")
    if len(data) - 2 > limits.max_metadata_bytes:
        raise limit_error("the carried watermark is over max_metadata_bytes")
    try:
        text = data[2:].decode()
        value = {"id": text} if data[1] == 0 else json.loads(text)
    except ValueError as e:
        raise bad("text") from e
    if not isinstance(value, dict) or not isinstance(value.get("id"), str):
        raise bad("fields")
    name = value.get("name")
    return {"id": value["id"], "name": name if isinstance(name, str) else None, "compiled": value if data[1] else None}


def read_carried(data: bytes | None, limits: Limits = DEFAULTS) -> tuple[dict | None, ImageError | None]:
    """(watermark, why it cannot be read): a damaged one does not stop the picture from being restored."""
    if data is None:
        return None, None
    try:
        return decoded(data, limits), None
    except ImageError as e:
        return None, e


def carried(data: bytes | None) -> bytes | None:
    """What a change of key keeps: the data as stored unless it is damaged."""
    _, error = read_carried(data)
    return None if error is not None and error.code == "BAD_WATERMARK" else data


def carried_info(data: bytes | None, limits: Limits = DEFAULTS) -> dict | None:
    found, error = read_carried(data, limits)
    if error is not None:
        return {"id": None, "name": None, "embedded": None, "error": str(error)}
    return None if found is None else {"id": found["id"], "name": found["name"], "embedded": found["compiled"] is not None, "error": None}


def enciphered(data: bytes, key: bytes, salt: bytes, context: bytes = STASH_CONTEXT) -> bytes:
    """Data under a stream of the key and the picture's salt; twice gives the data again."""
    secret = hkdf(key, salt, context, 44)
    stream = keystream(secret[:32], secret[32:], 0, -(-len(data) // 64)).astype("<u4").view(np.uint8)[: len(data)]
    return (np.frombuffer(data, np.uint8) ^ stream).tobytes()


def stash(mark: dict, regions: list[tuple[int, int, int, int, int]], raw: bytes, key: bytes, salt: bytes) -> bytes:
    """The covered bytes of regions (frame, x, y, width, height), with the watermark that covers them."""
    if len(raw) > DEFAULTS.max_decompressed_bytes:
        raise limit_error("what the visible watermark covers is over max_decompressed_bytes")
    text, data = json.dumps(mark, ensure_ascii=False, separators=(",", ":")).encode(), enciphered(zlib.compress(raw, 6), key, salt)
    many = len(regions) > 255  # more than one byte counts
    count = struct.pack(">I" if many else ">B", len(regions))
    return bytes([2 if many else 1]) + struct.pack(">I", len(text)) + text + count + b"".join(struct.pack(">5I", *r) for r in regions) + struct.pack(">I", len(data)) + data


def unstashed(data: bytes, key: bytes, salt: bytes, size_of, limits: Limits = DEFAULTS) -> tuple[bytes, list[tuple], bytes]:
    """(the watermark's JSON, regions, covered bytes). size_of(region) is its number of bytes and refuses what is not in the picture."""
    try:
        version, length = struct.unpack_from(">BI", data)
        text, at = data[5 : 5 + length], 5 + length
        form = {1: ">B", 2: ">I"}.get(version)
        if form is None:
            raise bad("version")
        (count,) = struct.unpack_from(form, data, at)
        at += struct.calcsize(form)
        if at + 20 * count + 4 > len(data):
            raise bad("regions")
        regions = [struct.unpack_from(">5I", data, at + 20 * k) for k in range(count)]
        at += 20 * count
        (length,) = struct.unpack_from(">I", data, at)
        body = data[at + 4 : at + 4 + length]
    except struct.error as e:
        raise bad("cut") from e
    if len(body) < length or any(b[0] <= a[0] for a, b in zip(regions, regions[1:])):
        raise bad("regions")
    total = sum(size_of(r) for r in regions)
    if total > limits.max_decompressed_bytes:
        raise limit_error("what the visible watermark covers is over max_decompressed_bytes")
    try:
        raw = zlib.decompressobj().decompress(enciphered(body, key, salt), total + 1)
    except zlib.error as e:
        raise bad("data") from e
    if len(raw) != total:
        raise bad("length")
    return text, regions, raw


def drawn(text: bytes, limits: Limits = DEFAULTS) -> dict:
    if len(text) > limits.max_metadata_bytes:
        raise limit_error("the visible watermark is over max_metadata_bytes")
    try:
        return json.loads(text)
    except ValueError as e:
        raise bad("text") from e


# ---- pixels


def covered_bytes(rasters: list[np.ndarray], regions: list[tuple]) -> bytes:
    return b"".join(rasters[i][y : y + h, x : x + w].tobytes() for i, x, y, w, h in regions)


def unstashed_pixels(rasters: list[np.ndarray], data: bytes, key: bytes, salt: bytes, limits: Limits = DEFAULTS) -> tuple[list[np.ndarray], bytes]:
    """(rasters with the covered samples put back, the watermark's JSON)."""

    def size(r):
        i, x, y, w, h = r
        if i >= len(rasters) or not w or not h or x + w > rasters[i].shape[1] or y + h > rasters[i].shape[0]:
            raise bad("region")
        return w * h * rasters[i].shape[2]

    text, regions, raw = unstashed(data, key, salt, size, limits)
    out, at = [r.copy() for r in rasters], 0
    for i, x, y, w, h in regions:
        n = w * h * out[i].shape[2]
        out[i][y : y + h, x : x + w] = np.frombuffer(raw, np.uint8, n, at).reshape(h, w, -1)
        at += n
    return out, text


# ---- coefficients of whole MCUs


def mcu_rectangle(frame, r: tuple) -> list[np.ndarray]:
    """Of each component, the blocks of a rectangle of MCUs, as a view (MCU rows, v, MCU columns, h, 64)."""
    _, x, y, w, h = r
    return [c.coefs.reshape(frame.mcus_y, c.v, frame.mcus_x, c.h, 64)[y : y + h, :, x : x + w] for c in frame.components]


def mcu_bytes(frame, r: tuple) -> bytes:
    return b"".join(v.transpose(0, 2, 1, 3, 4).astype("<i2").tobytes() for v in mcu_rectangle(frame, r))


def unstashed_jpeg(frame, data: bytes, key: bytes, salt: bytes, limits: Limits = DEFAULTS):
    """(frame with the covered coefficients put back, the visible watermark)."""

    def size(r):
        i, x, y, w, h = r
        if i or not w or not h or x + w > frame.mcus_x or y + h > frame.mcus_y:
            raise bad("region")
        return sum(w * h * c.h * c.v * 128 for c in frame.components)

    text, regions, raw = unstashed(data, key, salt, size, limits)
    if len(regions) != 1:
        raise bad("regions")
    frame = replace(frame, components=tuple(replace(c, coefs=c.coefs.copy()) for c in frame.components))
    at = 0
    for view, c in zip(mcu_rectangle(frame, regions[0]), frame.components):
        rows, _, cols = view.shape[:3]
        n = view.size
        view[...] = np.frombuffer(raw, "<i2", n, at).reshape(rows, cols, c.v, c.h, 64).transpose(0, 2, 1, 3, 4)
        at += 2 * n
    return frame, drawn(text, limits)
