"""Colour profiles: what they are, whether they are plain sRGB, and a small sRGB one."""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

# sRGB's primaries under the profile's white, how far a profile may be off, where curves are compared.
PRIMARIES = {b"rXYZ": (0.4361, 0.2225, 0.0139), b"gXYZ": (0.3851, 0.7169, 0.0971), b"bXYZ": (0.1431, 0.0606, 0.7141)}
NEAR, CURVE_NEAR, PROBES = 0.0015, 0.004, np.array([0.02, 0.1, 0.25, 0.5, 0.75, 0.95])
TABLES = (b"A2B0", b"A2B1", b"A2B2", b"B2A0", b"D2B0")


def linear(v: np.ndarray) -> np.ndarray:
    """sRGB values as amounts of light."""
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def tags(icc: bytes) -> dict[bytes, bytes]:
    """The data of each tag that lies within the profile."""
    out: dict[bytes, bytes] = {}
    if len(icc) >= 132:
        for k in range(min(struct.unpack_from(">I", icc, 128)[0], (len(icc) - 132) // 12)):
            name, at, size = struct.unpack_from(">4sII", icc, 132 + 12 * k)
            if at + size <= len(icc):
                out.setdefault(name, icc[at : at + size])
    return out


def tag_text(data: bytes | None) -> str | None:
    if not data or len(data) < 12:
        return None
    kind, text = data[:4], ""
    if kind == b"desc":
        text = data[12 : 12 + int.from_bytes(data[8:12], "big")].decode("latin-1")
    elif kind == b"text":
        text = data[8:].decode("latin-1")
    elif kind == b"mluc" and len(data) >= 28:
        size, at = struct.unpack_from(">II", data, 20)
        text = data[at : at + size].decode("utf-16-be", "replace") if at + size <= len(data) else ""
    return text.split("\0")[0].strip()[:200] or None


def is_profile(icc: bytes | None) -> bool:
    return bool(icc) and len(icc) >= 128 and icc[36:40] == b"acsp"


def space(icc: bytes) -> str:
    return icc[16:20].decode("latin-1")


def described(icc: bytes | None) -> dict | None:
    if not is_profile(icc):
        return None
    found, text = tags(icc), lambda at: icc[at : at + 4].decode("latin-1").strip()
    return {"bytes": len(icc), "description": tag_text(found.get(b"desc")), "copyright": tag_text(found.get(b"cprt")), "version": f"{icc[8]}.{icc[9] >> 4}", "class": text(12), "space": text(16), "pcs": text(20), "srgb": is_srgb(icc)}


def curve(data: bytes | None, x: np.ndarray) -> np.ndarray | None:
    """A tone curve at x: a table, a power, or a function of one of five forms."""
    if not data or len(data) < 12:
        return None
    if data[:4] == b"curv":
        n = int.from_bytes(data[8:12], "big")
        if 12 + 2 * n > len(data):
            return None
        values = np.frombuffer(data, ">u2", n, 12)
        return x if n == 0 else x ** (values[0] / 256) if n == 1 else np.interp(x * (n - 1), np.arange(n), values / 65535)
    if data[:4] != b"para":
        return None
    form = int.from_bytes(data[8:10], "big")
    n = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}.get(form)
    if n is None or 12 + 4 * n > len(data):
        return None
    g, a, b, c, d, e, f = [*(np.frombuffer(data, ">i4", n, 12) / 65536), *[1.0, 0.0, 0.0, 0.0, 0.0, 0.0][n - 1 :]]
    with np.errstate(all="ignore"):
        power = np.maximum(a * x + b, 0) ** g
        if form == 0:
            return x**g
        if form in (1, 2):
            low = c if form == 2 else 0.0
            return np.where(x >= -b / a, power + low, low) if a else None
        return np.where(x >= d, power + (e if form == 4 else 0), c * x + (f if form == 4 else 0))


def is_srgb(icc: bytes | None) -> bool:
    """Whether a profile says no more than sRGB does, so that viewers show the same without it."""
    if not is_profile(icc) or icc[16:24] != b"RGB XYZ ":
        return False
    found = tags(icc)
    if any(t in found for t in TABLES):
        return False
    for name, want in PRIMARIES.items():
        data = found.get(name, b"")
        if len(data) < 20 or data[:4] != b"XYZ " or np.abs(np.frombuffer(data, ">i4", 3, 8) / 65536 - want).max() > NEAR:
            return False
    for name in (b"rTRC", b"gTRC", b"bTRC"):
        got = curve(found.get(name), PROBES)
        if got is None or np.abs(got - linear(PROBES)).max() > CURVE_NEAR:
            return False
    return True


def fixed(*values: float) -> bytes:
    return struct.pack(f">{len(values)}i", *(int(np.floor(v * 65536 + 0.5)) for v in values))


@cache
def srgb() -> bytes:
    """A small sRGB profile."""
    xyz = lambda *v: b"XYZ \0\0\0\0" + fixed(*v)
    name = b"sRGB\0"
    tone = b"curv\0\0\0\0" + struct.pack(">I", 256) + np.floor(linear(np.arange(256) / 255) * 65535 + 0.5).astype(">u2").tobytes()
    parts = {
        b"desc": b"desc\0\0\0\0" + struct.pack(">I", len(name)) + name + bytes(78), b"cprt": b"text\0\0\0\0No copyright, use freely\0", b"wtpt": xyz(0.9505, 1, 1.089),
        b"rXYZ": xyz(0.436074, 0.222504, 0.013932), b"gXYZ": xyz(0.385065, 0.716879, 0.097105), b"bXYZ": xyz(0.143080, 0.060617, 0.714173),
        b"rTRC": tone, b"gTRC": tone, b"bTRC": tone,
    }
    at, places, body = 132 + 12 * len(parts), {}, b""
    for data in dict.fromkeys(parts.values()):  # equal data are there once
        places[data] = at + len(body)
        body += data + bytes(-len(data) % 4)
    head = struct.pack(">I4xI", at + len(body), 0x02100000) + b"mntrRGB XYZ " + struct.pack(">6H", 2024, 1, 1, 0, 0, 0) + b"acsp" + bytes(28) + fixed(0.9642, 1, 0.8249) + bytes(48)
    table = struct.pack(">I", len(parts)) + b"".join(struct.pack(">4sII", n, places[d], len(d)) for n, d in parts.items())
    return head + table + body
