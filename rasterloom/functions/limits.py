"""Bounds on what a file may hold, and the check of scramble and conversion options."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields, replace

from rasterloom.functions.errors import ImageError, limit_error

# Output formats, chroma layouts and scramble modes by name.
OUTPUT_FORMATS = ("png", "jpeg", "jxl")
SUBSAMPLINGS = ("4:4:4", "4:2:2", "4:2:0")
SCRAMBLE_MODES = ("pixel", "block", "mcu")


@dataclass(frozen=True)
class Limits:
    max_input_bytes: float = 256 << 20
    max_pixels: float = 100_000_000
    max_frames: float = 1000
    max_total_pixels: float = 200_000_000
    max_decompressed_bytes: float = 1 << 30
    max_metadata_bytes: float = 16 << 20
    max_chunks: float = 1_000_000
    max_scans: float = 256

    def input_size(self, data: bytes) -> None:
        if len(data) > self.max_input_bytes:
            raise limit_error(f"input of {len(data)} bytes is over max_input_bytes ({self.max_input_bytes})")

    def pixels(self, width: int, height: int, what: str = "image") -> None:
        if width * height > self.max_pixels:
            raise limit_error(f"{what} of {width} x {height} pixels is over max_pixels ({self.max_pixels})")

    def frames(self, count: int, pixels: int) -> None:
        if count > self.max_frames:
            raise limit_error(f"{count} frames are over max_frames ({self.max_frames})")
        if pixels > self.max_total_pixels:
            raise limit_error(f"frames of {pixels} pixels together are over max_total_pixels ({self.max_total_pixels})")

    def chunks(self, count: int, what: str = "chunks") -> None:
        if count > self.max_chunks:
            raise limit_error(f"more than max_chunks ({self.max_chunks}) {what}")

    def scans(self, count: int) -> None:
        if count > self.max_scans:
            raise limit_error(f"{count} scans are over max_scans ({self.max_scans})")


DEFAULTS = Limits()


def resolved(limits: Limits | dict | None) -> Limits:
    """Defaults with some of them replaced; unknown names and values that are not positive numbers are refused."""
    if limits is None:
        return DEFAULTS
    if isinstance(limits, Limits):
        return limits
    if not isinstance(limits, dict):
        raise ImageError("BAD_OPTION", "limits are given by name")
    known = {f.name for f in fields(Limits)}
    for name, value in limits.items():
        if name not in known:
            raise ImageError("BAD_OPTION", f"no limit {name!r}; there are {', '.join(sorted(known))}")
        if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not value > 0):
            raise ImageError("BAD_OPTION", f"limit {name} has to be a positive number")
    return replace(DEFAULTS, **{k: v for k, v in limits.items() if v is not None})


def color(value: str) -> str:
    """#rrggbb in lower case, of #rgb or #rrggbb with or without the sign."""
    found = re.fullmatch(r"#?([0-9a-fA-F]{3}|[0-9a-fA-F]{6})", value) if isinstance(value, str) else None
    if not found:
        raise ImageError("BAD_OPTION", f"no colour of the form #rgb or #rrggbb: {value!r}")
    digits = found[1].lower()
    return "#" + (digits if len(digits) == 6 else "".join(d * 2 for d in digits))


def whole(options: dict, name: str, least: int, most: int) -> None:
    value = options.get(name)
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or not least <= value <= most):
        raise ImageError("BAD_OPTION", f"{name} has to be a whole number from {least} to {most}, not {value!r}")


def checked(options: dict) -> dict:
    """Options for scrambling and conversion with the background as #rrggbb; what is out of range is refused."""
    for name, least, most in (("block", 2, 4096), ("level", 0, 9), ("effort", 1, 9)):
        whole(options, name, least, most)
    for name, among in (("mode", SCRAMBLE_MODES), ("subsampling", SUBSAMPLINGS), ("format", OUTPUT_FORMATS)):
        if options.get(name) is not None and options[name] not in among:
            raise ImageError("BAD_OPTION", f"{name} has to be one of {', '.join(among)}, not {options[name]!r}")
    quality = options.get("quality")
    if quality is not None and (isinstance(quality, bool) or not isinstance(quality, (int, float)) or not 1 <= quality <= 100):
        raise ImageError("BAD_OPTION", f"quality has to be a number from 1 to 100, not {quality!r}")
    for name, also in (("transforms", None), ("keep_thumbnails", None), ("progressive", "auto")):
        value = options.get(name)
        if value is not None and not isinstance(value, bool) and value != also:
            raise ImageError("BAD_OPTION", f"{name} has to be true or false, not {value!r}")
    salt = options.get("salt")
    if salt is not None and (not isinstance(salt, (bytes, bytearray)) or len(salt) > 255):
        raise ImageError("BAD_OPTION", "a salt is at most 255 bytes")
    return options if options.get("background") is None else {**options, "background": color(options["background"])}
