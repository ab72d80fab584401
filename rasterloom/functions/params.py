"""Keys, scramble parameters and the marker that records them in a file."""

from __future__ import annotations

import hmac
import os
import struct
from dataclasses import dataclass, replace

from rasterloom.functions.errors import ImageError
from rasterloom.functions.keys import CHECK_BYTES, MODES, TRANSFORMS

# Bits of the block field of MCU mode, flags of a marker of version 2, bounds of the format.
MCU_TRANSFORMS, MCU_PROGRESSIVE = 1, 2
STASHED, ENLARGED = 1, 2
SALT_BYTES, LEAST_BLOCK, MOST_BLOCK = 16, 2, 4096
#: Whole tiles that each frame has to have, if it has any: without and with transforms.
LEAST_TILES = {False: 8, True: 4}


def key_bytes(key: str | bytes) -> bytes:
    """A key as bytes. Empty keys are refused, and so is text that is not valid Unicode, as such keys could fall together."""
    if isinstance(key, str):
        try:
            key = key.encode()
        except UnicodeEncodeError as e:
            raise ImageError("BAD_OPTION", "the key is not valid Unicode; give bytes") from e
    if not isinstance(key, (bytes, bytearray)) or not key:
        raise ImageError("BAD_OPTION", "a key of text or bytes is needed, and not an empty one")
    return bytes(key)


@dataclass(frozen=True)
class Params:
    mode: str
    block: int
    salt: bytes
    flags: int = 0

    @property
    def tile(self) -> int:
        return self.block & ~TRANSFORMS

    @property
    def transforms(self) -> bool:
        return bool(self.block & (MCU_TRANSFORMS if self.mode == "mcu" else TRANSFORMS))

    @property
    def progressive(self) -> bool:
        return self.mode == "mcu" and bool(self.block & MCU_PROGRESSIVE)


def params(mode: str = "block", block: int = 16, transforms: bool = True, progressive: bool = False, salt: bytes | None = None) -> Params:
    """Checked parameters; without a salt, a random one, so call it per row."""
    if mode not in MODES:
        raise ImageError("BAD_OPTION", f"mode has to be one of {', '.join(MODES)}, not {mode!r}")
    if mode == "block" and (isinstance(block, bool) or not isinstance(block, int) or not LEAST_BLOCK <= block <= MOST_BLOCK):
        raise ImageError("BAD_OPTION", f"block has to be a whole number from {LEAST_BLOCK} to {MOST_BLOCK}")
    if salt is not None and (not isinstance(salt, (bytes, bytearray)) or len(salt) > 255):
        raise ImageError("BAD_OPTION", "a salt is at most 255 bytes")
    field = {"pixel": 0, "block": block | (TRANSFORMS if transforms else 0), "mcu": (MCU_TRANSFORMS if transforms else 0) | (MCU_PROGRESSIVE if progressive else 0)}[mode]
    return Params(mode, field, bytes(salt) if salt is not None else os.urandom(SALT_BYTES))


def fitted(p: Params, sizes: list[tuple[int, int]]) -> Params:
    """The largest tile up to the one asked for with which each frame has no whole tile or enough of
    them; a frame of a few tiles would hardly change. Where no tile fits, pixel mode."""
    if p.mode != "block":
        return p
    least = LEAST_TILES[p.transforms]
    for tile in range(p.tile, LEAST_BLOCK - 1, -1):
        counts = [(w // tile) * (h // tile) for w, h in sizes]
        if all(n == 0 or n >= least for n in counts):
            return p if tile == p.tile else replace(p, block=tile | p.block & TRANSFORMS)
    return replace(p, mode="pixel", block=0)


def marker(p: Params, check: bytes) -> bytes:
    head = struct.pack(">BBHB", 2 if p.flags else 1, MODES[p.mode], p.block, len(p.salt))
    return head + p.salt + check + (bytes([p.flags]) if p.flags else b"")


def read_marker(data: bytes) -> tuple[Params, bytes]:
    """(params, check) of a marker; one of a wrong length, mode or tile, or of unknown flags, is refused."""
    bad = lambda what: ImageError("BAD_MARKER", f"the marker is damaged ({what})")
    if len(data) < 5:
        raise bad("length")
    version, mode, block, salted = struct.unpack_from(">BBHB", data)
    if version not in (1, 2):
        raise ImageError("UNSUPPORTED", f"marker version {version}")
    names = {v: k for k, v in MODES.items()}
    if mode not in names:
        raise bad("mode")
    if len(data) != 5 + salted + CHECK_BYTES + (version == 2):
        raise bad("length")
    if names[mode] == "block" and not LEAST_BLOCK <= block & ~TRANSFORMS <= MOST_BLOCK:
        raise bad("tile")
    flags = data[-1] if version == 2 else 0
    if flags & ~(STASHED | ENLARGED):
        raise ImageError("UNSUPPORTED", f"marker flags {flags}")
    return Params(names[mode], block, data[5 : 5 + salted], flags), data[5 + salted : 5 + salted + CHECK_BYTES]


def same_check(a: bytes, b: bytes) -> bool:
    return hmac.compare_digest(a, b)


def inverse_transform(code: int) -> int:
    """The transform that undoes one: flips change places under a transpose."""
    flip_x, flip_y = code & 1, code >> 1 & 1
    return 4 | flip_y | flip_x << 1 if code & 4 else code
