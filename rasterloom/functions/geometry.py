"""Orientation of pictures and delays of animation frames."""

from __future__ import annotations

from fractions import Fraction
from math import gcd

import numpy as np

#: By orientation: whether the shown picture is the stored one with axes swapped, then flipped in x, in y.
STEPS = {1: (0, 0, 0), 2: (0, 1, 0), 3: (0, 1, 1), 4: (0, 0, 1), 5: (1, 0, 0), 6: (1, 1, 0), 7: (1, 1, 1), 8: (1, 0, 1)}


def swaps_axes(orientation: int) -> bool:
    return 5 <= orientation <= 8


def displayed(stored: np.ndarray, orientation: int) -> np.ndarray:
    """A stored raster (height, width, ...) as it is shown."""
    swap, flip_x, flip_y = STEPS[orientation]
    out = stored.swapaxes(0, 1) if swap else stored
    out = out[:, ::-1] if flip_x else out
    return np.ascontiguousarray(out[::-1] if flip_y else out)


def undisplayed(shown: np.ndarray, orientation: int) -> np.ndarray:
    """The raster that displayed() made this one of."""
    swap, flip_x, flip_y = STEPS[orientation]
    out = shown[::-1] if flip_y else shown
    out = out[:, ::-1] if flip_x else out
    return np.ascontiguousarray(out.swapaxes(0, 1) if swap else out)


def stored_index(orientation: int, width: int, height: int) -> np.ndarray:
    """For each shown pixel (rows of the shown picture), the index of its stored one."""
    return displayed(np.arange(width * height).reshape(height, width), orientation)


def orientation_matrix(orientation: int, width: int, height: int) -> tuple[int, int, int, int, int, int]:
    """(a, b, c, d, e, f) that takes stored x, y to shown x' = a x + c y + e, y' = b x + d y + f, for a stored width and height."""
    swap, flip_x, flip_y = STEPS[orientation]
    x, y = ((0, 1), (1, 0)) if swap else ((1, 0), (0, 1))
    w, h = (height, width) if swap else (width, height)
    x, e = ((-x[0], -x[1]), w) if flip_x else (x, 0)
    y, f = ((-y[0], -y[1]), h) if flip_y else (y, 0)
    return x[0], y[0], x[1], y[1], e, f


def apng_delay(numerator: int, denominator: int) -> tuple[int, int]:
    """A delay in seconds as a fraction of two 16-bit numbers: as it is, else reduced, else scaled down to fit."""
    n, d = numerator, denominator or 100
    if max(n, d) > 65535:
        common = gcd(n, d)
        n, d = n // common, d // common
    if max(n, d) > 65535:
        scale = max(n, d) / 65535
        n, d = min(65535, int(n / scale + 0.5)), max(1, int(d / scale + 0.5))
    return n, d


def exact_delay(numerator: int, denominator: int) -> tuple[int, int]:
    value = Fraction(numerator, denominator or 100)
    return value.numerator, value.denominator


def nearest_scaled(raster: np.ndarray, width: int, height: int) -> np.ndarray:
    """A smaller raster of the samples nearest to its pixels' centres."""
    h, w = raster.shape[:2]
    ys, xs = (np.minimum(n - 1, ((np.arange(m) + 0.5) * n / m).astype(int)) for n, m in ((h, height), (w, width)))
    return raster[ys[:, None], xs]


def box_scaled(raster: np.ndarray, width: int, height: int) -> np.ndarray:
    """A smaller raster of the means of the samples that each of its pixels covers."""
    h, w = raster.shape[:2]
    cells = [np.minimum(m - 1, np.arange(n) * m // n) for n, m in ((h, height), (w, width))]
    firsts = [np.searchsorted(c, np.arange(m)) for c, m in zip(cells, (height, width))]
    sums = np.add.reduceat(np.add.reduceat(raster.astype(np.float64), firsts[0], axis=0), firsts[1], axis=1)
    counts = np.bincount(cells[0], minlength=height)[:, None] * np.bincount(cells[1], minlength=width)
    return np.clip(np.floor(sums / counts[:, :, None] + 0.5), 0, 255).astype(np.uint8)


def reveal_plan(effect: str, width: int, height: int, tile: tuple[int, int] | None = None, tiles: int = 0, fit: int = 0, most: int = 1_500_000, most_tiles: int = 6000) -> tuple[str, int, int]:
    """(effect, width, height) that a picture is shown with: large ones are scaled to fit, and by whole
    pixels of a tile where tiles move."""
    if effect == "blocks" and not (tile and 0 < tiles <= most_tiles):
        effect = "dissolve"
    scale = 1.0
    if width * height > most:
        scale = (min(most, fit or most) / (width * height)) ** 0.5
        if effect == "blocks":
            unit = gcd(*tile)
            scale = max(1, int(scale * unit)) / unit
    return effect if effect in ("scan", "blocks") else "dissolve", max(1, int(width * scale)), max(1, int(height * scale))
