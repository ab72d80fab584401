"""Definitions made into compiled watermarks: lines of outlines, ornaments beside them, gradients as directions.

Outlines of characters come from a function that is passed in, as there is no font reader here: it takes a
font's name and a character and gives (advance, path) in em, y down, or None.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable
from xml.sax.saxutils import quoteattr

import numpy as np

from rasterloom.functions.errors import ImageError
from rasterloom.sources import raster
from rasterloom.watermark.definition import COMPILED_VERSION, FORMAT, PLACEMENT, SIDE, STYLE, UNITS, compiled, normal_definition
from rasterloom.watermark.render import QUARTER, commands

Glyphs = Callable[[str, str], "tuple[float, str] | None"]
# Shapes of ornaments around 0, 0, one high and wide.
_Q = QUARTER / 2
ORNAMENT_PATHS = {
    "sparkle": "M0 -0.5Q0.07 -0.07 0.5 0Q0.07 0.07 0 0.5Q-0.07 0.07 -0.5 0Q-0.07 -0.07 0 -0.5Z",
    "diamond": "M0 -0.5L0.32 0L0 0.5L-0.32 0Z",
    "heart": "M0 0.45C-0.55 0.08 -0.5 -0.5 0 -0.22C0.5 -0.5 0.55 0.08 0 0.45Z",
    "line": "M-0.5 -0.5L0.5 -0.5L0.5 0.5L-0.5 0.5Z",
    "dot": f"M0.5 0C0.5 {_Q} {_Q} 0.5 0 0.5C{-_Q} 0.5 -0.5 {_Q} -0.5 0C-0.5 {-_Q} {-_Q} -0.5 0 -0.5C{_Q} -0.5 0.5 {-_Q} 0.5 0Z",
    "star": "M" + "L".join(f"{r * math.cos(a):.6f} {r * math.sin(a) + 0.04:.6f}" for a, r in ((-math.pi / 2 + k * math.pi / 5, 0.2 if k % 2 else 0.5) for k in range(10))) + "Z",
}


def moved(d: str, scale_x: float, scale_y: float, x: float, y: float) -> str:
    """A path scaled and moved, in whole units."""
    return "".join(letter + " ".join(str(math.floor(v + 0.5)) for v in (points * (scale_x, scale_y) + (x, y)).ravel()) for letter, points in commands(d))


def bounds(paths: list[str]) -> tuple[float, float, float, float] | None:
    """The box of paths, their curves included: at begins, ends and where a curve turns."""
    seen: list[np.ndarray] = []
    for d in paths:
        here = np.zeros(2)
        for _, points in commands(d):
            if not len(points):
                continue
            if len(points) > 1:
                p = np.concatenate([here[None], points])
                for axis in (0, 1):
                    steps = np.diff(p[:, axis])
                    # the derivative as a polynomial in t
                    slope = [steps[1] - steps[0], steps[0]] if len(p) == 3 else [steps[0] - 2 * steps[1] + steps[2], 2 * (steps[1] - steps[0]), steps[0]]
                    for t in np.roots(np.trim_zeros(np.where(np.abs(slope) < 1e-12, 0, slope), "f")):
                        if abs(t.imag) < 1e-9 and 0 < t.real < 1:
                            q = p
                            while len(q) > 1:
                                q = q[:-1] * (1 - t.real) + q[1:] * t.real
                            seen.append(q[0])
            here = points[-1]
            seen.append(here)
    if not seen:
        return None
    box = np.array(seen)
    return (*box.min(0).tolist(), *box.max(0).tolist())


def text_paths(d: dict, glyphs: Glyphs) -> list[str]:
    """The outlines of a definition's lines, a path a line, aligned."""
    lines, widths = [], []
    for line in d["text"].split("\n"):
        x, parts = 0.0, []
        for k, c in enumerate(line):
            found = glyphs(d["font"], c)
            if found is None:
                raise ImageError("BAD_WATERMARK", f"font {d['font']!r} has no {c!r}")
            x += d["letterSpacing"] if k else 0
            parts.append((found[1], x))
            x += found[0]
        lines.append(parts)
        widths.append(x)
    room, share = max(widths), {"left": 0.0, "center": 0.5, "right": 1.0}[d["align"]]
    return ["".join(moved(path, UNITS, UNITS, (x + (room - w) * share) * UNITS, k * d["lineHeight"] * UNITS) for path, x in parts) for k, (parts, w) in enumerate(zip(lines, widths))]


def logo(name: str, asset: Callable[[str], bytes | None]) -> dict:
    data = asset(name)
    if data is None:
        raise ImageError("BAD_WATERMARK", f"no asset {name!r}")
    rgba = raster.decoded(data).rgba
    if rgba.dtype != np.uint8 or max(rgba.shape[:2]) > SIDE:
        raise ImageError("BAD_WATERMARK", f"a logo has 8 bits and at most {SIDE} pixels a side")
    return {"width": rgba.shape[1], "height": rgba.shape[0], "rgba": base64.b64encode(rgba.tobytes()).decode()}


def ornament(o: dict, text: tuple, asset: Callable[[str], bytes | None]) -> dict:
    """An ornament's path, and image, beside the text's box."""
    x0, y0, x1, y1 = text
    w = h = o["size"] * UNITS
    image = None
    if o["shape"] == "line":
        w, h = (o["size"] * (x1 - x0) if o["position"] in ("above", "below") else w), o["thickness"] * UNITS
    elif o["shape"] == "image":
        image = logo(o["src"], asset)
        w = h * image["width"] / image["height"]
    gap, middle = o["gap"] * UNITS, ((x0 + x1) / 2, (y0 + y1) / 2)
    side = {"before": (x0 - gap - w / 2, middle[1]), "after": (x1 + gap + w / 2, middle[1]), "above": (middle[0], y0 - gap - h / 2), "below": (middle[0], y1 + gap + h / 2)}
    corner = ((x0 - gap) if o["position"].endswith("left") else (x1 + gap), y0 if o["position"].startswith("top") else y1)
    x, y = (c + o["offset"][k] * UNITS for c, k in zip(side.get(o["position"], corner), "xy"))
    if image is None:
        return {"d": moved(ORNAMENT_PATHS[o["shape"]], w, h, x, y), "image": None}
    d = moved(ORNAMENT_PATHS["line"], w, h, x, y)
    return {"d": d, "image": {**image, "box": list(bounds([d]))}}


def direction(paint):
    """A gradient's angle, from upwards clockwise, as a direction."""
    if isinstance(paint, str):
        return paint
    a = math.radians(paint["angle"])
    return {"type": "linear", "dir": [round(math.sin(a), 6) + 0.0, round(-math.cos(a), 6) + 0.0], "stops": paint["stops"]}


def compile_watermark(definition: dict, glyphs: Glyphs, asset: Callable[[str], bytes | None] = lambda name: None) -> dict:
    d = normal_definition(definition)
    lines = text_paths(d, glyphs)
    box = bounds(lines)
    if box is None:
        raise ImageError("BAD_WATERMARK", "the text has no outlines")
    shapes = [{"d": p, "fill": direction(d["fill"]), "outline": True, "image": None} for p in lines if p]
    for o in d["ornaments"]:
        made = ornament(o, box, asset)
        shapes.append({"d": made["d"], "fill": direction(d["fill"] if o["fill"] is None else o["fill"]), "outline": o["outline"], "image": made["image"]})
    whole = bounds([s["d"] for s in shapes])
    style = {k: d[k] for k in STYLE}
    if style["background"]:
        border = style["background"]["border"]
        style["background"] = {**style["background"], "fill": direction(style["background"]["fill"]), "border": border and {**border, "fill": direction(border["fill"])}}
    return compiled({"format": FORMAT, "version": COMPILED_VERSION, "id": d["id"], "name": d["name"], "box": list(whole), **{k: d[k] for k in PLACEMENT}, **style, "shapes": shapes})


def svg(mark: dict, size: float = 48) -> str:
    """A preview of a compiled watermark at so many pixels an em; its logos are left out."""
    back, stroke = mark["background"], mark["stroke"]
    pad = UNITS * ((max(back["padding"].values()) if back else 0) + (stroke["width"] if stroke else 0) + 0.3)
    x0, y0, x1, y1 = (v + pad * s for v, s in zip(mark["box"], (-1, -1, 1, 1)))
    defs: list[str] = []

    def element(name: str, *inside: str, **attributes) -> str:
        body = "".join(f" {k.replace('_', '-')}={quoteattr(f'{v:g}' if isinstance(v, (int, float)) else v)}" for k, v in attributes.items() if v is not None)
        return f"<{name}{body}>{''.join(inside)}</{name}>" if inside else f"<{name}{body}/>"

    def ink(paint, name: str) -> str:
        if isinstance(paint, str):
            return paint
        dx, dy = paint["dir"]
        stops = [element("stop", offset=s["at"], stop_color=s["color"][:7], stop_opacity=int(s["color"][7:] or "ff", 16) / 255) for s in paint["stops"]]
        defs.append(element("linearGradient", *stops, id=name, x1=0.5 - dx / 2, y1=0.5 - dy / 2, x2=0.5 + dx / 2, y2=0.5 + dy / 2))
        return f"url(#{name})"

    parts = []
    if back:
        px, py = back["padding"]["x"] * UNITS, back["padding"]["y"] * UNITS
        left, top, right, bottom = mark["box"]
        h = bottom - top + 2 * py
        rim = back["border"]
        parts.append(element("rect", x=left - px, y=top - py, width=right - left + 2 * px, height=h, rx=h / 2 if back["shape"] == "pill" else min(back["radius"] * UNITS, h / 2), fill=ink(back["fill"], "b"), fill_opacity=back["opacity"], stroke=ink(rim["fill"], "r") if rim else None, stroke_width=rim["width"] * UNITS if rim else None))
    for k, s in enumerate(mark["shapes"]):
        if not s["image"]:
            line = {"stroke": stroke["color"], "stroke_opacity": stroke["opacity"], "stroke_width": stroke["width"] * UNITS * 2, "stroke_linejoin": "round" if stroke["join"] == "round" else "miter", "paint_order": "stroke"} if stroke and s["outline"] else {}
            parts.append(element("path", d=s["d"], fill=ink(s["fill"], f"f{k}"), **line))
    scale = size / UNITS
    inside = ([element("defs", *defs)] if defs else []) + parts
    return element("svg", *inside, xmlns="http://www.w3.org/2000/svg", width=math.ceil((x1 - x0) * scale), height=math.ceil((y1 - y0) * scale), viewBox=f"{x0:g} {y0:g} {x1 - x0:g} {y1 - y0:g}", opacity=mark["opacity"] if mark["opacity"] < 1 else None) + "\n"
