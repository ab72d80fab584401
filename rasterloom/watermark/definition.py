"""Watermark definitions and compiled watermarks: their fields, bounds and defaults, as one table.

A field is (kind, bounds, default). NEEDED as a default means that there is none. Compiled watermarks
come from untrusted places, so every size and count has a bound.
"""

from __future__ import annotations

import json
import math
import re

from rasterloom.functions.errors import ImageError

NEEDED = object()
# Names that fields may have, patterns of names, bounds of compiled paths.
ANCHORS = ("top-left", "top", "top-right", "left", "center", "right", "bottom-left", "bottom", "bottom-right")
ORNAMENTS = ("sparkle", "star", "diamond", "dot", "heart", "line", "image")
POSITIONS = ("before", "after", "above", "below", "top-left", "top-right", "bottom-left", "bottom-right")
ID, FONT, ASSET = r"[a-z0-9](?:[a-z0-9-]{0,46}[a-z0-9])?", r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}", r"[A-Za-z0-9][A-Za-z0-9_-]{0,63}\.png"
PATH, PATH_CHARS, SHAPES, SIDE, UNITS, COMPILED_VERSION = r"[MLQCZ0-9 .-]*", 200_000, 24, 256, 1000, 1
#: What this package writes as the format of a compiled watermark; any other name that ends alike is read, too.
FORMAT, FORMATS = "rasterloom-watermark", r"[a-z0-9-]+-watermark"


def number(low: float, high: float, default=NEEDED):
    return "number", (low, high), default


def one_of(*names: str, default=NEEDED):
    return "name", names, default


def text(pattern: str | None, most: int, default=NEEDED):
    return "text", (pattern, most), default


def fields(default=NEEDED, **inside):
    return "fields", inside, {} if default is NEEDED else default


def paint(default=NEEDED):
    return "paint", None, default


def several(inside, least: int, most: int):
    return "list", (inside, least, most), [] if least == 0 else NEEDED


STOPS = several(fields(at=number(0, 1), color=("color", None, NEEDED)), 2, 8)
GRADIENT = fields(type=one_of("linear"), angle=number(0, 360, 180), stops=STOPS)
COMPILED_GRADIENT = fields(type=one_of("linear"), dir=several(number(-1, 1), 2, 2), stops=STOPS)
PLACEMENT = {
    "size": fields(px=number(1, 2000, None), relative=number(0.001, 1, 0.03), of=one_of("short", "long", "width", "height", "diagonal", default="short"), min=number(1, 2000, 10), max=number(1, 2000, 48), snap=number(0, 256, 0)),
    "fit": fields(maxWidth=number(0.05, 1, 0.5), maxHeight=number(0.05, 1, 0.25), minSize=number(0, 200, 6)),
    "anchor": one_of(*ANCHORS, default="bottom-right"),
    "margin": fields(relative=number(0, 0.5, 0.02), min=number(0, 2000, 4), max=number(0, 2000, 32)),
    "offset": fields(x=number(-20, 20, 0), y=number(-20, 20, 0)),
}
STYLE = {
    "opacity": number(0, 1, 1),
    "crisp": ("flag", None, False),
    "stroke": fields(None, color=("color", None, "#000000"), width=number(0.001, 1, 0.1), join=one_of("round", "square", default="round"), opacity=number(0, 1, 1)),
    "shadow": fields(None, color=("color", None, "#000000"), opacity=number(0, 1, 0.5), x=number(-2, 2, 0.08), y=number(-2, 2, 0.08), blur=number(0, 2, 0)),
    "background": fields(
        None, shape=one_of("box", "pill", "strip", default="box"), fill=paint("#000000"), opacity=number(0, 1, 0.6), radius=number(0, 5, 0.25),
        padding=fields(x=number(0, 5, 0.5), y=number(0, 5, 0.3)), border=fields(None, fill=paint("#ffffff"), width=number(0.001, 1, 0.08)),
    ),
}
ORNAMENT = fields(
    shape=one_of(*ORNAMENTS, default="sparkle"), position=one_of(*POSITIONS, default="after"), size=number(0.05, 4, 0.5), thickness=number(0.01, 1, 0.06), gap=number(-2, 4, 0.15),
    offset=fields(x=number(-4, 4, 0), y=number(-4, 4, 0)), fill=paint(None), outline=("flag", None, True), src=text(ASSET, 68, None),
)
DEFINITION = fields(
    id=text(ID, 48), name=text(None, 80, None), text=("lines", None, NEEDED), font=text(FONT, 64), letterSpacing=number(-1, 2, 0), lineHeight=number(0.5, 4, 1.2),
    align=one_of("left", "center", "right", default="left"), fill=paint("#ffffff"), **PLACEMENT, **STYLE, ornaments=several(ORNAMENT, 0, 8),
)
COORDINATE = number(-1e6, 1e6)
SHAPE = fields(
    d=text(PATH, PATH_CHARS), fill=paint(), outline=("flag", None, True),
    image=fields(None, width=("whole", (1, SIDE), NEEDED), height=("whole", (1, SIDE), NEEDED), box=several(COORDINATE, 4, 4), rgba=text(r"[A-Za-z0-9+/]*={0,2}", -(-SIDE * SIDE * 4 // 3) + 4)),
)
COMPILED = fields(format=text(FORMATS, 80), version=("whole", (COMPILED_VERSION, COMPILED_VERSION), NEEDED), id=text(ID, 48), name=text(None, 80), box=several(COORDINATE, 4, 4), **PLACEMENT, **STYLE, shapes=several(SHAPE, 1, SHAPES))
ABSENT = object()


def refuse(path: str, why: str):
    raise ImageError("BAD_WATERMARK", f"watermark {path or '(all)'}: {why}")


def checked(spec, value, path: str = "", gradient=COMPILED_GRADIENT):
    """The value in its normal form: all fields there, in the table's order."""
    kind, bounds, default = spec
    if value is ABSENT:
        if default is NEEDED:
            refuse(path, "is needed")
        if kind != "fields" or default is None:
            return default if kind != "list" else list(default)
        value = default
    if value is None:
        return None if default is None else refuse(path, "must not be null")
    if kind in ("number", "whole"):
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or (kind == "whole" and value != int(value)):
            refuse(path, "has to be a number" if kind == "number" else "has to be a whole number")
        return value if bounds[0] <= value <= bounds[1] else refuse(path, f"has to be from {bounds[0]} to {bounds[1]}")
    if kind == "flag":
        return value if isinstance(value, bool) else refuse(path, "has to be true or false")
    if kind == "name":
        return value if value in bounds else refuse(path, f"has to be one of {', '.join(bounds)}")
    if kind == "color":
        if not isinstance(value, str) or not re.fullmatch(r"#([0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})", value):
            refuse(path, "has to be a colour like #rrggbb or #rrggbbaa")
        digits = value[1:].lower()
        return "#" + ("".join(2 * x for x in digits) if len(digits) == 3 else digits)
    if kind == "text":
        if not isinstance(value, str) or len(value) > bounds[1]:
            refuse(path, f"has to be a text of at most {bounds[1]} characters")
        return value if bounds[0] is None or re.fullmatch(bounds[0], value) else refuse(path, "is not of the form that it has to be")
    if kind == "lines":
        value = checked(text(None, 200), value, path)
        if not value.strip() or value.count("\n") > 3 or re.search(r"[\x00-\x09\x0b-\x1f\x7f]", value):
            refuse(path, "has to be one to four lines without control characters")
        return value
    if kind == "paint":
        if isinstance(value, str):
            return checked(("color", None, NEEDED), value, path)
        out = checked(gradient, value, path, gradient)
        places = [s["at"] for s in out["stops"]]
        return out if gradient is COMPILED_GRADIENT or places == sorted(places) else refuse(path + ".stops", "have to be in order")
    if kind == "list":
        inside, least, most = bounds
        if not isinstance(value, list) or not least <= len(value) <= most:
            refuse(path, f"has to be a list of {least} to {most}")
        return [checked(inside, x, f"{path}[{i}]", gradient) for i, x in enumerate(value)]
    if not isinstance(value, dict):
        refuse(path, "has to be an object")
    for name in value:
        if name not in bounds:
            refuse(f"{path}.{name}".lstrip("."), "is not a field")
    return {name: checked(inside, value.get(name, ABSENT), f"{path}.{name}".lstrip("."), gradient) for name, inside in bounds.items()}


def normal_definition(value: dict) -> dict:
    out = checked(DEFINITION, value, gradient=GRADIENT)
    if out["name"] is None:
        out["name"] = out["id"]
    for i, o in enumerate(out["ornaments"]):
        if (o["shape"] == "image") != (o["src"] is not None):
            refuse(f"ornaments[{i}].src", "goes with an image, and only with one")
    for name in ("size", "margin"):
        if out[name]["min"] > out[name]["max"]:
            refuse(f"{name}.min", f"is over {name}.max")
    return out


def compiled(value: dict) -> dict:
    """A compiled watermark, checked."""
    out = checked(COMPILED, value)
    if sum(len(s["d"]) for s in out["shapes"]) > PATH_CHARS:
        refuse("shapes", "hold too long paths")
    for i, s in enumerate(out["shapes"]):
        if s["image"] and len(s["image"]["rgba"]) != 4 * -(-s["image"]["width"] * s["image"]["height"] * 4 // 3):
            refuse(f"shapes[{i}].image.rgba", "does not have the image's size")
    return out


def plain(value) -> bool:
    return not isinstance(value, (dict, list))


def json_text(value, indent: str = "") -> str:
    """JSON, the same for the same value: what holds plain values only and is short is one line, the rest is indented."""
    if plain(value):
        return json.dumps(int(value) if isinstance(value, float) and value.is_integer() else value, ensure_ascii=False)
    named = isinstance(value, dict)
    items = [(json.dumps(k, ensure_ascii=False) + ": ", v) for k, v in value.items()] if named else [("", v) for v in value]
    opening, closing = "{}" if named else "[]"
    if not items:
        return opening + closing
    line = ", ".join(k + json_text(v) for k, v in items) if all(plain(v) for _, v in items) else None
    if line is not None and len(line) + len(indent) <= 90:
        return f"{{ {line} }}" if named else f"[{line}]"
    body = ",\n".join(f"{indent}  {k}{json_text(v, indent + '  ')}" for k, v in items)
    return f"{opening}\n{body}\n{indent}{closing}"


def definition_text(value: dict) -> str:
    return json_text(normal_definition(value)) + "\n"
