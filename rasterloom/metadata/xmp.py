"""XMP packets: their XML as a tree that is written back as it came, and the properties within."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from rasterloom.functions.errors import ImageError

# Namespaces by the prefix that properties are named with here, and how some properties hold their values.
RDF, XML = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/XML/1998/namespace"
NAMESPACES = {
    "x": "adobe:ns:meta/", "rdf": RDF, "dc": "http://purl.org/dc/elements/1.1/", "xmp": "http://ns.adobe.com/xap/1.0/",
    "xmpRights": "http://ns.adobe.com/xap/1.0/rights/", "xmpMM": "http://ns.adobe.com/xap/1.0/mm/",
    "stEvt": "http://ns.adobe.com/xap/1.0/sType/ResourceEvent#", "stRef": "http://ns.adobe.com/xap/1.0/sType/ResourceRef#",
    "xmpNote": "http://ns.adobe.com/xmp/note/", "photoshop": "http://ns.adobe.com/photoshop/1.0/",
    "tiff": "http://ns.adobe.com/tiff/1.0/", "exif": "http://ns.adobe.com/exif/1.0/", "exifEX": "http://cipa.jp/exif/1.0/",
    "aux": "http://ns.adobe.com/exif/1.0/aux/", "crs": "http://ns.adobe.com/camera-raw-settings/1.0/",
    "Iptc4xmpCore": "http://iptc.org/std/Iptc4xmpCore/1.0/xmlns/", "Iptc4xmpExt": "http://iptc.org/std/Iptc4xmpExt/2008-02-29/",
    "plus": "http://ns.useplus.org/ldf/xmp/1.0/", "xmpDM": "http://ns.adobe.com/xmp/1.0/DynamicMedia/", "pdf": "http://ns.adobe.com/pdf/1.3/",
    "GPano": "http://ns.google.com/photos/1.0/panorama/", "lr": "http://ns.adobe.com/lightroom/1.0/",
    "GImage": "http://ns.google.com/photos/1.0/image/", "GDepth": "http://ns.google.com/photos/1.0/depthmap/",
}
LISTS = {
    "dc:creator": "Seq", "dc:contributor": "Bag", "dc:publisher": "Bag", "dc:subject": "Bag", "dc:date": "Seq", "dc:rights": "Alt", "dc:title": "Alt",
    "dc:description": "Alt", "xmpRights:UsageTerms": "Alt", "photoshop:SupplementalCategories": "Bag", "xmp:Identifier": "Bag",
}
ENTITIES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
PREFIXES = {uri: prefix for prefix, uri in NAMESPACES.items()}
DEPTH, RDF_DEPTH, VALUE_DEPTH = 64, 4, 4
NAME = r"[A-Za-z_:][\w.:\-\u00b7\u00c0-\uffff]*"
TOKEN = re.compile(
    rf"(?P<raw><!--.*?-->|<\?.*?\?>)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|</(?P<end>{NAME})\s*>"
    rf"|<(?P<name>{NAME})(?P<attrs>(?:\s+{NAME}\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)(?P<tail>\s*)(?P<empty>/?)>|(?P<text>[^<]+)",
    re.S,
)
ATTRIBUTE = re.compile(rf"\s+({NAME})\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)')", re.S)


class XmpError(ImageError):
    def __init__(self, what: str):
        super().__init__("BAD_XMP", f"XMP cannot be read: {what}")


def unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        body = m[1]
        if body is None:
            raise XmpError("an & that begins nothing")
        if body[0] != "#":
            if body not in ENTITIES:
                raise XmpError(f"unknown entity {body}")
            return ENTITIES[body]
        code = int(body[2:], 16) if body[1] == "x" else int(body[1:])
        if not 0 < code <= 0x10FFFF or 0xD800 <= code <= 0xDFFF:
            raise XmpError("a reference to no character")
        return chr(code)

    return re.sub(r"&(?:(#x[0-9a-fA-F]{1,6}|#\d{1,7}|[a-z]+);)?", one, text)


def escaped(text: str, quoted: bool = False) -> str:
    out = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return out.replace('"', "&quot;").replace("\t", "&#x9;").replace("\n", "&#xA;").replace("\r", "&#xD;") if quoted else out


@dataclass
class Text:
    value: str
    raw: str  # as it is written; comments and instructions have no value

    @property
    def blank(self) -> bool:
        return not self.value.strip() and self.raw == self.value


@dataclass
class Attribute:
    name: str
    value: str
    raw: str


@dataclass
class Element:
    name: str
    attributes: list[Attribute] = field(default_factory=list)
    children: list = field(default_factory=list)
    tail: str = ""
    empty: bool = False

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def put(self, name: str, value: str) -> None:
        self.attributes.append(Attribute(name, value, f' {name}="{escaped(value, True)}"'))


def parsed(text: str) -> list:
    """The nodes of a document. No DTD, no entities but the five, bounded depth."""
    root = Element("")
    stack, at = [root], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise XmpError("a DTD" if text.startswith("<!", at) else f"damaged markup at character {at}")
        at = m.end()
        into = stack[-1].children
        if m["text"] is not None:
            into.append(Text(unescaped(m[0]), m[0]))
        elif m["raw"] is not None:
            into.append(Text("", m[0]))
        elif m["cdata"] is not None:
            into.append(Text(m["cdata"], m[0]))
        elif m["end"] is not None:
            if len(stack) < 2 or stack[-1].name != m["end"]:
                raise XmpError(f"</{m['end']}> closes nothing")
            stack.pop()
        else:
            own = [Attribute(a[1], unescaped(re.sub(r"[\t\n\r]", " ", a[2] if a[2] is not None else a[3])), a[0]) for a in ATTRIBUTE.finditer(m["attrs"])]
            if len({a.name for a in own}) < len(own):
                raise XmpError(f"an attribute of {m['name']} is there twice")
            into.append(Element(m["name"], own, [], m["tail"], bool(m["empty"])))
            if not m["empty"]:
                stack.append(into[-1])
                if len(stack) > DEPTH + 1:
                    raise XmpError("nested too deeply")
    if len(stack) > 1:
        raise XmpError(f"{stack[-1].name} is not closed")
    return root.children


def serialized(nodes: list) -> str:
    out = []
    for n in nodes:
        if isinstance(n, Text):
            out.append(n.raw)
        else:
            head = f"<{n.name}{''.join(a.raw for a in n.attributes)}{n.tail}"
            out.append(head + "/>" if n.empty and not n.children else f"{head}>{serialized(n.children)}</{n.name}>")
    return "".join(out)


def scope_of(e: Element, outer: dict[str, str]) -> dict[str, str]:
    own = {a.name[6:]: a.value for a in e.attributes if a.name == "xmlns" or a.name.startswith("xmlns:")}
    return {**outer, **own} if own else outer


def resolved(name: str, scope: dict[str, str], attribute: bool = False) -> tuple[str, str]:
    """(namespace, local name)."""
    prefix, colon, local = name.partition(":")
    if not colon:
        return ("" if attribute else scope.get("", "")), name
    return (XML if prefix == "xml" else scope.get(prefix, "")), local


def property_name(uri: str, local: str, written: str) -> str:
    return f"{PREFIXES.get(uri, written.split(':')[0])}:{local}"


@dataclass
class Description:
    element: Element
    scope: dict[str, str]
    rdf: Element


class Packet:
    """A packet's properties: attributes and children of its descriptions, named by namespace and not by prefix."""

    def __init__(self, text: str):
        self.nodes = parsed(text)
        self.roots = list(self.rdf_roots(self.nodes, {}, 0))
        if not self.roots:
            raise XmpError("no rdf:RDF")
        self.descriptions = [
            Description(d, scope_of(d, scope), rdf) for rdf, scope in self.roots for d in rdf.elements() if resolved(d.name, scope_of(d, scope)) == (RDF, "Description")
        ]

    def rdf_roots(self, nodes: list, scope: dict[str, str], depth: int) -> Iterator[tuple[Element, dict[str, str]]]:
        for n in nodes:
            if isinstance(n, Element):
                own = scope_of(n, scope)
                if resolved(n.name, own) == (RDF, "RDF"):
                    yield n, own
                elif depth < RDF_DEPTH:
                    yield from self.rdf_roots(n.children, own, depth + 1)

    def parts(self) -> Iterator[tuple[Description, Attribute | Element, str]]:
        """(description, attribute or child, name) of each property."""
        for d in self.descriptions:
            for a in d.element.attributes:
                uri, local = resolved(a.name, d.scope, True)
                if a.name != "xmlns" and not a.name.startswith("xmlns:") and uri not in ("", RDF, XML):
                    yield d, a, property_name(uri, local, a.name)
            for c in d.element.elements():
                uri, local = resolved(c.name, scope_of(c, d.scope))
                yield d, c, property_name(uri, local, c.name)

    def properties(self) -> list[tuple[str, object]]:
        return [(name, p.value if isinstance(p, Attribute) else value_of(p, scope_of(p, d.scope))) for d, p, name in self.parts()]

    def remove(self, goes: Callable[[str], bool]) -> list[str]:
        gone = []
        for d, p, name in list(self.parts()):
            if not goes(name):
                continue
            gone.append(name)
            if isinstance(p, Attribute):
                d.element.attributes.remove(p)
                continue
            children = d.element.children
            at = next(k for k, c in enumerate(children) if c is p)
            indented = at and isinstance(children[at - 1], Text) and children[at - 1].blank
            del children[at - indented : at + 1]
        return gone

    def set(self, name: str, value: str | list[str]) -> None:
        """Puts a property in place of all of its name, indented like others."""
        prefix, _, local = name.partition(":")
        self.remove(lambda n: n == name)
        if not self.descriptions:
            rdf, scope = self.roots[0]
            made = Element(f"{self.prefix(scope, 'rdf')}:Description")
            made.put(f"{self.prefix(scope, 'rdf')}:about", "")
            rdf.children += [Text("\n  ", "\n  "), made, Text("\n ", "\n ")]
            self.descriptions.append(Description(made, scope, rdf))
        d = self.descriptions[0]
        own, rdf = self.declared(d, prefix), self.prefix(d.scope, "rdf")
        made = Element(f"{own}:{local}")
        values, kind = value if isinstance(value, list) else [value], LISTS.get(name)
        leaf = lambda v: Text(v, escaped(v))
        if kind is None:
            made.children.append(leaf(", ".join(values)))
        else:
            items = Element(f"{rdf}:{kind}")
            for v in values:
                item = Element(f"{rdf}:li", children=[leaf(v)])
                if kind == "Alt":
                    item.put("xml:lang", "x-default")
                items.children.append(item)
            made.children.append(items)
        gap = lambda n: isinstance(n, Text) and n.blank and "\n" in n.raw
        siblings, inside = d.rdf.children, d.element.children
        before = siblings[next(k for k, c in enumerate(siblings) if c is d.element) - 1]
        closing = before.raw if gap(before) else "\n"
        indent = next((n.raw for n in inside if gap(n)), closing + " ")
        if inside and gap(inside[-1]):
            inside[-1:-1] = [Text(indent, indent), made]
        else:
            inside += [Text(indent, indent), made, Text(closing, closing)]
        d.element.empty = False

    @staticmethod
    def prefix(scope: dict[str, str], of: str) -> str:
        return next((p for p, u in scope.items() if p and u == NAMESPACES[of]), of)

    def declared(self, d: Description, of: str) -> str:
        """The prefix of a namespace at a description, declared there if it has none."""
        found = next((p for p, u in d.scope.items() if p and u == NAMESPACES[of]), None)
        if found:
            return found
        name = next(p for p in (of, *(f"{of}{k}" for k in range(1, 1000))) if p not in d.scope)
        d.element.put(f"xmlns:{name}", NAMESPACES[of])
        d.scope = {**d.scope, name: NAMESPACES[of]}
        return name

    def __str__(self) -> str:
        return serialized(self.nodes)


def value_of(e: Element, scope: dict[str, str], depth: int = 0):
    """A property's value: text, the items of a list, or the fields of a structure."""
    link = next((a.value for a in e.attributes if resolved(a.name, scope, True) == (RDF, "resource")), None)
    if link is not None:
        return link
    inside = e.elements()
    if not inside:
        fields = {a.name: a.value for a in e.attributes if not a.name.startswith(("xmlns", "rdf:", "xml:"))}
        return fields or "".join(c.value for c in e.children if isinstance(c, Text)).strip()
    if depth > VALUE_DEPTH:
        return "…"
    first, own = inside[0], scope_of(inside[0], scope)
    uri, local = resolved(first.name, own)
    if uri == RDF and local in ("Seq", "Bag", "Alt"):
        items = [value_of(li, scope_of(li, own), depth + 1) for li in first.elements()]
        return [v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in items]

    def fields_of(of: Element, outer: dict[str, str]) -> dict:
        out = {}
        for c in of.elements():
            inner = scope_of(c, outer)
            uri, local = resolved(c.name, inner)
            out.update(fields_of(c, inner) if (uri, local) == (RDF, "Description") else {property_name(uri, local, c.name): value_of(c, inner, depth + 1)})
        return out

    return fields_of(e, scope)


def known_property(name: str) -> bool:
    m = re.fullmatch(r"([A-Za-z][\w-]*):([A-Za-z_][\w.-]*)", name)
    return bool(m) and m[1] in NAMESPACES and m[1] not in ("x", "rdf")


EMPTY = (
    '<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/">\n'
    f' <rdf:RDF xmlns:rdf="{RDF}">\n  <rdf:Description rdf:about=""/>\n </rdf:RDF>\n</x:xmpmeta>\n<?xpacket end="w"?>'
)


def info(text: str) -> dict:
    """Properties for people, or why there are none."""
    try:
        found = Packet(text).properties()
    except XmpError as e:
        return {"bytes": len(text), "error": str(e)}
    cut = lambda v: v if not isinstance(v, str) or len(v) <= 2000 else v[:2000] + "…"
    return {"bytes": len(text), "properties": [{"name": n, "value": cut(v)} for n, v in found]}
