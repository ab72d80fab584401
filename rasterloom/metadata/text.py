"""Text in files: comments, PNG text chunks, labels."""

from __future__ import annotations

import re
import zlib

from rasterloom.functions.errors import ImageError, limit_error

SEGMENT = 65533
XMP_KEYWORD = "XML:com.adobe.xmp"


def bounded(data: bytes, most: float, what: str = "metadata") -> bytes:
    """Inflated data; more than `most` bytes are refused, damaged data raise BAD_METADATA. Bytes after the stream are let pass."""
    z = zlib.decompressobj()
    try:
        out = z.decompress(data, int(most) + 1)
    except zlib.error as e:
        raise ImageError("BAD_METADATA", f"{what} is damaged: {e}") from e
    if len(out) > most:
        raise limit_error(f"{what} inflates to more than max_metadata_bytes")
    if not z.eof:
        raise ImageError("BAD_METADATA", f"{what} is cut")
    return out


def latin(data: bytes) -> str:
    """Bytes of the old one-byte encoding as browsers read it; what that leaves free is a control character."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data) if any(0x80 <= b < 0xA0 for b in data) else data.decode("latin-1")


def comment(data: bytes) -> str:
    """A JPEG comment: UTF-8 where it is valid, else one byte a character."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return latin(data)


def comment_bytes(text: str) -> bytes:
    """UTF-8, cut to a segment at the border of a character."""
    return text.encode("utf-8", "replace")[:SEGMENT].decode("utf-8", "ignore").encode()


def is_keyword(word: str) -> bool:
    """1 to 79 printable Latin-1 characters, no space at an end or beside another."""
    return bool(re.fullmatch(r"[\x20-\x7e\xa1-\xff]{1,79}", word)) and not re.search(r"^ | $|  ", word)


def text_chunk(keyword: str, text: str) -> tuple[bytes, bytes]:
    """tEXt for Latin-1, else iTXt."""
    word = keyword.encode("latin-1", "replace")
    try:
        if "\0" not in text:
            return b"tEXt", word + b"\0" + text.encode("latin-1")
    except UnicodeEncodeError:
        pass
    return b"iTXt", word + b"\0\0\0\0\0" + text.encode("utf-8", "replace")


def read_text(kind: bytes, data: bytes, most: float = 16 << 20) -> tuple[str, str] | None:
    """(keyword, text) of a tEXt, zTXt or iTXt chunk; None where it cannot be read."""
    word, found, rest = data.partition(b"\0")
    if not found or not 1 <= len(word) <= 79:
        return None
    try:
        if kind == b"tEXt":
            return latin(word), latin(rest)
        if kind == b"zTXt":
            return latin(word), latin(bounded(rest[1:], most))
        language, found, more = rest[2:].partition(b"\0")
        _, found_too, body = more.partition(b"\0")
        if not found or not found_too:
            return None
        return latin(word), (bounded(body, most) if rest[:1] == b"\1" else body).decode("utf-8-sig", "replace")
    except ImageError as e:
        if e.code == "LIMIT":
            raise
        return None


def time_text(data: bytes) -> str:
    """A tIME chunk."""
    return f"{int.from_bytes(data[:2], 'big')}-{data[2]:02}-{data[3]:02} {data[4]:02}:{data[5]:02}:{data[6]:02} UTC"


INTENTS = ("perceptual", "relative colorimetric", "saturation", "absolute colorimetric")


def color_chunk(kind: bytes, data: bytes):
    """What a colour chunk says: the name of an intent, numbers, or how long it is."""
    if kind == b"sRGB" and len(data) == 1:
        return INTENTS[data[0]] if data[0] < len(INTENTS) else data[0]
    if kind in (b"gAMA", b"cHRM") and len(data) in (4, 32):
        values = [int.from_bytes(data[k : k + 4], "big") / 100000 for k in range(0, len(data), 4)]
        return values[0] if kind == b"gAMA" else values
    if kind == b"cICP" and len(data) == 4:
        return {"primaries": data[0], "transfer": data[1], "matrix": data[2], "full_range": bool(data[3])}
    return {"bytes": len(data)}


# What APPn segments begin with, and what they are.
APP_NAMES = ((b"JFXX\0", "JFXX thumbnail"), (b"MPF\0", "MPF"), (b"FPXR\0", "FlashPix"), (b"JP", "JUMBF"), (b"Ducky", "Ducky"), (b"Photoshop 3.0\0", "Photoshop"), (b"Exif\0", "EXIF (another copy)"), (b"http", "XMP (another copy)"))


def app_label(marker: int, body: bytes) -> str:
    name = next((n for begin, n in APP_NAMES if body.startswith(begin)), "")
    return f"APP{marker - 0xE0} {name}".rstrip()


def header_json(value) -> str:
    """JSON for a header: characters beyond ASCII as escapes."""
    import json

    return json.dumps(value, ensure_ascii=True, separators=(",", ":"))
