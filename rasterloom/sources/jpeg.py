"""JPEG files as segments and coefficients: Huffman coding both ways, keyed moves of whole MCUs.

Coefficients are whole numbers and stay what they are, so scrambling and restoring lose nothing. A
component holds them as an array (block rows, block columns, 64) in natural order. Decoding is serial by
nature and looks up 16 bits at a time, of which a table tells the code, its run and its value at once.
Coding is done for all coefficients of a scan together, in arrays.
"""

from __future__ import annotations

import heapq
import struct
from array import array
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np

from rasterloom.functions.errors import ImageError, wrong_key
from rasterloom.functions.keys import mcu_layout
from rasterloom.functions.limits import DEFAULTS, Limits
from rasterloom.functions.params import ENLARGED, STASHED, Params, inverse_transform, marker, params, read_marker, same_check

# Fixed values of the format: markers, and the zigzag order (natural index of each place).
SOF0, SOF1, SOF2, DHT, RST0, EOI, SOS, DQT, DNL, DRI, APP0, APP15, COM = 0xC0, 0xC1, 0xC2, 0xC4, 0xD0, 0xD9, 0xDA, 0xDB, 0xDC, 0xDD, 0xE0, 0xEF, 0xFE
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: What this package's own APP15 segments begin with: marker, carried watermark, covered coefficients, original size.
SIGNATURE, WATERMARK, STASH, SIZE = b"rasterloom\0", b"rasterloom-wm\0", b"rasterloom-ws\0", b"rasterloom-sz\0"
OWN = (SIGNATURE, WATERMARK, STASH, SIZE)
STASH_PART = 65533 - len(STASH) - 2
CODING = {DHT, DRI, SOS, DNL}


def bad(message: str) -> ImageError:
    return ImageError("BAD_JPEG", message)


def is_jpeg(data: bytes) -> bool:
    return data[:3] == b"\xff\xd8\xff"


def is_sof(marker: int) -> bool:
    return 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC)


def is_app(marker: int) -> bool:
    return 0xE0 <= marker <= 0xEF


@dataclass(frozen=True)
class Segment:
    marker: int
    body: bytes
    coded: bytes = b""  # entropy-coded bytes that follow, of a scan's head


@dataclass(frozen=True)
class Component:
    id: int
    h: int
    v: int
    tq: int
    real_w: int
    real_h: int
    coefs: np.ndarray  # (block rows, block columns, 64), whole MCUs


@dataclass(frozen=True)
class Frame:
    sof: int
    body: bytes
    width: int
    height: int
    components: tuple[Component, ...]
    hmax: int
    vmax: int
    mcus_x: int
    mcus_y: int
    damaged: bool = False


def scan_end(data: bytes, at: int) -> int:
    """Where entropy-coded bytes that begin at `at` end: at the next marker that is no restart."""
    while 0 <= (at := data.find(b"\xff", at)) < len(data) - 1:
        if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2
    return len(data)


def parsed(data: bytes, limits: Limits = DEFAULTS) -> tuple[list[Segment], bytes]:
    """(segments, what follows the end of the image). Bytes between segments are passed over, and a missing end too."""
    if data[:2] != b"\xff\xd8":
        raise ImageError("UNSUPPORTED_FORMAT", "not a JPEG file")
    out: list[Segment] = []
    at = 2
    while 0 <= (at := data.find(b"\xff", at)) < len(data) - 1:
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        at += 2
        if kind == EOI:
            return out, data[at:]
        if kind in (0x00, 0x01) or 0xD0 <= kind <= 0xD8:
            continue
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            if any(s.marker == SOS for s in out):
                break  # cut after image data: what is there is used
            raise ImageError("CORRUPT", f"segment {kind:#x} is cut")
        body, at, coded = data[at + 2 : at + size], at + size, b""
        if kind == SOS:
            end = scan_end(data, at)
            coded, at = data[at:end], end
        out.append(Segment(kind, body, coded))
        limits.chunks(len(out), "segments")
    return out, b""


def written(segments: list[Segment], trailing: bytes = b"") -> bytes:
    out = [b"\xff\xd8"]
    for s in segments:
        if len(s.body) > 65533:
            raise bad(f"segment {s.marker:#x} is too long")
        out += [bytes([0xFF, s.marker]), (len(s.body) + 2).to_bytes(2, "big"), s.body, s.coded]
    return b"".join(out) + b"\xff\xd9" + trailing


# ---- tables


def quant_tables(body: bytes) -> list[tuple[int, int, bytes]]:
    """(precision, id, bytes of the table) of a DQT segment."""
    out, at = [], 0
    while at < len(body):
        precision, number = body[at] >> 4, body[at] & 15
        size = 64 * (precision + 1)
        if precision > 1 or number > 3 or at + 1 + size > len(body):
            raise bad("a quantisation table is damaged")
        out.append((precision, number, body[at + 1 : at + 1 + size]))
        at += 1 + size
    return out


def quant_values(precision: int, data: bytes) -> np.ndarray:
    """A table in natural order."""
    out = np.empty(64, np.int64)
    out[ZIGZAG] = np.frombuffer(data, ">u2" if precision else "u1")
    return out


def huffman_specs(body: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """(class, id, counts by length, symbols) of a DHT segment."""
    out, at = [], 0
    while at < len(body):
        kind, number, counts = body[at] >> 4, body[at] & 15, body[at + 1 : at + 17]
        n = sum(counts)
        if kind > 1 or number > 3 or len(counts) < 16 or n > 256 or at + 17 + n > len(body):
            raise bad("a Huffman table is damaged")
        out.append((kind, number, counts, body[at + 17 : at + 17 + n]))
        at += 17 + n
    return out


def codes_of(counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) of each symbol in order: codes count up, doubled where they get longer."""
    lengths = np.repeat(np.arange(1, 17), list(counts))
    steps = 1 << (16 - lengths)
    ends = np.cumsum(steps)
    if len(ends) and ends[-1] > 1 << 16:
        raise bad("a Huffman table has too many codes")
    return (ends - steps) >> (16 - lengths), lengths


@lru_cache(maxsize=16)
def look_up(counts: bytes, symbols: bytes) -> array:
    """By 16 bits: symbol << 5 | length of the code that they begin with, 0 where there is none."""
    out = np.zeros(1 << 16, np.int64)
    _, lengths = codes_of(counts)
    filled = np.repeat(np.frombuffer(symbols, np.uint8).astype(np.int64) << 5 | lengths, 1 << (16 - lengths))
    out[: len(filled)] = filled
    return array("q", out.tobytes())


@lru_cache(maxsize=16)
def look_up_values(counts: bytes, symbols: bytes) -> array:
    """By 16 bits, of a code of run and size with the bits of its value: value << 16 | places to go ahead << 8 |
    all bits. An end of block goes 64 ahead. Bit 7 is set where value bits are not within the 16, and all is 0
    where there is no code."""
    table = np.frombuffer(look_up(counts, symbols), np.int64)
    window, length, symbol = np.arange(1 << 16), table & 31, table >> 5
    run, size = symbol >> 4, symbol & 15
    fits = length + size <= 16
    bits = window >> np.maximum(16 - length - size, 0) & (1 << size) - 1
    value = np.where(size == 0, 0, np.where(bits >> np.maximum(size - 1, 0), bits, bits - (1 << size) + 1))
    run = np.where((size == 0) & (run < 15), 64, run)
    out = np.where(fits, value << 16 | run << 8 | length + size, run << 8 | 1 << 7 | length)
    return array("q", np.where(length == 0, 0, out).tobytes())


# ---- decoding


class Bits:
    """Bits of one stretch between restarts; past its end there are zeros."""

    def __init__(self, coded: bytes):
        data = np.frombuffer(coded.replace(b"\xff\x00", b"\xff") + bytes(8), np.uint8).astype(np.uint32)
        self.end = 8 * (len(data) - 8)
        self.window = array("I")
        self.window.frombytes((data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]).astype(np.uint32).tobytes())
        self.at = 0

    def peek(self) -> int:
        """The next 16 bits."""
        at = self.at
        if at >= self.end + 32:
            raise EOFError
        return self.window[at >> 3] >> 16 - (at & 7) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek() >> 16 - n
        self.at += n
        return out

    def symbol(self, table: array) -> int:
        found = table[self.peek()]
        if not found:
            raise bad("no such Huffman code")
        self.at += found & 31
        return found >> 5

    def signed(self, size: int) -> int:
        if size > 16:
            raise bad("a value of too many bits")
        bits = self.take(size)
        return bits if not size or bits >> size - 1 else bits - (1 << size) + 1


def geometry(segment: Segment, limits: Limits = DEFAULTS) -> Frame:
    """The frame that a SOF segment describes, its coefficients zero."""
    kind, body = segment.marker, segment.body
    if kind not in (SOF0, SOF1, SOF2):
        raise ImageError("UNSUPPORTED", f"JPEG of coding process {kind - 0xC0}")
    if len(body) < 6 or len(body) < 6 + 3 * body[5]:
        raise bad("the frame header is cut")
    precision, height, width, n = struct.unpack_from(">BHHB", body)
    if precision != 8:
        raise ImageError("UNSUPPORTED", f"JPEG of {precision} bits a sample")
    if not width or not height:
        raise ImageError("UNSUPPORTED" if width else "BAD_JPEG", "the frame has no size")
    if not 1 <= n <= 4:
        raise ImageError("UNSUPPORTED", f"JPEG of {n} components")
    limits.pixels(width, height)
    heads = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
    if any(not 1 <= h <= 4 or not 1 <= v <= 4 or tq > 3 for _, h, v, tq in heads) or len({h[0] for h in heads}) < n:
        raise bad("the frame header holds values outside the format")
    if n == 1:  # one component is never interleaved: its factors say nothing
        heads = [(heads[0][0], 1, 1, heads[0][3])]
    hmax, vmax = max(h for _, h, _, _ in heads), max(v for _, _, v, _ in heads)
    mcus_x, mcus_y = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    real = lambda size, f, most: -(-(-(-size * f // most)) // 8)
    components = tuple(Component(i, h, v, tq, real(width, h, hmax), real(height, v, vmax), np.zeros((mcus_y * v, mcus_x * h, 64), np.int16)) for i, h, v, tq in heads)
    return Frame(kind, body, width, height, components, hmax, vmax, mcus_x, mcus_y)


def walk(frame: Frame, chosen: list[int]) -> list[tuple[int, np.ndarray]]:
    """(component, places) in the order of a scan: places are the first coefficients of its blocks, a row for each MCU."""
    out = []
    for i in chosen:
        c = frame.components[i]
        blocks_w = c.coefs.shape[1]
        if len(chosen) == 1:
            out.append((i, (np.arange(c.real_h)[:, None] * blocks_w + np.arange(c.real_w)).reshape(-1, 1) * 64))
        else:
            rows = np.arange(frame.mcus_y)[:, None, None, None] * c.v + np.arange(c.v)[:, None]
            cols = np.arange(frame.mcus_x)[:, None, None] * c.h + np.arange(c.h)
            out.append((i, (rows * blocks_w + cols).reshape(frame.mcus_x * frame.mcus_y, -1) * 64))
    return out


def frame_of(segments: list[Segment], limits: Limits = DEFAULTS) -> Frame:
    """The coefficients of a file's image. What is cut or damaged after the first scan's head stays zero."""
    frame, tables, interval, damaged, scans = None, {}, 0, False, 0
    coefs: list[array] = []
    for s in segments:
        if is_sof(s.marker):
            if frame is not None:
                raise bad("two frames")
            frame = geometry(s, limits)
            coefs = [array("h", bytes(2 * c.coefs.size)) for c in frame.components]
        elif s.marker == DHT:
            tables.update({(kind, number): (counts, symbols) for kind, number, counts, symbols in huffman_specs(s.body)})
        elif s.marker == DRI:
            interval = int.from_bytes(s.body[:2], "big")
        elif s.marker == SOS:
            if frame is None:
                raise bad("a scan before the frame")
            scans += 1
            limits.scans(scans)
            damaged |= not scan(frame, coefs, s, tables, interval)
    if frame is None or not scans:
        raise bad("no image data")
    parts = tuple(replace(c, coefs=np.frombuffer(x, np.int16).reshape(c.coefs.shape)) for c, x in zip(frame.components, coefs))
    return replace(frame, components=parts, damaged=damaged)


def scan(frame: Frame, coefs: list[array], segment: Segment, tables: dict, interval: int) -> bool:
    """Adds a scan to coefs; whether it was whole."""
    body = segment.body
    n = body[0] if body else 0
    if not 1 <= n <= 4 or len(body) < 4 + 2 * n:
        raise bad("a scan's head is damaged")
    ids = [c.id for c in frame.components]
    if any(body[1 + 2 * k] not in ids for k in range(n)):
        raise bad("a scan of an unknown component")
    chosen = [ids.index(body[1 + 2 * k]) for k in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    progressive = frame.sof == SOF2
    if not progressive:
        first, last, high, low = 0, 63, 0, 0
    if first > last or last > 63 or low > 13 or (first and n > 1) or (progressive and not first and last):
        raise bad("a scan's head holds values outside the format")
    dc_needed, ac_needed = not first and not high, last > 0
    need = lambda kind, number: tables.get((kind, number)) or (_ for _ in ()).throw(bad("a Huffman table is missing"))
    dc = [look_up(*need(0, body[2 + 2 * k] >> 4)) if dc_needed else None for k in range(n)]
    spec = [need(1, body[2 + 2 * k] & 15) if ac_needed else None for k in range(n)]
    steps = walk(frame, chosen)
    units = len(steps[0][1])
    stretches = split_restarts(segment.coded)
    whole, every = True, interval or units
    zigzag = ZIGZAG.tolist()
    for number, coded in enumerate(stretches):
        at = number * every
        if at >= units:
            break
        part = [(k, coefs[i], places[at : at + every]) for k, (i, places) in enumerate(steps)]
        bits = Bits(coded)
        try:
            if not progressive:
                sequential(bits, part, dc, [look_up_values(*x) for x in spec], [look_up(*x) for x in spec], zigzag)
            elif not first:
                dc_scan(bits, part, dc, high, low)
            elif not high:
                ac_scan(bits, part[0], look_up(*spec[0]), first, last, low, zigzag)
            else:
                ac_refined(bits, part[0], look_up(*spec[0]), first, last, low, zigzag)
        except (EOFError, ImageError, IndexError, OverflowError):
            whole = False  # the rest of the stretch stays as it is
    return whole and len(stretches) * every >= units


def split_restarts(coded: bytes) -> list[bytes]:
    out, begin, at = [], 0, 0
    while 0 <= (at := coded.find(b"\xff", at)) < len(coded) - 1:
        if 0xD0 <= coded[at + 1] <= 0xD7:
            out.append(coded[begin:at])
            begin = at + 2
        at += 2
    return [*out, coded[begin:]]


def sequential(bits: Bits, part: list, dc: list, ac: list, plain: list, zigzag: list[int]) -> None:
    before = [0] * len(part)
    window, end = bits.window, bits.end
    rows = [p[2].tolist() for p in part]
    for unit in range(len(rows[0])):
        for k, (slot, out, _) in enumerate(part):
            for place in rows[k][unit]:
                before[k] += bits.signed(bits.symbol(dc[slot]))
                out[place] = before[k]
                at, z, table = bits.at, 1, ac[slot]
                while z < 64:
                    if at >= end:
                        raise EOFError
                    found = table[window[at >> 3] >> 16 - (at & 7) & 0xFFFF]
                    if found & 0x80:  # value bits reach past the window
                        bits.at = at
                        symbol = bits.symbol(plain[slot])
                        z += symbol >> 4
                        if z > 63:
                            raise bad("a run past the block")
                        out[place + zigzag[z]] = bits.signed(symbol & 15)
                        at = bits.at
                    else:
                        if not found:
                            raise bad("no such Huffman code")
                        at += found & 31
                        z += found >> 8 & 127
                        if z > 63:
                            break
                        if found >> 16:
                            out[place + zigzag[z]] = found >> 16
                    z += 1
                bits.at = at


def dc_scan(bits: Bits, part: list, dc: list, high: int, low: int) -> None:
    before = [0] * len(part)
    rows = [p[2].tolist() for p in part]
    for unit in range(len(rows[0])):
        for k, (slot, out, _) in enumerate(part):
            for place in rows[k][unit]:
                if high:
                    out[place] |= bits.take(1) << low
                else:
                    before[k] += bits.signed(bits.symbol(dc[slot]))
                    out[place] = before[k] << low


def ac_scan(bits: Bits, part: tuple, table: array, first: int, last: int, low: int, zigzag: list[int]) -> None:
    _, out, places = part
    ended = 0
    for place in places[:, 0].tolist():
        if ended:
            ended -= 1
            continue
        z = first
        while z <= last:
            symbol = bits.symbol(table)
            run, size = symbol >> 4, symbol & 15
            if size:
                z += run
                if z > 63:
                    raise bad("a run past the block")
                out[place + zigzag[z]] = bits.signed(size) << low
                z += 1
            elif run == 15:
                z += 16
            else:
                ended = (1 << run) - 1 + bits.take(run)
                break


def ac_refined(bits: Bits, part: tuple, table: array, first: int, last: int, low: int, zigzag: list[int]) -> None:
    _, out, places = part
    ended, step = 0, 1 << low

    def refine(at: int) -> None:
        """One more bit of a coefficient that is known already."""
        if bits.take(1) and not abs(out[at]) & step:
            out[at] += step if out[at] > 0 else -step

    for place in places[:, 0].tolist():
        z = first
        while z <= last and not ended:
            symbol = bits.symbol(table)
            run, size, value = symbol >> 4, symbol & 15, 0
            if size:
                value = step if bits.take(1) else -step
            elif run < 15:
                ended = (1 << run) + bits.take(run)
                break
            while z <= last:  # over `run` zeros, and over what is known, which gets its bit
                at = place + zigzag[z]
                z += 1
                if out[at]:
                    refine(at)
                elif run:
                    run -= 1
                else:
                    if value:
                        out[at] = value
                    break
        if ended:
            while z <= last:
                if out[place + zigzag[z]]:
                    refine(place + zigzag[z])
                z += 1
            ended -= 1


# ---- coding


def bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(x).astype(np.float64))[1].astype(np.int64)


@dataclass
class Symbols:
    """Symbols of a scan in order: place (to sort by), table, symbol, more bits and how many."""

    parts: list

    def add(self, place, table, symbol, value, size) -> None:
        n = len(place)
        self.parts.append([np.broadcast_to(np.asarray(x, np.int64), n) for x in (place, table, symbol, np.where(np.asarray(value) < 0, value + (1 << np.asarray(size)) - 1, value), size)])

    def ordered(self) -> list[np.ndarray]:
        rows = [np.concatenate(x) for x in zip(*self.parts)] if self.parts else [np.zeros(0, np.int64)] * 5
        by = np.argsort(rows[0], kind="stable")
        return [x[by] for x in rows]


def dc_symbols(out: Symbols, frame: Frame, chosen: list[int], interval: int, tables: list[int], width: int) -> None:
    """DC symbols; a place is block number * width."""
    steps = walk(frame, chosen)
    per_unit = sum(p.shape[1] for _, p in steps)
    ahead = 0
    for (i, places), table in zip(steps, tables):
        n = places.shape[1]
        values = frame.components[i].coefs.reshape(-1)[places.ravel()].astype(np.int64)
        before = np.r_[0, values[:-1]]
        if interval:
            before[np.arange(0, len(values), interval * n)] = 0
        diff = values - before
        number = (np.arange(len(places))[:, None] * per_unit + ahead + np.arange(n)).ravel()
        size = bit_lengths(diff)
        out.add(number * width, table, size, diff, size)
        ahead += n


def nonzero_symbols(out: Symbols, table: int, block: np.ndarray, z: np.ndarray, value: np.ndarray, first: int, width: int) -> None:
    """Symbols of nonzero coefficients, sorted by block and place z: zeros before them in sixteens, then run and size."""
    same = np.r_[False, block[1:] == block[:-1]]
    run = z - np.where(same, np.r_[0, z[:-1]], first - 1) - 1
    size = bit_lengths(value)
    place = block * width + 4 * z
    long = np.flatnonzero(run > 15)
    times = run[long] // 16
    out.add(np.repeat(place[long] - 1, times), table, 0xF0, 0, 0)
    out.add(place, table, run % 16 << 4 | size, value, size)


def sequential_symbols(frame: Frame, chosen: list[int], interval: int = 0) -> list[np.ndarray]:
    """(place, table, symbol, bits, size) of a baseline scan; tables 0, 1 are for DC, 2, 3 for AC, 1 and 3 beyond the first component."""
    out, width = Symbols([]), 4 * 66
    which = [min(1, i) for i in chosen]
    dc_symbols(out, frame, chosen, interval, which, width)
    steps = walk(frame, chosen)
    per_unit, ahead = sum(p.shape[1] for _, p in steps), 0
    for (i, places), table in zip(steps, which):
        n = places.shape[1]
        number = (np.arange(len(places))[:, None] * per_unit + ahead + np.arange(n)).ravel()
        zig = frame.components[i].coefs.reshape(-1, 64)[places.ravel() // 64][:, ZIGZAG]
        row, z = np.nonzero(zig[:, 1:])
        nonzero_symbols(out, 2 + table, number[row], z + 1, zig[row, z + 1].astype(np.int64), 1, width)
        end = number[zig[:, 63] == 0]
        out.add(end * width + 4 * 64, 2 + table, 0, 0, 0)
        ahead += n
    return out.ordered()


def band_symbols(frame: Frame, i: int, first: int, last: int) -> list[np.ndarray]:
    """As above, of a progressive scan of one component's band; all in table 2."""
    out, width = Symbols([]), 4 * 66
    [(_, places)] = walk(frame, [i])
    zig = frame.components[i].coefs.reshape(-1, 64)[places.ravel() // 64][:, ZIGZAG[first : last + 1]]
    row, z = np.nonzero(zig)
    nonzero_symbols(out, 2, row, z + first, zig[row, z].astype(np.int64), first, width)
    # blocks up to the next one with a nonzero coefficient end in one run
    some, open_end = zig.any(1), zig[:, -1] == 0
    group = np.cumsum(some)
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.add.reduceat(open_end.astype(np.int64), begin) if len(begin) else begin
    for most, take in ((0x7FFF, ends // 0x7FFF), (0, np.where(ends % 0x7FFF, 1, 0))):
        at = np.repeat(begin, take)
        run = np.full(len(at), most) if most else (ends % 0x7FFF)[take > 0]
        size = bit_lengths(run) - 1
        out.add(at * width + 4 * 64 + (not most), 2, size << 4, run - (1 << size), size)
    return out.ordered()


def optimal_spec(counts: np.ndarray) -> tuple[bytes, bytes]:
    """(codes by length, symbols) of least length for these counts, of at most 16 bits and none of ones alone."""
    used = [(int(n), s) for s, n in enumerate(counts) if n]
    used.append((0, 256))  # takes the code of ones alone
    groups = [(n, -s, [s]) for n, s in used]
    depth = dict.fromkeys((s for _, s in used), 0)
    heapq.heapify(groups)
    while len(groups) > 1:
        a, b = heapq.heappop(groups), heapq.heappop(groups)
        for s in (*a[2], *b[2]):
            depth[s] += 1
        heapq.heappush(groups, (a[0] + b[0], max(a[1], b[1]), a[2] + b[2]))
    lengths = [0] * (max([*depth.values(), 17]) + 1)
    for n in depth.values():
        lengths[n] += 1
    for n in range(len(lengths) - 1, 16, -1):  # two of the longest go up: one to its parent, one beside a shorter leaf
        while lengths[n]:
            k = n - 2
            while not lengths[k]:
                k -= 1
            lengths[n] -= 2
            lengths[n - 1] += 1
            lengths[k + 1] += 2
            lengths[k] -= 1
    longest = max(i for i in range(1, 17) if lengths[i])
    lengths[longest] -= 1  # the reserved code
    symbols = sorted((s for s in depth if s != 256), key=lambda s: (depth[s], s))
    return bytes(lengths[1:17]), bytes(symbols)


def coded(rows: list[np.ndarray], specs: dict[int, tuple[bytes, bytes]]) -> bytes:
    """Symbols and their bits as stuffed bytes, the last filled with ones."""
    _, table, symbol, value, size = rows
    code, length = np.zeros((4, 256), np.int64), np.zeros((4, 256), np.int64)
    for number, (counts, symbols) in specs.items():
        own = np.frombuffer(symbols, np.uint8)
        code[number, own], length[number, own] = codes_of(counts)
    n = length[table, symbol] + size
    word = code[table, symbol] << size | value
    at = np.cumsum(n) - n
    total = int(n.sum())
    pad = -total % 8
    out = np.zeros(total // 8 + 6)
    shifted = word << (40 - n - (at & 7))
    for k in range(5):  # no two put a one at the same place, so sums are unions
        out += np.bincount((at >> 3) + k, shifted >> (32 - 8 * k) & 255, minlength=len(out))[: len(out)]
    data = out[: (total + pad) // 8].astype(np.uint8)
    if pad:
        data[-1] |= (1 << pad) - 1
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def coded_scan(frame: Frame, chosen: list[int], rows: list[np.ndarray], band: tuple[int, int], interval: int = 0) -> list[Segment]:
    """DHT and SOS segments of a scan's symbols."""
    tables = np.unique(rows[1]).tolist()
    specs = {t: optimal_spec(np.bincount(rows[2][rows[1] == t], minlength=256)) for t in tables}
    dht = b"".join(bytes([(t >> 1) << 4 | t & 1]) + counts + symbols for t, (counts, symbols) in specs.items())
    head = bytes([len(chosen)]) + b"".join(bytes([frame.components[i].id, 0x11 * min(1, i) if band[1] == 63 and not band[0] else (min(1, i) << 4 if not band[0] else 0)]) for i in chosen) + bytes([*band, 0])
    if interval:
        per_unit = sum(p.shape[1] for _, p in walk(frame, chosen))
        number = rows[0] // (4 * 66) // (per_unit * interval)
        cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        parts = [coded([x[a:b] for x in rows], specs) for a, b in zip(cuts, [*cuts[1:], len(number)])]
        data = b"".join(p + (bytes([0xFF, RST0 + k % 8]) if k < len(parts) - 1 else b"") for k, p in enumerate(parts))
    else:
        data = coded(rows, specs)
    return [Segment(DHT, dht), Segment(SOS, head, data)]


def interleavable(frame: Frame) -> bool:
    """Whether an MCU has at most the ten blocks that one scan may have of it."""
    return len(frame.components) == 1 or sum(c.h * c.v for c in frame.components) <= 10


def has_padding(frame: Frame) -> bool:
    return any(c.real_w < c.coefs.shape[1] or c.real_h < c.coefs.shape[0] for c in frame.components)


def scans_of(frame: Frame, progressive: bool, interval: int = 0) -> list[Segment]:
    every = list(range(len(frame.components)))
    together = [every] if interleavable(frame) else [[i] for i in every]
    out: list[Segment] = []
    if not progressive:
        if interval:
            out.append(Segment(DRI, interval.to_bytes(2, "big")))
        for chosen in together:
            out += coded_scan(frame, chosen, sequential_symbols(frame, chosen, interval), (0, 63), interval)
        return out
    for chosen in together:
        dc = Symbols([])
        dc_symbols(dc, frame, chosen, 0, [min(1, i) for i in chosen], 4 * 66)
        out += coded_scan(frame, chosen, dc.ordered(), (0, 0))
    bands = [(0, 1, 5), *((i, 1, 63) for i in every[1:]), (0, 6, 63)]
    for i, first, last in bands:
        out += coded_scan(frame, [i], band_symbols(frame, i, first, last), (first, last))
    return out


def assembled(head: list[Segment], frame: Frame, own: list[bytes] = (), progressive: bool = False, interval: int = 0) -> bytes:
    """A file of the segments kept, own APP15 segments after the first APPn ones, and the frame."""
    at = next((k for k, s in enumerate(head) if not is_app(s.marker)), len(head))
    segments = [*head[:at], *(Segment(APP15, body) for body in own), *head[at:]]
    wide = any(p for s in head if s.marker == DQT for p, _, _ in quant_tables(s.body))
    segments.append(Segment(SOF2 if progressive else SOF1 if wide else SOF0, frame.body))
    return written([*segments, *scans_of(frame, progressive, interval)])


# ---- scrambling


def own_part(segments: list[Segment], signature: bytes) -> bytes | None:
    return next((s.body[len(signature) :] for s in segments if s.marker == APP15 and s.body.startswith(signature)), None)


def kept(segments: list[Segment]) -> list[Segment]:
    """What goes into a file again as it is: neither coding segments nor own ones."""
    return [s for s in segments if s.marker not in CODING and not is_sof(s.marker) and not (s.marker == APP15 and s.body.startswith(OWN))]


def one_table_each(segments: list[Segment], frame: Frame) -> tuple[list[Segment], Frame]:
    """Where a quantisation table is defined again, each component gets the one that held at its first scan, under a free id."""
    seen: dict[int, tuple[int, bytes]] = {}
    used: dict[int, tuple[int, bytes]] = {}
    again = False
    for s in segments:
        if s.marker == DQT:
            for precision, number, data in quant_tables(s.body):
                again |= number in seen and seen[number] != (precision, data)
                seen[number] = (precision, data)
        elif s.marker == SOS:
            for k in range(s.body[0]):
                i = next(i for i, c in enumerate(frame.components) if c.id == s.body[1 + 2 * k])
                if i not in used and frame.components[i].tq in seen:
                    used[i] = seen[frame.components[i].tq]
    if not again:
        return segments, frame
    tables = list(dict.fromkeys(used.values()))
    if len(tables) > 4:
        raise ImageError("UNSUPPORTED", "more than four quantisation tables")
    body = bytearray(frame.body)
    parts = []
    for i, c in enumerate(frame.components):
        number = tables.index(used[i]) if i in used else c.tq
        body[8 + 3 * i] = number
        parts.append(replace(c, tq=number))
    merged = Segment(DQT, b"".join(bytes([p << 4 | k]) + data for k, (p, data) in enumerate(tables)))
    at = next(k for k, s in enumerate(segments) if s.marker == DQT)
    rest = [s for s in segments[at:] if s.marker != DQT]
    return [*segments[:at], merged, *rest], replace(frame, body=bytes(body), components=tuple(parts))


def read(data: bytes, limits: Limits = DEFAULTS) -> tuple[list[Segment], Frame, bytes]:
    segments, trailing = parsed(data, limits)
    return *one_table_each(segments, frame_of(segments, limits)), trailing


def transform_count(frame: Frame) -> int:
    return 8 if all(c.h == c.v for c in frame.components) else 4


def turned(units: np.ndarray, code: int) -> np.ndarray:
    """Units (n, v, h, 8, 8) under a transform: blocks change places, and odd frequencies of a flipped axis their sign."""
    if code & 4:
        units = units.transpose(0, 2, 1, 4, 3)
    if code & 1:
        units = units[:, :, ::-1] * np.array([1, -1] * 4, np.int16)
    if code & 2:
        units = units[:, ::-1] * np.array([1, -1] * 4, np.int16)[:, None]
    return units


def moved(frame: Frame, perm: np.ndarray, codes: np.ndarray, back: bool) -> Frame:
    """The frame with its MCUs in other places: slot s shows unit perm[s] under codes[s], or that undone."""
    parts = []
    for c in frame.components:
        grid = c.coefs.reshape(frame.mcus_y, c.v, frame.mcus_x, c.h, 8, 8).transpose(0, 2, 1, 3, 4, 5).reshape(-1, c.v, c.h, 8, 8)
        out = np.empty_like(grid)
        for code in np.unique(codes).tolist():
            slot = np.flatnonzero(codes == code)
            if back:
                out[perm[slot]] = turned(grid[slot], inverse_transform(code))
            else:
                out[slot] = turned(grid[perm[slot]], code)
        out = out.reshape(frame.mcus_y, frame.mcus_x, c.v, c.h, 64).transpose(0, 2, 1, 3, 4)
        parts.append(replace(c, coefs=np.ascontiguousarray(out).reshape(c.coefs.shape)))
    return replace(frame, components=tuple(parts))


def layout_of(frame: Frame, key: bytes, p: Params, check: bytes | None = None) -> tuple[np.ndarray, np.ndarray, bytes]:
    got = mcu_layout(key, p.salt, p.block, frame.mcus_x, frame.mcus_y, transform_count(frame) if p.transforms else 1)
    if check is not None and not same_check(got[2], check):
        raise wrong_key()
    return got


def resized(frame: Frame, width: int, height: int) -> Frame:
    """The frame under another size of the same MCUs."""
    body = frame.body[:1] + struct.pack(">HH", height, width) + frame.body[5:]
    real = lambda size, f, most: -(-(-(-size * f // most)) // 8)
    parts = tuple(replace(c, real_w=real(width, c.h, frame.hmax), real_h=real(height, c.v, frame.vmax)) for c in frame.components)
    return replace(frame, body=body, width=width, height=height, components=parts)


def stash_segments(stash: bytes) -> list[bytes]:
    parts = [stash[k : k + STASH_PART] for k in range(0, len(stash), STASH_PART)]
    if len(parts) > 255:
        raise ImageError("BAD_WATERMARK", "the visible watermark is too large for a JPEG")
    return [STASH + bytes([k + 1, len(parts)]) + p for k, p in enumerate(parts)]


def stash_of(segments: list[Segment]) -> bytes:
    """The numbered parts put together again."""
    parts = [s.body[len(STASH) :] for s in segments if s.marker == APP15 and s.body.startswith(STASH)]
    if not parts or any(len(p) < 2 or p[0] != k + 1 or p[1] != len(parts) for k, p in enumerate(parts)):
        raise bad("the coefficients under the visible watermark are lost")
    return b"".join(p[2:] for p in parts)


def orientation_of(segments: list[Segment]) -> int:
    from rasterloom.sources import exif

    block = next((s.body[6:] for s in segments if s.marker == 0xE1 and s.body.startswith(b"Exif\0\0")), None)
    return exif.quick_orientation(block) if block else 1


def file_of(segments: list[Segment], frame: Frame, key: bytes, p: Params, check: bytes, progressive: bool, watermark=None, visible=None) -> bytes:
    """A scrambled frame as a file. One whose MCUs can be neither interleaved nor cut at the edge is written at the size of whole MCUs."""
    flags, own = 0, []
    if watermark is not None:
        from rasterloom.watermark.carried import encoded

        own.append(WATERMARK + encoded(watermark))
    if visible is not None:
        from rasterloom.watermark.paint import stashed_jpeg

        frame, stash = stashed_jpeg(frame, segments, visible, orientation_of(segments), key, p.salt)
        if stash:
            own += stash_segments(stash)
            flags |= STASHED
    if not interleavable(frame) and has_padding(frame):
        width, height = frame.mcus_x * 8 * frame.hmax, frame.mcus_y * 8 * frame.vmax
        if max(width, height) > 65535:
            raise ImageError("UNSUPPORTED", "the frame enlarged to whole MCUs is too large")
        own.append(SIZE + struct.pack(">HH", frame.height, frame.width))
        frame, flags = resized(frame, width, height), flags | ENLARGED
    p = replace(p, flags=flags)
    return assembled(kept(segments), frame, [SIGNATURE + marker(p, check), *own], progressive and not has_padding(frame))


def scrambled(data: bytes, key: bytes, salt: bytes | None = None, transforms: bool = True, progressive: bool | str = "auto", watermark=None, visible=None, limits: Limits = DEFAULTS) -> bytes:
    segments, frame, _ = read(data, limits)
    if own_part(segments, SIGNATURE) is not None:
        raise ImageError("ALREADY_SCRAMBLED", "the file has a marker")
    again = frame.sof == SOF2 if progressive in ("auto", None) else bool(progressive)
    p = params("mcu", transforms=transforms, progressive=again, salt=salt)
    perm, codes, check = layout_of(frame, key, p)
    return file_of(segments, moved(frame, perm, codes, False), key, p, check, again, watermark, visible)


def without_exif(data: bytes) -> bytes:
    """The file without its EXIF segments, so that no viewer turns the picture."""
    segments, trailing = parsed(data)
    return written([s for s in segments if not (s.marker == 0xE1 and s.body.startswith(b"Exif"))], trailing)


def marker_of(segments: list[Segment]) -> tuple[Params, bytes]:
    body = own_part(segments, SIGNATURE)
    if body is None:
        raise ImageError("NOT_SCRAMBLED", "the file has no marker")
    return read_marker(body)


def plain_frame(segments: list[Segment], frame: Frame, key: bytes, limits: Limits = DEFAULTS) -> tuple[Frame, Params, dict | None]:
    """(restored frame, params, the visible watermark that was on it)."""
    p, check = marker_of(segments)
    if p.mode != "mcu":
        raise ImageError("BAD_MARKER", f"mode {p.mode} is not for JPEG")
    if p.flags & ENLARGED:
        size = own_part(segments, SIZE)
        if size is None or len(size) != 4:
            raise bad("the original size is lost")
        height, width = struct.unpack(">HH", size)
        if not width or not height or -(-width // (8 * frame.hmax)) != frame.mcus_x or -(-height // (8 * frame.vmax)) != frame.mcus_y:
            raise bad("the original size does not fit the frame")
        frame = resized(frame, width, height)
    perm, codes, _ = layout_of(frame, key, p, check)
    visible = None
    if p.flags & STASHED:
        from rasterloom.watermark.carried import unstashed_jpeg

        frame, visible = unstashed_jpeg(frame, stash_of(segments), key, p.salt, limits)
    return moved(frame, perm, codes, True), p, visible


def restored(data: bytes, key: bytes, progressive: bool | str = "auto", paint: dict | None = None, limits: Limits = DEFAULTS) -> bytes:
    segments, frame, _ = read(data, limits)
    plain, p, _ = plain_frame(segments, frame, key, limits)
    again = p.progressive if progressive in ("auto", None) else bool(progressive)
    if paint is not None:
        from rasterloom.watermark.paint import painted_jpeg

        plain = painted_jpeg(plain, kept(segments), paint, orientation_of(segments), limits)
    return assembled(kept(segments), plain, progressive=again)


def rekeyed(data: bytes, old: bytes, new: bytes, salt: bytes | None = None, transforms: bool | None = None, progressive: bool | str = "auto", limits: Limits = DEFAULTS) -> bytes:
    """Under a new key, with the transforms, structure and watermarks that it had unless they are given."""
    segments, frame, _ = read(data, limits)
    plain, p, visible = plain_frame(segments, frame, old, limits)
    again = p.progressive if progressive in ("auto", None) else bool(progressive)
    q = params("mcu", transforms=p.transforms if transforms is None else transforms, progressive=again, salt=salt)
    perm, codes, check = layout_of(plain, new, q)
    from rasterloom.watermark.carried import carried

    return file_of(segments, moved(plain, perm, codes, False), new, q, check, again, carried(own_part(segments, WATERMARK)), visible)


def rebuilt(data: bytes, limits: Limits = DEFAULTS) -> bytes:
    """The same image as a clean baseline file: own tables, no stray bytes, what was cut as zeros."""
    segments, frame, _ = read(data, limits)
    return assembled(kept(segments), frame)


def info(data: bytes, limits: Limits = DEFAULTS) -> dict:
    """What the segments tell, without entropy decoding."""
    segments, trailing = parsed(data, limits)
    limits.scans(sum(s.marker == SOS for s in segments))
    sof = next((s for s in segments if is_sof(s.marker)), None)
    if sof is None or len(sof.body) < 6:
        raise bad("no frame")
    height, width = struct.unpack_from(">HH", sof.body, 1)
    limits.pixels(width, height)
    n = sof.body[5]
    factors = [sof.body[7 + 3 * i] for i in range(n) if 7 + 3 * i < len(sof.body)]
    hmax, vmax = (max(f >> 4 for f in factors), max(f & 15 for f in factors)) if n > 1 and factors else (1, 1)
    body = own_part(segments, SIGNATURE)
    p = read_marker(body)[0] if body is not None else None
    out = {"width": width, "height": height, "depth": sof.body[0], "components": n, "progressive": sof.marker == SOF2, "mcu": f"{8 * hmax}x{8 * vmax}", "frames": 1, "scrambled": p is not None, "mode": p.mode if p else None, "transforms": p.transforms if p else None, "trailing": len(trailing), "orientation": orientation_of(segments)}
    size = own_part(segments, SIZE)
    if p and p.flags & ENLARGED and size is not None and len(size) == 4:
        out |= {"stored_width": width, "stored_height": height, "height": size[0] << 8 | size[1], "width": size[2] << 8 | size[3]}
    return out
