"""Token ids of whole texts by a vocabulary file of the tokenizers library, part by part.

Where a vocabulary drops white space and never looks across it, the ids of a text are the ids of its
parts between spaces, in order. Latin texts are cut in arrays: a batch's parts are told apart by their
bytes, each distinct one is looked up in a bounded table that outlives a task, and those that are new
are merged together. What is not Latin, and any other vocabulary file, goes through the library.
The ids are the library's throughout; tests hold both against each other.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np

from rasterloom.llm.token_counts import byte_symbols

#: Parts in a worker's tables (of Latin texts, of others), the longest part of a Latin text that is kept,
#: and the characters that are cut at a time.
KEPT_LATIN, KEPT_PARTS, KEPT_CHARS, BATCH_CHARS = 500_000, 50_000, 16, 1 << 20
#: Parts that the library gets in one call, and the character that stands between them.
TOGETHER, MARK = 2_000, "\x01"
ID = np.dtype("<u4")
# Fixed value: the split pattern of the vocabularies whose Latin words are encoded without the steps before the model.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space that is a space to the library, too, and the longest part that is merged here.
SPACES, MERGED_CHARS = str.maketrans("\t\n\r", "   "), 256
#: By code point: letter, digit, anything else that a pattern's last piece takes, and what is left to the
#: library: the apostrophe and what begins a special string, white space, controls and all beyond Latin-1.
LETTER, DIGIT, OTHER, LEFT = range(4)
KIND = np.array([LEFT if chr(i) in "'<" or chr(i).isspace() or unicodedata.category(chr(i)) == "Cc" else {"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(i))[0], OTHER) for i in range(256)], np.int8)
LOWER = np.array([ord(chr(i).lower()) for i in range(256)], np.int64)
SPACE = np.isin(np.arange(256), [9, 10, 13, 32])
#: Masks of the first 0 to 8 bytes of a 64-bit number.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
NONE = np.int64(1 << 40)


def parts_are_free(path: str) -> bool:
    """Whether a text's ids are those of its parts between spaces: no special string holds a space,
    white space falls away when the text is cut, and the normalizers work within a part."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
    steps = pre.get("pretokenizers", [pre])
    norms = {n.get("type") for n in norm.get("normalizers", [norm] if norm else [])}
    drops = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and "\\s\\p{L}" in steps[0]["pattern"].get("Regex", "")
    plain = all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    return bool(drops and plain and norms <= {"NFC", "Replace", "Lowercase"})


def is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def latin_is_plain(path: str) -> bool:
    """Whether a Latin part's ids are those that the merges give the lower-case bytes of its pieces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps, model = (spec["pre_tokenizer"] or {}).get("pretokenizers", []), spec["model"]
    norms = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    special = all(t["content"].startswith("<") for t in spec["added_tokens"])
    merges = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
    return special and merges and sorted(norms) == ["Lowercase", "NFC", "Replace"] and len(steps) == 2 and steps[0].get("pattern") == {"Regex": WORDS} and steps[1].get("type") == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]


class LatinMerges:
    """Byte-pair merging of many Latin parts at once: a round merges the first pair of lowest rank of each piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([(vocab[a] << 32) + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        symbols = byte_symbols()
        self.inner, self.final = (np.array([vocab[symbols[b] + x] for b in range(256)], np.int64) for x in ("", end))
        # ranks by a hash table: a key that finds its slot taken goes to the next free one
        self.bits = max(4, (4 * len(key)).bit_length())
        self.key, self.rank = np.full((1 << self.bits) + len(key) + 1, -1, np.int64), np.zeros((1 << self.bits) + len(key) + 1, np.int64)
        left = np.arange(len(key))
        at = self.slot(key)
        while len(left):
            free = self.key[at] < 0
            first = left[free][np.unique(at[free], return_index=True)[1]]
            won = np.isin(left, first)
            self.key[at[won]], self.rank[at[won]] = key[left[won]], left[won]
            left, at = left[~won], at[~won]
            at = at + (self.key[at] >= 0)

    def slot(self, pair: np.ndarray) -> np.ndarray:
        return (pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = (a << 32) + b
        at = self.slot(pair)
        found = self.key[at]
        out = np.where(found == pair, self.rank[at], NONE)
        x = np.flatnonzero((found != pair) & (found >= 0))
        while len(x):
            at[x] += 1
            found = self.key[at[x]]
            hit = found == pair[x]
            out[x[hit]] = self.rank[at[x[hit]]]
            x = x[~hit & (found >= 0)]
        return out

    def merged(self, symbol: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """The ids where they begin, and -1 elsewhere."""
        out, place = np.full(len(symbol), -1, np.int64), np.arange(len(symbol))
        rank = np.full(len(symbol), NONE)
        x = np.flatnonzero(piece[1:] == piece[:-1])
        rank[x] = self.ranks(symbol[x], symbol[x + 1])
        while len(symbol):
            start = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(symbol)]))
            live = least < NONE
            if not live.all():
                out[place[~live]] = symbol[~live]
                symbol, piece, place, rank, least = (v[live] for v in (symbol, piece, place, rank, least))
            hit = np.flatnonzero(rank == least)
            if not len(hit):
                break
            hit = hit[np.r_[True, piece[hit[1:]] != piece[hit[:-1]]]]
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, piece, place, rank = (v[keep] for v in (symbol, piece, place, rank))
            hit -= np.arange(len(hit))
            rank[hit] = NONE
            for x in (hit[hit + 1 < len(symbol)], hit[hit > 0] - 1):
                x = x[piece[x] == piece[x + 1]]
                rank[x] = self.ranks(symbol[x], symbol[x + 1])
        return out

    def ids(self, code: np.ndarray, part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many of each part, parts that are left to the library) of the Latin-1 codes of some parts."""
        kind = KIND[code]
        wrong = np.zeros(parts, bool)
        wrong[part[kind == LEFT]] = True
        wrong |= np.bincount(part, minlength=parts) > MERGED_CHARS  # a piece takes a round for each merge
        if wrong.any():
            keep = ~wrong[part]
            code, part, kind = code[keep], part[keep], kind[keep]
        if not len(code):
            return np.zeros(0, ID), np.zeros(parts, np.int64), wrong
        code = LOWER[code]
        first = np.r_[True, (part[1:] != part[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)]
        wide = code >= 128
        size = 1 + wide
        at = np.cumsum(size) - size
        data, ends = np.empty(at[-1] + size[-1], np.int64), np.zeros(at[-1] + size[-1], bool)
        data[at] = np.where(wide, 0xC0 | code >> 6, code)
        data[at[wide] + 1] = 0x80 | code[wide] & 63
        ends[(at + size - 1)[np.r_[first[1:], True]]] = True
        got = self.merged(np.where(ends, self.final[data], self.inner[data]), np.repeat(np.cumsum(first), size))
        there = got >= 0
        return got[there].astype(ID), np.bincount(np.repeat(part, size)[there], minlength=parts), wrong


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start..start+size of each, one after the other."""
    at = np.cumsum(size) - size
    return np.repeat(start - at, size) + np.arange(int(size.sum()))


class PartTable:
    """Ids of parts of up to KEPT_CHARS Latin-1 bytes, found by two 64-bit numbers that hold the bytes."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.hash, self.lo, self.hi = (np.zeros(0, np.uint64) for _ in range(3))
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, ID)

    def find(self, hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Rows of the table, -1 where there is none. hashes are sorted."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where((self.hash[at] == hashes) & (self.lo[at] == lo) & (self.hi[at] == hi), at, -1)

    def add(self, hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids])
        joined = np.concatenate([self.hash, hashes])
        by = np.argsort(joined, kind="stable")  # two sorted runs
        self.hash = joined[by]
        self.lo, self.hi, self.start, self.size = (np.concatenate(x)[by] for x in ((self.lo, lo), (self.hi, hi), (self.start, start), (self.size, size)))


class WordIds:
    """ids(texts) gives each text's ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.free = Tokenizer.from_file(path), parts_are_free(path)
        self.known: dict[str, bytes] = {"": b""}
        mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.latin = LatinMerges(path) if self.free and latin_is_plain(path) else None
        self.table = PartTable()

    def encoded(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, ID).tobytes()

    def parts_encoded(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. The mark is a word of one id that no part without it can have."""
        if self.mark is None or any(MARK in p for p in parts):
            return [self.encoded(p) for p in parts]
        out = []
        for lo in range(0, len(parts), TOGETHER):
            some = parts[lo : lo + TOGETHER]
            ids = np.array(self.library.encode(f" {MARK} ".join([*some, ""]), add_special_tokens=False).ids, ID)
            ends = (np.flatnonzero(ids == self.mark) * 4).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]
        return out

    def new_ids(self, data: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of the parts of Latin-1 data that begin at start."""
        ids, count, wrong = self.latin.ids(np.frombuffer(data, np.uint8)[ragged(start, size)], np.repeat(np.arange(len(start)), size), len(start))
        if wrong.any():
            left = np.flatnonzero(wrong)
            given = self.parts_encoded([data[a : a + n].decode("latin-1") for a, n in zip(start[left].tolist(), size[left].tolist())])
            into = np.repeat(np.cumsum(count)[left], [len(g) // 4 for g in given])
            ids = np.insert(ids, into, np.frombuffer(b"".join(given), ID))
            count[left] = [len(g) // 4 for g in given]
        return ids, count

    def latin_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of lower-case Latin texts, none of which has a null character or a special string."""
        joined = "\n".join(texts).encode("latin-1")
        code = np.frombuffer(joined, np.uint8)
        gap = SPACE[code]
        edge = np.flatnonzero(np.diff(np.r_[True, gap, True]))
        start, size = edge[::2], edge[1::2] - edge[::2]
        if not len(start):
            return [b""] * len(texts)
        wide = np.ndarray((len(code) + 9,), "<u8", joined + bytes(16), strides=(1,))
        lo, hi = wide[start] & FIRST[np.minimum(size, 8)], wide[np.minimum(start + 8, len(code))] & FIRST[np.clip(size - 8, 0, 8)]
        hashes = lo * np.uint64(0x9E3779B97F4A7C15) ^ (hi + np.uint64(0x165667B19E3779F9)) * np.uint64(0xC2B2AE3D27D4EB4F)
        hashes ^= hashes >> np.uint64(29)
        far = size > KEPT_CHARS  # longer parts are told apart by their place
        hashes[far] = np.flatnonzero(far).astype(np.uint64)
        lo[far], hi[far] = start[far].astype(np.uint64), np.uint64(1 << 63) | size[far].astype(np.uint64)
        by = np.argsort(hashes)
        new = np.r_[True, hashes[by[1:]] != hashes[by[:-1]]]
        one = by[new]
        which = np.empty(len(by), np.int64)
        which[by] = np.cumsum(new) - 1
        if ((lo != lo[one[which]]) | (hi != hi[one[which]])).any():  # two parts of one hash: each is its own
            one = which = np.arange(len(start))
            far = np.ones(len(start), bool)
        if len(self.table.hash) + len(one) > KEPT_LATIN:
            self.table.clear()
        at = np.where(far[one], -1, self.table.find(hashes[one], lo[one], hi[one]))
        old, fresh = at >= 0, np.flatnonzero(at < 0)
        ids, count = self.new_ids(joined, start[one[fresh]], size[one[fresh]])
        first, each = np.empty(len(one), np.int64), np.empty(len(one), np.int64)
        first[old], each[old] = self.table.start[at[old]], self.table.size[at[old]]
        first[fresh], each[fresh] = len(self.table.ids) + np.cumsum(count) - count, count
        pool = np.concatenate([self.table.ids, ids])
        n = each[which]
        out = pool[ragged(first[which], n)].tobytes()
        own = ~far[one[fresh]]
        if own.any():
            x = one[fresh[own]]
            self.table.add(hashes[x], lo[x], hi[x], ids[np.repeat(own, count)], count[own])
        ends = np.cumsum([len(t) + 1 for t in texts])
        stop = (4 * np.r_[0, np.cumsum(n)][np.searchsorted(start, ends)]).tolist()
        return [out[a:b] for a, b in zip([0, *stop], stop)]

    def other_ids(self, texts: list[str]) -> list[bytes]:
        """The ids of any texts, by a table of their parts."""
        cut = [t.translate(SPACES).split(" ") for t in texts]
        new = list(dict.fromkeys(p for parts in cut for p in parts if p and p not in self.known))
        if len(self.known) + len(new) > KEPT_PARTS:
            self.known = {"": b""}
            new = list(dict.fromkeys(p for parts in cut for p in parts if p))
        known = self.known | dict(zip(new, self.parts_encoded(new)))
        if len(known) <= KEPT_PARTS:
            self.known = {p: x for p, x in known.items() if len(p) <= 4 * KEPT_CHARS}
        return [b"".join([known[p] for p in parts]) for parts in cut]

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.free:
            return [self.encoded(t) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        held: dict[bool, list[tuple[int, str]]] = {True: [], False: []}
        chars = {True: 0, False: 0}

        def emptied(latin: bool) -> None:
            for (i, _), ids in zip(held[latin], (self.latin_ids if latin else self.other_ids)([t for _, t in held[latin]])):
                out[i] += ids
            held[latin], chars[latin] = [], 0

        for i, text in enumerate(texts):
            latin = self.latin is not None and "<" not in text and "\0" not in text and is_latin(text)
            for piece in pieces_of(text.lower() if latin else text, BATCH_CHARS):
                held[latin].append((i, piece))
                chars[latin] += len(piece) + 1
                if chars[latin] >= BATCH_CHARS:
                    emptied(latin)
        for latin in held:
            if held[latin]:
                emptied(latin)
        return out


def pieces_of(text: str, chars: int) -> Iterator[str]:
    """A text cut at spaces into pieces of about so many characters; a longer part stays whole."""
    at = 0
    while len(text) - at > chars:
        end = text.rfind(" ", at, at + chars)
        end = end if end > at else text.find(" ", at + chars)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


@cache
def word_ids(path: str) -> WordIds:
    """The worker's one WordIds of a vocabulary file."""
    return WordIds(path)
