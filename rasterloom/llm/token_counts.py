"""Token counts of a byte-level BPE vocabulary, by heap-and-linked-list merging.

A text is cut into pieces by the vocabulary's split pattern. The symbols of a piece, its bytes at
first, form a linked list; a heap holds the adjacent pairs that have a rank. The pair of the lowest
rank (the leftmost of equals) is popped and merged until none is left. The count of a piece is its
number of bytes minus its merges; identifiers are never made. Counts of short pieces are kept in a
bounded table, so that a word is merged once per worker and not once per use.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import table

# Fixed value: the split pattern of byte-level BPE vocabularies of this kind. \p{White_Space} stands
# for \s, which also takes U+001C to U+001F in Python.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pieces in a worker's table, and the longest piece kept there.
KEPT_PIECES, KEPT_CHARS = 400_000, 64

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the others get the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after all merges.

    >>> merged(list("aaab"), {("a", "a"): 0, ("aa", "a"): 1})
    2
    """
    n = len(symbols)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get((a, b))) is not None]
    heapify(heap)
    left = n
    while heap:
        _, i, a, b = heappop(heap)
        j = after[i]
        if j < 0 or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = a + b, ""
        after[i] = k = after[j]
        left -= 1
        if k >= 0:
            before[k] = i
            if (rank := ranks.get((symbols[i], symbols[k]))) is not None:
                heappush(heap, (rank, i, symbols[i], symbols[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], symbols[i]))) is not None:
            heappush(heap, (rank, h, symbols[h], symbols[i]))
    return left


class Counts(dict):
    """Tokens by piece; counts what it lacks and never holds more than KEPT_PIECES pieces."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks, self.alphabet = ranks, byte_symbols()

    def __missing__(self, piece: str) -> int:
        alphabet = self.alphabet
        n = merged([alphabet[b] for b in piece.encode("utf-8", "surrogatepass")], self.ranks)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = n
        return n


@cache
def counter(path: str) -> Callable[[str], int]:
    """The worker's one function that counts a text's tokens with the vocabulary file at path."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    counts = Counts({(a, b): rank for rank, (a, b) in enumerate(pairs)})
    special = [t["content"] for t in spec["added_tokens"]]
    pieces = regex.compile(PIECES).findall
    cut = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None

    def count(text: str) -> int:
        if cut is None or not any(s in text for s in special):
            return sum(map(counts.__getitem__, pieces(text)))
        parts = cut.split(text)  # a special string counts one and ends the text on both of its sides
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, pieces(p))) for p in parts)

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are rows of their
    own, other columns are not looked at, an empty table gives an empty result. There is no shuffle,
    and a worker holds one Arrow batch and a table of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            n_tokens = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
