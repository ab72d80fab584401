"""Best-fit packing of documents into sequences of a fixed length, after dominance reduction.

Piece lengths are whole numbers up to the capacity, so the instance is a histogram of at most that
many counts, whatever the number of documents. On it, the driver first fixes pieces by the
Martello-Toth dominance criterion: a piece goes into a sequence with a set of at most two others that
dominates all other sets that fit beside it, the instance shrinks, and passes over all lengths go on until
none fixes anything. Best fit packs what is left. The plan is a list of intervals: ranks lo..hi among the pieces of one length go
to sequences seq.. at offset .... Pieces get their rank in two levels (bucket, then row), so a length
that most documents share is spread over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import saved, shuffle_width, table
from rasterloom.llm.word_bpe import ID, word_ids

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


class Lengths:
    """A histogram of lengths with quick search for the longest length present up to a bound."""

    def __init__(self, counts: dict[int, int]):
        self.counts = {k: int(v) for k, v in counts.items() if v}
        self.keys = sorted(self.counts)

    def longest(self, most: int) -> int:
        i = bisect_right(self.keys, most)
        return self.keys[i - 1] if i else 0

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
            del self.keys[bisect_right(self.keys, length) - 1]

    def least(self, n: int, besides: int) -> list[int]:
        """The n shortest pieces, when one of the length besides is spoken for."""
        found: list[int] = []
        for k in self.keys[: n + 1]:
            found += [k] * min(n, self.counts[k] - (k == besides))
        return found[:n]

    def left(self, length: int, *taken: int) -> int:
        """Pieces of a length when some are spoken for."""
        return self.counts.get(length, 0) - taken.count(length)

    def best_pair(self, room: int, besides: int) -> tuple[int, int]:
        """Two pieces of the greatest sum up to room, the longer first, of equal sums that with the longest; (0, 0) if none fit."""
        best, a = (0, 0), self.longest(room)
        while a and 2 * a > sum(best):
            b = self.longest(min(a, room - a)) if self.left(a, besides) > 0 else 0
            while b and self.left(b, besides, a) < 1:
                b = self.longest(b - 1)
            if b and a + b > sum(best):
                best = (a, b)
            a = self.longest(a - 1)
        return best

    def between(self, low: int, high: int, besides: int) -> list[int]:
        """The two shortest pieces that are longer than low and shorter than high."""
        found: list[int] = []
        for k in self.keys[bisect_right(self.keys, low) :]:
            if k >= high or len(found) >= 2:
                break
            found += [k] * min(2, self.left(k, besides))
        return found[:2]


def companions(lengths: Lengths, j: int, room: int) -> list[int] | None:
    """The pieces that dominate all others that fit beside one of length j; None where no such set is seen.

    Any set beside j can take the place of another that is no longer, piece by piece. So i, the longest that
    fits, dominates all where it fills the room, where no two pieces fit together, and where at most two
    do and no two have a greater sum. Where at most two fit, the two a >= b of the greatest sum dominate
    all where a is the longest and no two pieces longer than b and shorter than a fit together.
    """
    i = lengths.longest(room)
    if i == j and lengths.left(i, j) < 1:
        i = lengths.longest(i - 1)
    if not i:
        return []
    small = lengths.least(3, j)
    if i == room or len(small) < 2 or small[0] + small[1] > room:
        return [i]
    if len(small) == 3 and sum(small) <= room:
        return None
    a, b = lengths.best_pair(room, j)
    if i >= a + b:
        return [i]
    inner = lengths.between(b, a, j)
    return [a, b] if a == i and (len(inner) < 2 or sum(inner) > room) else None


def reduced(lengths: Lengths, capacity: int) -> list[tuple[int, list[int]]]:
    """Fixes (times, lengths of a sequence) by dominance and takes them out of lengths, until no length is left
    that a set of companions is seen for.

    Pieces of equal length are fixed together: taking pieces away lets the reason stand as long as the
    companions are there.
    """
    fixed, before = [], None
    while before != len(fixed):
        before = len(fixed)
        j = lengths.longest(capacity)
        while j:
            beside = companions(lengths, j, capacity - j)
            if beside is None:
                j = lengths.longest(j - 1)
                continue
            row = [j, *beside]
            n = min(lengths.counts[k] // row.count(k) for k in row)
            for k in row:
                lengths.take(k, n)
            fixed.append((n, row))
            j = lengths.longest(j)
    return fixed


def best_fit(lengths: Lengths, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, how many), ...]) of best fit over descending lengths, equal sequences together."""
    rooms: dict[int, list[tuple[int, tuple]]] = {}  # room left -> [(times, (contents before, length, how many))]
    sizes: list[int] = []  # rooms that have sequences, ascending

    def put(room: int, times: int, inside: tuple) -> None:
        if room not in rooms:
            rooms[room] = []
            sizes.insert(bisect_right(sizes, room), room)
        rooms[room].append((times, inside))

    for length in reversed(lengths.keys):
        left = lengths.counts[length]
        while left:
            k = bisect_right(sizes, length - 1)
            if k == len(sizes):
                room, times, inside = capacity, left, ()
            else:
                room = sizes[k]
                times, inside = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    sizes.pop(k)
            each = min(room // length, left)
            n = min(times, left // each)
            if n < times and inside:
                put(room, times - n, inside)
            put(room - each * length, n, (inside, length, each))
            left -= n * each
    out = []
    for groups in rooms.values():
        for times, inside in groups:
            row = []
            while inside:
                inside, length, each = inside
                row.append((length, each))
            out.append((times, row[::-1]))
    return out


def packing_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, lo, hi, first sequence, how many a sequence, offset) sorted by length and lo.

    Its size depends on the number of different lengths, at most capacity, and not on the counts.
    """
    lengths = Lengths(counts)
    groups = [(n, [(k, 1) for k in row]) for n, row in reduced(lengths, capacity)]
    groups += best_fit(lengths, capacity)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, inside in groups:
        offset = 0
        for length, each in inside:
            lo = used.get(length, 0)
            used[length] = lo + times * each
            rows.append((length, lo, used[length], sequence, each, offset))
            offset += length * each
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def document_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the pieces of at most capacity ids that docs are cut into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), np.array([end_id], ID).tobytes()
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, PIECES)


def best_fit_packing(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, buckets: int = 256) -> DataFrame:
    """One row per piece of docs (doc_id, text) with its sequence_id and offset.

    Null and empty texts are pieces of the end id alone. Only documents of more than capacity ids
    are cut. Repeated rows and null ids are documents of their own; ties are broken by id, start and
    digest, and equal rows are interchangeable. Other columns are not looked at. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    # a number of its own lets equal rows go to several buckets
    pieces = saved(document_pieces(docs, path, capacity, end_id).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    bucketed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_row"), F.lit(buckets)))
    cells = saved(bucketed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "cells")
    counts = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("_n")).collect()}  # at most capacity rows
    plan = spark.sparkContext.broadcast(packing_plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32", "_row")
    ranked = (
        bucketed.repartition(shuffle_width(spark), "length", "_bucket")
        .withColumn("_within", F.row_number().over(within) - 1)
        .join(firsts, ["length", "_bucket"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_within")).alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "_rank"))
            # the last interval of the length that starts at or before the rank
            order = np.lexsort((np.r_[rows[:, 1], rank], np.r_[rows[:, 0], length])) if len(rows) else np.arange(0)
            table_rows = order < len(rows)
            at = np.maximum.accumulate(np.where(table_rows, order, -1))
            found = np.empty(len(rank), np.int64)
            found[order[~table_rows] - len(rows)] = at[~table_rows]
            row = rows[found]
            inside = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(row[:, 3] + inside // row[:, 4]), pa.array(row[:, 5] + inside % row[:, 4] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PLACED)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
