"""Token ids on disk, compressed by grammar.

Documents are put in ascending doc_id order and cut into shards of consecutive documents. Within a
shard, frequent pairs of ids are replaced by nonterminals, again and again (Re-Pair, with all
frequent pairs of a round replaced at once), until no pair is frequent; no pair spans two documents. A shard is a row of a
Parquet dataset:

  part, shard        place in the order: all shards of a part follow those of the parts before
  n_tokens           ids in the shard
  doc_ids, tokens, symbols   per document: id, ids, symbols of the compressed sequence
  first_rule         the smallest nonterminal; rule k is nonterminal first_rule + k
  left, right        what each rule stands for, little-endian unsigned 32-bit, as is sequence
  spans              ids that each rule expands to (for access inside a document)
  sequence           the compressed ids of all documents, in order
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import scratch_path, shuffle_width, table
from rasterloom.llm.word_bpe import ID, ragged, word_ids

SHARD = (
    "part int, shard int, n_tokens long, doc_ids array<long>, tokens array<long>, symbols array<long>, "
    "first_rule long, left binary, right binary, spans binary, sequence binary"
)
DOCS = "part int, shard int, n_before long, doc_id long, n_tokens long, ids_crc32 long"
#: Ids after which a shard is closed; a longer document is a shard of its own.
SHARD_IDS = 1 << 20
#: Rules a round, and how often a pair has to occur for a rule.
RULES, LEAST = 1 << 14, 8
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def slots_of(pair: np.ndarray, factor: int) -> np.ndarray:
    return (pair * np.uint64(factor) >> np.uint64(44)).astype(np.int32)


def frequent(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, rule, place): the RULES most frequent pairs in order, and the places that hold them, with their numbers.

    Rules are found by two hash tables without chains; one that has lost both its slots to others
    gets no place, and waits for a later round.
    """
    place, own, slot = None, pair, slots_of(pair, FACTORS[0])
    if len(pair) > 1 << 14:  # a pair of a slot that is hit less than LEAST times is not frequent and need not be sorted
        place = np.flatnonzero((np.bincount(slot, minlength=1 << 20) >= LEAST)[slot])
        own, slot = pair[place], slot[place]
    keys = np.sort(own)
    edge = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[edge, len(keys)])
    often = np.flatnonzero(counts >= LEAST)
    if len(often) > RULES:
        often = np.sort(often[np.lexsort((often, -counts[often]))[:RULES]])
    rules = keys[edge[often]]
    if not len(rules):
        return rules, np.zeros(0, np.int32), np.zeros(0, np.int64)
    numbers = np.arange(len(rules), dtype=np.int32)
    table = np.full(1 << 20, len(rules), np.int32)
    padded = np.r_[rules, np.uint64((1 << 64) - 1)]  # no pair is that
    table[slots_of(rules, FACTORS[0])] = numbers
    rule = table[slot]
    lost = numbers[table[slots_of(rules, FACTORS[0])] != numbers]
    hit = padded[rule] == own
    if len(lost):
        again = np.flatnonzero(~hit)
        table = np.full(1 << 20, len(rules), np.int32)
        table[slots_of(rules[lost], FACTORS[1])] = lost
        rule[again] = table[slots_of(own[again], FACTORS[1])]
        hit[again] = padded[rule[again]] == own[again]
    hit = np.flatnonzero(hit)
    return rules, rule[hit], hit if place is None else place[hit]


def compressed(ids: np.ndarray, lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first_rule, left, right, spans, sequence, symbols by document) of the ids of documents of these lengths.

    After a round over the whole sequence, the next ones look at pairs with a symbol that the round
    before has made, as others are no more frequent than they were; when those give no rule, the whole
    sequence is looked at again, and its giving none ends it.
    """
    seq, last = ids.astype(ID), np.zeros(len(ids), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    first = top = int(seq.max()) + 1 if len(seq) else 0
    left, right, spans = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(0, np.int64)
    made = None  # where the round before has put its symbols; None: look at all
    while len(seq) > 1:
        if made is None:
            x = np.flatnonzero(~last[:-1])
            pair = (seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:])[x]
        else:
            x = np.unique(np.r_[made[made > 0] - 1, made[made < len(seq) - 1]])
            x = x[~last[x]]
            pair = seq[x].astype(np.uint64) << np.uint64(32) | seq[x + 1]
        rules, rule, at = frequent(pair)
        if not len(rules):
            if made is None:
                break
            made = None
            continue
        hit = x[at]
        # of hits that overlap, every second one of a run is taken, from its first
        number = np.arange(len(hit))
        odd = np.flatnonzero((number - np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) > 1], number, 0))) % 2 == 0)
        rule, hit = rule[odd], hit[odd]
        times = np.bincount(rule, minlength=len(rules))
        used = np.flatnonzero(times)
        seq[hit] = (top + np.cumsum(times > 0) - 1).astype(ID)[rule]
        last[hit] = last[hit + 1]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq, last = seq[keep], last[keep]
        made = hit - np.arange(len(hit))
        a, b = (rules[used] >> np.uint64(32)).astype(np.int64), (rules[used] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        known = spans if len(spans) else np.ones(1, np.int64)
        spans = np.r_[spans, sum(np.where(v < first, 1, known[np.maximum(v - first, 0)]) for v in (a, b))]
        left.append(a)
        right.append(b)
        top += len(used)
    symbols = np.zeros(len(lengths), np.int64)
    symbols[lengths > 0] = np.diff(np.r_[-1, np.flatnonzero(last)])
    return first, *(np.concatenate(v).astype(ID) for v in (left, right, [spans])), seq, symbols


def expanded(sequence: np.ndarray, first: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids that a sequence of symbols stands for."""
    out = sequence
    while len(rule := np.flatnonzero(out >= first)) and len(left):
        which = out[rule].astype(np.int64) - first
        size = np.ones(len(out), np.int64)
        size[rule] = 2
        at = np.cumsum(size) - size
        wide = np.repeat(out, size)
        wide[at[rule]], wide[at[rule] + 1] = left[which], right[which]
        out = wide
    return out


def ids_between(row, doc: int, lo: int, hi: int) -> np.ndarray:
    """Ids lo..hi of the doc-th document of a shard, expanding only the symbols that cover them."""
    left, right, spans, sequence = (np.frombuffer(row[k], ID) for k in ("left", "right", "spans", "sequence"))
    at = sum(row["symbols"][:doc])
    own, first = sequence[at : at + row["symbols"][doc]], row["first_rule"]
    rules = own >= first
    size = np.ones(len(own), np.int64)
    size[rules] = spans[own[rules].astype(np.int64) - first]
    end = np.cumsum(size)
    a, b = np.searchsorted(end, lo, "right"), np.searchsorted(end, hi, "left") + 1
    begin = int(end[a - 1]) if a else 0
    return expanded(own[a:b], first, left, right)[lo - begin : hi - begin]


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 1, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of docs (doc_id, text) by the vocabulary file at path, each ended by end_id, to the dataset out.

    Null ids come first; equal ids are ordered by a hash of their text. Null and empty texts are the
    end id alone. An empty table gives a dataset of no shard. A task holds one shard.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), np.array([end_id], ID).tobytes()
        held: list[tuple[int | None, bytes]] = []
        size, part, shard = 0, 0, 0

        def closed() -> pa.RecordBatch:
            lengths = np.array([len(b) // 4 for _, b in held], np.int64)
            first, left, right, spans, sequence, symbols = compressed(np.frombuffer(b"".join(b for _, b in held), ID), lengths)
            row = [part, shard, int(lengths.sum()), [d for d, _ in held], lengths.tolist(), symbols.tolist(), first, *(x.tobytes() for x in (left, right, spans, sequence))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

        for batch in batches:
            part = batch.column(2)[0].as_py() if len(batch) else part
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids([t or "" for t in batch.column(1).to_pylist()])):
                held.append((doc, ids + end))
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield closed()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield closed()

    numbers = pa.list_(pa.int64())
    kinds = [pa.int32(), pa.int32(), pa.int64(), numbers, numbers, numbers, pa.int64(), *[pa.binary()] * 4]
    names = [c.split()[0] for c in SHARD.split(", ")]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("_h", F.xxhash64("text"))
        .withColumn("_n", F.monotonically_increasing_id())  # equal rows do not have to go to one task
        .repartitionByRange(shuffle_width(spark), "doc_id", "_h", "_n")
        .sortWithinPartitions("doc_id", "_h")
        .select("doc_id", "text", F.spark_partition_id().alias("part"))
    )
    ordered.mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(out)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a dataset, from its decoded ids.

    start counts the ids of all documents before. Sums go by part first and then by shard, so no
    task sees more than the parts, or the shards of one part.
    """
    shards = spark.read.schema(SHARD).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    ahead = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", ahead(Window.orderBy("part")).alias("_a"))
    starts = sizes.select("part", "shard", ahead(Window.partitionBy("part").orderBy("shard")).alias("_b")).join(parts, "part").select("part", "shard", (F.col("_a") + F.col("_b")).alias("n_ahead"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in chain.from_iterable(b.to_pylist() for b in batches):
            left, right, sequence = (np.frombuffer(row[k], ID) for k in ("left", "right", "sequence"))
            ids = expanded(sequence, row["first_rule"], left, right)
            ends = np.cumsum(row["tokens"])
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, row["tokens"])]
            n = len(crc)
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()), pa.array(ends - row["tokens"]), pa.array(row["doc_ids"], pa.int64()), pa.array(row["tokens"], pa.int64()), pa.array(crc, pa.int64())], names)

    names = [c.split()[0] for c in DOCS.split(", ")]
    return shards.mapInArrow(run, DOCS).join(starts, ["part", "shard"]).select("doc_id", (F.col("n_ahead") + F.col("n_before")).alias("start"), "n_tokens", "ids_crc32")


def op9_grammar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = scratch_path(spark, "grammar-ids")
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return read_ids(spark, out)
