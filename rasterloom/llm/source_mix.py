"""Mixing sources to target weights.

Words of a source are packed into blocks of a fixed length, shorter for sources of few words (documents by
buckets of bounded size and number, so no source is one task's work). For each output shard, the driver draws how many of its slots each
source gets: a multinomial draw from the slots that the sources have left, so that the draws of all
shards end at the sources' targets. Slot t of a source takes block P(t mod n), P a pseudorandom
permutation of its n blocks that changes with each pass. Blocks are then joined by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import saved, shuffle_width, table, word_count

#: Words of a block, of a bucket of blocks, output shards, slots that one row stands for before they are listed.
BLOCK, BUCKET, SHARDS, RUN = 64, 1 << 18, 64, 1 << 16
#: Blocks that a source has at least, if it has the words, and documents of a bucket.
LEAST_BLOCKS, BUCKET_ROWS = 1024, 1 << 16
#: Sources live on the driver (their weights are its input); more of them are refused.
MAX_SOURCES = 100_000

SLOTS = "source_no int, block long, shard int, slot long"


def water_filled(sizes: list[float], weights: list[float], most: float) -> list[float]:
    """Shares of sum(sizes) by weight, none above most * its size; what is above goes to the others by weight.

    >>> water_filled([1, 99], [1, 1], 3)
    [3.0, 97.0]
    """
    total, weight = float(sum(sizes)), float(sum(weights))
    out = [0.0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i]):
        out[i] = min(most * float(sizes[i]), total * weights[i] / weight)
        total, weight = total - out[i], weight - weights[i]
    return out


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 applied to i: a Feistel network, walked until it is below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, u = np.uint64((1 << half) - 1), np.uint64
    keys = [u(x) for x in np.random.default_rng(key).integers(1, 1 << 63, 4)]

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> u(half), x & mask
        for k in keys:
            f = (b + k) * u(0x9E3779B97F4A7C15)
            f ^= f >> u(29)
            f *= u(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> u(32)) & mask)
        return a << u(half) | b

    out = once(i.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def draws(quotas: list[int], shards: int, seed: int) -> list[tuple[int, int, int, int, int]]:
    """(shard, source, first slot in the shard, first slot of the source, slots) of each shard's multinomial draw."""
    left, out = np.array(quotas, np.int64), []
    done = np.zeros_like(left)
    for shard in range(shards):
        slots = int(left.sum()) // (shards - shard)
        got, rng = np.zeros_like(left), np.random.default_rng([seed, shard])
        while (want := slots - int(got.sum())) > 0:  # a source gives no more than it has left
            rest = left - got
            got += np.minimum(rng.multinomial(want, rest / rest.sum()), rest)
        at = np.cumsum(got) - got
        out += [(shard, int(s), int(at[s]), int(done[s]), int(got[s])) for s in np.flatnonzero(got)]
        left, done = left - got, done + got
    return out


def source_mix(docs: DataFrame, weights=(1.0, 2.0, 3.0), most: float = 3.0, block: int = BLOCK, shards: int = SHARDS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, mix) of docs (doc_id, text, source).

    documents: doc_id, size, source_size, target and row_key of each row. mix: shard, slot, row_key,
    doc_id, first_word, n_words: the mixed words, as runs of words of documents. Sources in code
    point order, null last, take the weights in turn. Null and empty texts have size 0 and are never
    mixed. Rows are packed in the order of a hash of their id, ties by id and size; equal rows are
    documents of their own and interchangeable. Other columns are not looked at. An empty table gives
    two empty results. A document is taken at most `most` (a whole number, for it to hold exactly)
    times its size. Reruns agree.
    """
    spark = docs.sparkSession
    sized = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "sized")
    sizes = [(r[0], r[1], r[2]) for r in sized.groupBy("source").agg(F.sum("size"), F.count("*")).limit(MAX_SOURCES + 1).collect()]
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    targets = water_filled([s for _, s, _ in sizes], [weights[i % len(weights)] for i in range(len(sizes))], most)
    sources = spark.createDataFrame(
        [
            (name, i, size, target, max(1, -(-size // BUCKET), -(-rows // BUCKET_ROWS)), max(1, min(block, size // LEAST_BLOCKS)))
            for i, ((name, size, rows), target) in enumerate(zip(sizes, targets))
        ],
        "source string, source_no int, source_size long, target double, buckets long, block_words long",
    )
    # at most MAX_SOURCES rows of a name and four numbers
    known = sized.join(F.broadcast(sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    known = known.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("buckets"))).drop("buckets")
    cell = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size", "_row")
    documents = saved(
        known.withColumn("_row", F.monotonically_increasing_id())
        .withColumn("start", F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row_key", F.row_number().over(cell))
        .drop("_row"),
        "packed",
    )
    cells = documents.groupBy("source_no", "bucket").agg(F.sum("size").alias("_words"), F.first("block_words").alias("_w")).withColumn("_blocks", F.ceil(F.col("_words") / F.col("_w")))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = saved(cells.select("source_no", "bucket", "_blocks", F.coalesce(F.sum("_blocks").over(before), F.lit(0)).alias("_base")), "cells")
    blocks = {r[0]: r[1] for r in cells.groupBy("source_no").agg(F.sum("_blocks")).collect()}  # a row a source
    n_blocks = [int(blocks.get(i) or 0) for i in range(len(sizes))]
    quotas = [min(int(most * n), round(n * t / s)) if s else 0 for n, t, (_, s, _) in zip(n_blocks, targets, sizes)]
    runs = spark.createDataFrame(
        [(shard, s, slot, first, n, n_blocks[s]) for shard, s, slot, first, n in draws(quotas, shards, seed)],
        "shard int, source_no int, slot long, first long, n long, n_blocks long",
    )
    runs = runs.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(RUN).cast("long")))).select(
        "shard", "source_no", (F.col("slot") + F.col("_at")).alias("slot"), (F.col("first") + F.col("_at")).alias("first"), F.least(F.lit(RUN), F.col("n") - F.col("_at")).alias("n"), "n_blocks"
    )

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                t = np.arange(r["first"], r["first"] + r["n"])
                index = np.empty(len(t), np.int64)
                for turn in range(t[0] // r["n_blocks"], t[-1] // r["n_blocks"] + 1):
                    own = t // r["n_blocks"] == turn
                    index[own] = permuted(t[own] % r["n_blocks"], r["n_blocks"], seed * 1_000_003 + r["source_no"] * 101 + int(turn))
                same = lambda v, kind: pa.array(np.full(len(t), v), kind)
                yield pa.RecordBatch.from_arrays([same(r["source_no"], pa.int32()), pa.array(index), same(r["shard"], pa.int32()), pa.array(r["slot"] + np.arange(len(t)))], ["source_no", "block", "shard", "slot"])

    slots = runs.repartition(shuffle_width(spark)).mapInArrow(listed, SLOTS)
    parts = (
        documents.where("size > 0")
        .join(cells.select("source_no", "bucket", "_base"), ["source_no", "bucket"])
        .withColumn("_b", F.explode(F.expr("sequence(start div block_words, (start + size - 1) div block_words)")))
        .withColumn("_from", F.greatest(F.col("start"), F.col("_b") * F.col("block_words")))
        .select(
            "source_no", "bucket", "row_key", "doc_id", (F.col("_base") + F.col("_b")).alias("block"),
            (F.col("_from") - F.col("start")).alias("first_word"),
            (F.least(F.col("start") + F.col("size"), (F.col("_b") + 1) * F.col("block_words")) - F.col("_from")).alias("n_words"),
        )
    )
    key = F.struct("source_no", "bucket", "row_key").alias("row_key")
    # a sort-merge join: the size of slots, listed from few runs, is not what the planner takes it for
    mix = slots.join(parts.hint("merge"), ["source_no", "block"]).select("shard", "slot", key, "doc_id", "first_word", "n_words")
    return documents.select("doc_id", "size", "source_size", "target", key), mix


def mixed_texts(mix: DataFrame, docs: DataFrame) -> DataFrame:
    """The mix's words: shard, slot, doc_id, first_word and words (an array) for docs of unique ids."""
    words = docs.select("doc_id", F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)").alias("_words"))
    return mix.join(words, "doc_id").select("shard", "slot", "doc_id", "first_word", F.slice("_words", F.col("first_word").cast("int") + 1, F.col("n_words").cast("int")).alias("words"))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (the words that the mix takes of it) of each row of docs."""
    documents, mix = source_mix(docs, **how)
    key = ["row_key.source_no", "row_key.bucket", "row_key.row_key"]
    taken = mix.groupBy(*key).agg(F.sum("n_words").alias("taken"))
    flat = documents.select("doc_id", "size", "source_size", "target", *key)
    return flat.join(taken, ["source_no", "bucket", "row_key"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))
