"""Exact top-k by inner product: branch and bound over a vertical layout.

Vectors are whole numbers. Queries go to all tasks in waves of bounded bytes; candidates stay where they
are and are never shuffled. A task lays its candidates out by dimension, a block at a time, dimensions in
an order of falling mass. Inner products are added up a block of dimensions at a time; what the rest of
the dimensions can add lies within the product of the remaining norms of query and candidate
(Cauchy-Schwarz). Candidates whose upper bound is below the query's k-th best score are dropped and the
survivors compacted, until the last dimensions give exact scores. The k-th best score is at first that of
a bounded sample of candidates, which goes out with the wave, and rises from block to block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import saved, table

#: Numbers of the queries of a wave (32 MB), candidates of a block, dimensions that are added at a time,
#: queries that are multiplied together, candidates that the first bounds come from.
WAVE, CANDIDATES, DIMENSIONS, TOGETHER, SAMPLE = 1 << 22, 16_384, 16, 128, 1024
HITS = "query_id long, vec_id long, score long"
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 52)


def quantized(vector: Column) -> Column:
    """floor(256 * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256.0))


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(t: pa.Table | pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of rows by the length of their vectors."""
    ids, col = t.column("vec_id").to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(t, pa.RecordBatch) else t.column("vec_id").to_numpy().astype(np.int64), t.column("v")
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat, sizes = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(col).to_numpy(zero_copy_only=False)
    starts, out = np.cumsum(sizes) - sizes, {}
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        out[d] = ids[at], flat[starts[at][:, None] + np.arange(d)]
    return out


def exact_kind(q: np.ndarray, c: np.ndarray) -> type:
    """Double precision where all sums of products are exact in it."""
    return np.float64 if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < EXACT else np.int64


class Best:
    """The k best (score, id) of each of some queries so far, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, bounds: np.ndarray):
        self.ids, self.q, self.k, self.bounds = ids, q, k, bounds.astype(np.float64)
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        other = ids != self.ids[i]
        ids, scores = ids[other], scores[other].astype(np.int64)
        if i in self.found:
            ids, scores = np.concatenate([self.found[i][0], ids]), np.concatenate([self.found[i][1], scores])
        best = np.lexsort((ids, -scores))[: self.k]
        self.found[i] = ids[best], scores[best]
        if len(best) == self.k:
            self.bounds[i] = max(self.bounds[i], float(scores[best[-1]]))

    def search(self, c_ids: np.ndarray, c: np.ndarray) -> None:
        """Takes in a block of candidates."""
        kind, k = exact_kind(self.q, c), self.k
        order = np.argsort(-np.square(c.astype(np.float64)).sum(0), kind="stable")
        q, vertical = self.q[:, order].astype(kind), np.ascontiguousarray(c[:, order].T.astype(kind))
        cuts = [*range(0, q.shape[1], DIMENSIONS), q.shape[1]]
        square = lambda x: np.square(x.astype(np.float64))
        # norms of what is left after each block of dimensions, a little raised against rounding
        q_rest = [np.sqrt(square(q[:, at:]).sum(1)) * (1 + 1e-9) for at in cuts[1:]]
        c_rest = [np.sqrt(square(vertical[at:]).sum(0)) * (1 + 1e-9) for at in cuts[1:]]
        if len(cuts) == 1:  # vectors without components: all scores are 0
            for i in range(len(q)):
                self.add(i, c_ids, np.zeros(len(c_ids), np.int64))
            return
        for lo in range(0, len(q), TOGETHER):
            first = q[lo : lo + TOGETHER, : cuts[1]] @ vertical[: cuts[1]]
            above = first + q_rest[0][lo : lo + TOGETHER, None] * c_rest[0] >= self.bounds[lo : lo + TOGETHER, None]
            for i in np.flatnonzero(above.any(1)).tolist():
                alive = np.flatnonzero(above[i])
                part, i = first[i, alive], lo + i
                for j in range(1, len(cuts)):
                    if j > 1:
                        part = part + q[i, cuts[j - 1] : cuts[j]] @ vertical[cuts[j - 1] : cuts[j], alive]
                    slack, least = q_rest[j - 1][i] * c_rest[j - 1][alive], self.bounds[i]
                    if len(alive) > k + 1:  # the query's own row takes no part, so k + 1 lower bounds are needed
                        least = max(least, np.partition(part - slack, len(alive) - k - 1)[len(alive) - k - 1])
                    stay = part + slack >= least
                    if not stay.all():
                        alive, part = alive[stay], part[stay]
                if len(alive):
                    self.add(i, c_ids[alive], part)


def first_bounds(ids: np.ndarray, q: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """A score that each query's k-th best reaches at least: the (k + 1)-th of a sample, as one of them may be its own."""
    out = np.full(len(q), -np.inf)
    if sample is not None and len(sample[0]) > k:
        c = sample[1]
        kind = exact_kind(q, c)
        for lo in range(0, len(q), 4096):
            scores = q[lo : lo + 4096].astype(kind) @ c.T.astype(kind)
            out[lo : lo + 4096] = np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1]
    return out


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, wave: int = WAVE, candidate_rows: int = CANDIDATES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of vectors (vec_id, v array<long>) for each row of queries.

    A candidate of the query's own vec_id is left out. Ties go to the smaller vec_id. Null vectors
    and null ids take no part; vectors meet only vectors of their own length. Repeated rows of vectors
    are candidates of their own; repeated rows of queries count once, and rows of one id and several
    vectors are asked together, as one. Empty tables give an empty result. Scores have to fit in 64 bits.
    """
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "v").where("vec_id is not null and v is not null")
    cands = saved(clean(vectors), "candidates")
    asks = saved(clean(queries).distinct().withColumn("_h", F.xxhash64(F.monotonically_increasing_id())), "queries")
    numbers = asks.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    # rows go to waves by a hash of their number: half of WAVE on the mean, so that none is much above it
    waves = max(1, -(-2 * numbers // wave)) if numbers > wave else 1
    sample = matrix(cands.limit(SAMPLE).select("vec_id", "v").toArrow())
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = []
    for w in range(waves):
        own = matrix(asks.where(F.pmod("_h", F.lit(waves)) == w).select("vec_id", "v").toArrow())
        sent = spark.sparkContext.broadcast({d: (ids, q, first_bounds(ids, q, sample.get(d), k)) for d, (ids, q) in own.items()})

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            states = {d: Best(ids, q, k, bounds) for d, (ids, q, bounds) in sent.value.items()}
            held: dict[int, list] = {d: [] for d in states}

            def emptied(d: int) -> None:
                ids, c = (np.concatenate(x) for x in zip(*held[d]))
                held[d] = []
                states[d].search(ids, c)

            for batch in batches:
                for d, rows in matrix(batch).items():
                    if d in held:
                        held[d].append(rows)
                        if sum(len(r[0]) for r in held[d]) >= candidate_rows:
                            emptied(d)
            for d, state in states.items():
                if held[d]:
                    emptied(d)
                for i, (ids, scores) in state.found.items():
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), state.ids[i])), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

        # each task gave at most k rows a query; Spark keeps k of them on the writing side too
        hits = cands.mapInArrow(search, HITS).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        hits = hits.select("query_id", "rank", "vec_id", "score")
        out.append(hits if waves == 1 else saved(hits, "wave"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding"))).select("vec_id", quantized(F.col("embedding")).alias("v"))
    return exact_topk(rows, rows.where("vec_id % 50 = 0"))


OP6_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, cast(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
