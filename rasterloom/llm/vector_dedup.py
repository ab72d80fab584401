"""Embedding near-dedup over a robust-pruned flat graph.

Equal vectors of a label form a class; classes are what is searched. A label's classes are cut into
shards of bounded size. A cell that is not much too large is cut into blocks, and each two of them are a
cell, which parts no pair. From a larger one as many pivots are drawn as it takes to make shards in one
level, and its members go to the cells of their two nearest pivots, so shards overlap and each member is
there twice; only cells that are still too large are cut again. A pair without a common cell is lost to that
try. Each shard builds a graph
(nearest neighbours, pruned robustly to a bounded degree); the adjacency lists of a class from all
its shards are united. In each shard a greedy beam search goes from the medoid towards every member;
from what it finds, and from the member's own node, the search expands along the edges of all that is
in range until nothing new is. What is found is
verified in double precision. Recall is audited against brute force on bounded sets of queries, one of
all classes and one of those with few neighbours. Below the target, search, graph and sharding are
widened (other and more pivots, four nearest; at last blocks alone, which part no pair, at a cost of
about 2 / SHARD copies per class and class of its label) and run again; if that is below the target
too, the query fails.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import saved, table
from rasterloom.llm.components import components
from rasterloom.llm.exact_topk import usable

#: Classes of a shard, levels of cells.
SHARD, LEVELS = 4096, 12
#: By try: how many nearest pivots a member goes to (None: blocks alone). Least and most pivots of a cell, members that a task sorts to them.
ROUTES, PIVOTS, SORTED = (2, 4, None), (8, 1024), 8192
#: Degree, candidates that are pruned to it, beam of the search, slack of the pruning.
DEGREE, NEAR, BEAM, ALPHA = 24, 64, 16, 1.2
#: Queries of the audit, those of classes with at most FEW neighbours, and its target.
AUDITED, LONELY, FEW, TARGET = 256, 2048, 2, 0.97

MEMBER = "cell string, vec_id long, v array<double>, times long, cells array<string>"


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vectors_of(t: pa.Table | pa.RecordBatch, name: str = "v") -> np.ndarray:
    col = t.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def pruned_graph(v: np.ndarray, degree: int, near: int) -> np.ndarray:
    """Adjacency (n x degree, -1 where there is no edge): of the nearest, those that no kept one is much nearer to."""
    n = len(v)
    v32 = v.astype(np.float32)
    out = np.full((n, degree), -1, np.int64)
    near = min(near, n - 1)
    if near < 1:
        return out
    for lo in range(0, n, 256):  # a block of rows at a time
        rows = np.arange(lo, min(n, lo + 256))
        sims = v32[rows] @ v32.T
        sims[np.arange(len(rows)), rows] = -2
        cand = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        own = np.take_along_axis(sims, cand, 1)
        order = np.argsort(-own, axis=1)
        cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
        dist = np.maximum(0, 2 - 2 * own)
        alive = np.ones(cand.shape, bool)
        each = np.arange(len(rows))
        for k in range(degree):
            first = alive.argmax(1)
            some = alive[each, first]
            if not some.any():
                break
            picked = cand[each, first]
            out[rows[some], k] = picked[some]
            apart = np.maximum(0, 2 - 2 * np.einsum("rcd,rd->rc", v32[cand], v32[picked]))
            alive &= ~((ALPHA * apart <= dist) & some[:, None])
            alive[each, first] = False
    return out


def in_range(v: np.ndarray, adj: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, found) of rows with cosine of at least `least`, each row being a query."""
    n = len(v)
    v32 = v.astype(np.float32)
    slack = least - 1e-4
    medoid = int((v32 @ v32.mean(0)).argmax())
    ids = np.full((n, beam), -1, np.int64)
    sims = np.full((n, beam), -3, np.float32)
    done = np.zeros((n, beam), bool)
    ids[:, 0], sims[:, 0] = medoid, v32 @ v32[medoid]
    for _ in range(4 * beam):
        open_sims = np.where(done | (ids < 0), -3, sims)
        best = open_sims.argmax(1)
        busy = np.flatnonzero(open_sims[np.arange(n), best] > -3)
        if not len(busy):
            break
        done[busy, best[busy]] = True
        new = adj[ids[busy, best[busy]]]
        got = np.where(new >= 0, np.einsum("qrd,qd->qr", v32[new], v32[busy]), -3).astype(np.float32)
        got[(new[:, :, None] == ids[busy][:, None, :]).any(2)] = -3
        all_ids, all_sims = np.concatenate([ids[busy], new], 1), np.concatenate([sims[busy], got], 1)
        all_done = np.concatenate([done[busy], np.zeros(new.shape, bool)], 1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        take = lambda x: np.take_along_axis(x, top, 1)
        ids[busy], sims[busy], done[busy] = take(all_ids), take(all_sims), take(all_done)
        ids[sims <= -3] = -1
    # edges in both directions, as a list by node, for the expansion
    x, k = np.nonzero(adj >= 0)
    tail, head = np.r_[x, adj[x, k]], np.r_[adj[x, k], x]
    head = head[np.argsort(tail, kind="stable")]
    degree = np.bincount(tail, minlength=n)
    start = np.cumsum(degree) - degree
    q, k = np.nonzero((sims >= slack) & (ids >= 0))
    seen = np.zeros((n, n), bool)
    for lo in range(0, n, 128):  # a block of queries at a time: what was compared is a bit map
        own = (q >= lo) & (q < lo + 128)
        compared = np.zeros(min(128, n - lo) * n, bool)
        rows = np.arange(lo, min(n, lo + 128))  # a query is itself in the graph and in its own range
        new = np.union1d((q[own] - lo) * n + ids[q[own], k[own]], (rows - lo) * n + rows)
        compared[new] = True
        while len(new):  # expand all that is in range along its edges
            seen.reshape(-1)[new + lo * n] = True
            at, count = new % n, degree[new % n]
            edge = np.repeat(start[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            next_to = np.zeros(len(compared), bool)
            next_to[np.repeat(new - at, count) + head[edge]] = True
            keys = np.flatnonzero(next_to & ~compared)
            compared[keys] = True
            new = np.concatenate([part[np.einsum("pd,pd->p", v32[part // n + lo], v32[part % n]) >= slack] for part in np.array_split(keys, len(keys) // 50_000 + 1)])
    # what one of two has found, the other has too
    seen |= seen.T
    np.fill_diagonal(seen, False)
    pairs = [np.zeros((2, 0), np.int32)]
    for lo in range(0, n, 128):
        q, x = np.nonzero(seen[lo : lo + 128])
        for part in np.array_split(np.stack([q + lo, x]).astype(np.int32), len(q) // 50_000 + 1, axis=1):
            pairs.append(part[:, np.einsum("pd,pd->p", v[part[0]], v[part[1]]) >= least])
    return tuple(np.concatenate(pairs, axis=1))


def apart(pivots: np.ndarray, most: float) -> np.ndarray:
    """The pivots that are no nearer than `most` (a cosine) to one before them."""
    kept: list[int] = []
    sims = pivots @ pivots.T
    for i in range(len(pivots)):
        if not kept or sims[i, kept].max() < most:
            kept.append(i)
    return pivots[kept]


def within_reach(v: np.ndarray, pivots: np.ndarray, least: float) -> np.ndarray:
    """Of each vector and pivot, whether a vector of cosine of at least `least` may be nearest to the pivot."""
    sims = v @ pivots.T
    gap = np.sqrt(max(0.0, 2 - 2 * least)) * np.linalg.norm(pivots[:, None] - pivots, axis=2) + 1e-9
    ok = np.ones(sims.shape, bool)
    for k in range(len(pivots)):
        ok &= sims[:, k : k + 1] - sims <= gap[k]
    return ok


def blocks_of(n: int, shard: int) -> int:
    """Blocks of which two are at most a shard, with some room for uneven ones."""
    return int(-(-2.1 * n // shard))


def by_pivots(n: int, shard: int, routes: int | None) -> bool:
    """Whether routes, with pivots, copies members less often than blocks do."""
    return routes is not None and routes < blocks_of(n, shard) - 1


def cells_of(classes: DataFrame, shard: int, least: float, routes: int | None) -> DataFrame:
    """classes (cell, vec_id, v, times) spread over overlapping cells of at most about shard members.

    Pivots lie well apart, so that a cluster of near vectors stays whole. Members go to their `routes`
    nearest; where pivots are too few for that, to each that a neighbour may be nearest to. A cell of
    which all pivots are near each other is such a cluster. It, and a cell that pivots would copy no
    less often, is cut into blocks, and each two of them are a cell; where routes is None, each cell is.
    """
    members, done = classes, []
    for _ in range(LEVELS):
        sizes = saved(members.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > shard), "large-cells")
        if sizes.isEmpty():
            break
        done.append(members.join(sizes, "cell", "left_anti"))
        # cells of so many pivots have about half a shard of members each
        most = F.lit(routes or 1)
        sizes = sizes.withColumn("p", F.least(F.lit(PIVOTS[1]), F.greatest(F.lit(PIVOTS[0]) * most, F.ceil(2 * most * F.col("n") / shard))).cast("long"))
        sizes = sizes.withColumn("parts", F.ceil(F.col("n") / SORTED).cast("long"))
        large = members.join(sizes, "cell")
        h = F.xxhash64("vec_id", "cell", most)
        drawn = large.groupBy("cell", F.pmod(h, F.col("p")).alias("_k")).agg(F.min_by("v", h).alias("v"))
        # a bounded number of pivots a cell, once to each task that sorts some of its members
        pivots = saved(drawn.join(sizes.select("cell", "parts"), "cell").select("cell", "v", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part")), "pivots")
        large = large.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts"))).select("cell", "part", "n", "vec_id", "v", "times")

        def split(some: pa.Table, drawn: pa.Table) -> pa.Table:
            if not some.num_rows:
                return pa.table({"cell": pa.array([], pa.string()), **{c: some.column(c) for c in ("vec_id", "v", "times")}})
            cell, size, ids = some.column("cell")[0].as_py(), some.column("n")[0].as_py(), some.column("vec_id").to_numpy()
            pivots = vectors_of(drawn) if drawn.num_rows else np.zeros((0, 1))
            near = apart(pivots[np.lexsort(pivots.T)], least - 0.1) if by_pivots(size, shard, routes) else []
            if len(near) > 1:
                v = vectors_of(some)
                if len(near) < 2 * routes:
                    row, to = np.nonzero(within_reach(v, near, least))
                else:
                    to = np.argsort(-(v @ near.T), axis=1)[:, :routes].ravel()
                    row = np.repeat(np.arange(len(v)), routes)
                names = [f"{cell}.{k}" for k in to.tolist()]
            else:
                blocks = blocks_of(size, shard)
                mixed = (ids.astype(np.uint64) ^ np.uint64(zlib.crc32(cell.encode()))) * np.uint64(0x9E3779B97F4A7C15)
                own = (mixed >> np.uint64(33)).astype(np.int64) % blocks
                row = np.repeat(np.arange(len(ids)), blocks - 1)
                names = [f"{cell}#{min(i, j)}-{max(i, j)}" for i in own.tolist() for j in range(blocks) if i != j]
            taken = some.select(["vec_id", "v", "times"]).take(pa.array(row))
            return pa.table({"cell": pa.array(names, pa.string()), **{c: taken.column(c) for c in ("vec_id", "v", "times")}})

        cut = large.groupBy("cell", "part").cogroup(pivots.groupBy("cell", "part")).applyInArrow(split, "cell string, vec_id long, v array<double>, times long")
        members = saved(cut, "members")
    for part in done:
        members = members.unionByName(part)
    return members


def vector_links(classes: DataFrame, least: float, shard: int, routes: int | None, degree: int, beam: int) -> DataFrame:
    """vec_id, n and m (vectors and classes, other than its own, linked), v (edges of a spanning forest) from all shards of classes."""
    members = saved(cells_of(classes, shard, least, routes), "members")
    own_cells = members.groupBy("vec_id").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    members = saved(members.join(own_cells, "vec_id").select("cell", "vec_id", "v", "times", "cells"), "members")

    def build(t: pa.Table) -> pa.Table:
        ids, adj = t.column("vec_id").to_numpy(), pruned_graph(vectors_of(t), degree, max(NEAR, 2 * degree))
        return pa.table({"vec_id": pa.array(ids), "near": pa.array([ids[row[row >= 0]] for row in adj], pa.list_(pa.int64()))})

    edges = members.select("cell", "vec_id", "v").groupBy("cell").applyInArrow(build, "vec_id long, near array<long>")
    united = saved(edges.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

    def search(t: pa.Table) -> pa.Table:
        ids, v = t.column("vec_id").to_numpy(), vectors_of(t)
        by = np.argsort(ids)
        ids, v, times = ids[by], v[by], t.column("times").to_numpy()[by]
        cells, cell = [t.column("cells")[int(i)].as_py() for i in by], t.column("cell")[0].as_py()
        near = [np.asarray(t.column("near")[int(i)].as_py(), np.int64) for i in by]
        adj = np.full((len(ids), max(1, max(map(len, near)))), -1, np.int64)
        for i, x in enumerate(near):
            at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
            x = at[ids[at] == x]  # of the united list, what this shard holds
            adj[i, : len(x)] = x
        q, x = in_range(v, adj, least, beam)
        from rasterloom.llm.jaccard_join import forest

        tree = np.zeros((2, 0), np.int64)
        for lo in range(0, len(q), 500_000):  # a part of the pairs at a time: forest() makes objects of them
            part = np.stack([q[lo : lo + 500_000], x[lo : lo + 500_000]])
            tree = np.array(forest(len(ids), *np.concatenate([tree, part[:, part[0] < part[1]]], axis=1)), np.int64).reshape(-1, 2).T
        links = dict(tree.T.tolist())
        # a pair that several shards hold counts in the first of them
        kinds: dict[tuple, int] = {}
        kind = np.array([kinds.setdefault(tuple(c), len(kinds)) for c in cells], np.int64)
        sets = [set(c) for c in kinds]
        both, where = np.unique(kind[q] * len(sets) + kind[x], return_inverse=True)
        first = np.array([min(sets[k // len(sets)] & sets[k % len(sets)]) == cell for k in both.tolist()], bool)
        mine = first[where]
        n = np.bincount(q[mine], times[x[mine]], len(ids)).astype(np.int64)
        m = np.bincount(q[mine], minlength=len(ids))
        return pa.table({"vec_id": pa.array(ids), "n": pa.array(n), "m": pa.array(m, pa.int64()), "v": pa.array([int(ids[links.get(i, i)]) for i in range(len(ids))], pa.int64())})

    return members.join(united, "vec_id").groupBy("cell").applyInArrow(search, "vec_id long, n long, m long, v long")


def audited(classes: DataFrame, counted: DataFrame, least: float) -> float:
    """Links found of those that there are, for classes drawn by hash against all classes of their labels.

    The lesser of two shares: of the vectors that AUDITED classes link with, and of the classes that
    those of LONELY with at most FEW neighbours do, whom the links of large groups would outweigh.
    """
    rows = classes.join(counted, "vec_id").orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(AUDITED).select("cell", "v", "times", "n", "m").collect()
    lonely = counted.where(F.col("m") <= FEW)  # what has few neighbours has no more of them found
    drawn = range(len(rows))
    rows += classes.join(lonely, "vec_id").orderBy(F.xxhash64("vec_id", F.lit(6)), "vec_id").limit(LONELY).select("cell", "v", "times", "n", "m").collect()
    asked: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        asked.setdefault(r["cell"], []).append(i)
    queries = classes.sparkSession.sparkContext.broadcast({cell: (own, np.array([rows[i]["v"] for i in own])) for cell, own in asked.items()})

    def count(batches):
        for batch in batches:
            cells, times = np.array(batch.column("cell").to_pylist(), object), batch.column("times").to_numpy()
            for cell in dict.fromkeys(cells):
                if cell not in queries.value:
                    continue
                at = np.flatnonzero(cells == cell)
                own, q = queries.value[cell]
                v = vectors_of(batch.take(pa.array(at)))  # vectors of a cell have one length
                near = [q[k : k + 128] @ v.T >= least for k in range(0, len(own), 128)]
                n, m = (np.concatenate([x @ w for x in near]).astype(np.int64) for w in (times[at], np.ones(len(at), np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(n), pa.array(m)], ["i", "n", "m"])

    sums = classes.select("cell", "v", "times").mapInArrow(count, "i long, n long, m long").groupBy("i").agg(F.sum("n"), F.sum("m"))
    there = {r[0]: (r[1] - rows[r[0]]["times"], r[2] - 1) for r in sums.collect()}  # without its own class
    few = [i for i in range(len(drawn), len(rows)) if 0 < there[i][1] <= FEW]
    shares = [1.0]
    for found, true in (
        (sum(min(rows[i]["n"], there[i][0]) for i in drawn), sum(there[i][0] for i in drawn)),
        (sum(min(rows[i]["m"], there[i][1]) for i in few), sum(there[i][1] for i in few)),
    ):
        if true > 0:
            shares.append(found / true)
    return min(shares)


def vector_near_dups(vectors: DataFrame, least: float = 0.93, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal and the cosine is at least `least`. Null or zero vectors,
    null or non-finite components and null labels link with nothing; vectors meet only vectors of
    their own length. Repeated rows are vectors of their own. A null vec_id cannot be named: the row
    links with nothing and its component is null. Other columns are not looked at. An empty table
    gives an empty result. No pair below `least` is linked; a pair that sharding parts or the graph does
    not lead to may be missed, which the audit bounds: if the widest try finds less than TARGET of what
    the audit's queries link with, this raises RuntimeError.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.expr("transform(embedding, x -> cast(x AS double))").alias("v"), F.col("label").cast("string").alias("label"))
    good = rows.where(usable(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # by the largest component first, so that no square is too large or too small
    good = good.withColumn("_m", F.array_max(F.transform("v", F.abs))).where("_m > 0").withColumn("v", F.transform("v", lambda x: x / F.col("_m")))
    good = good.withColumn("_n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    good = good.select("vec_id", F.transform("v", lambda x: x / F.col("_n")).alias("v"), F.concat_ws("|", "label", F.size("v")).alias("cell"))
    good = saved(good, "vectors")
    classes = saved(good.groupBy("cell", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times")), "classes").select("cell", "vec_id", "v", "times")
    degree, beam = DEGREE, BEAM
    for routes in ROUTES:
        found = saved(vector_links(classes, least, shard, routes, degree, beam), "links")
        counted = found.groupBy("vec_id").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
        recall = audited(classes, counted, least)
        if recall >= TARGET:
            break
        degree, beam = 2 * degree, 2 * beam
    else:
        raise RuntimeError(f"vector_near_dups: the audit's recall is {recall:.4f} after the widest try; the target is {TARGET}")
    labels = components(found.select(F.col("vec_id").alias("u"), "v"))
    named = classes.join(counted, "vec_id").join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    named = saved(named.select("cell", F.col("v").alias("_v"), (F.col("n") + F.col("times") - 1).alias("n_links"), F.coalesce("label", "vec_id").alias("component_id")), "named")
    # both sides are tables: a vector that a third of all rows have is split by the join itself
    of_rows = good.join(named, (good["cell"] == named["cell"]) & (good["v"] == named["_v"])).select("vec_id", "n_links", "component_id")
    bad = rows.join(of_rows.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_rows.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_vector_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near_dups(table(spark, sf_dir, "embeddings"))


#: By all pairs of a label. vec_id is unique in the driver's embeddings.
OP5_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: cast(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.v, r.root FROM r JOIN l ON r.vec_id = l.u),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u AS vec_id, count(*) AS n FROM l GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
