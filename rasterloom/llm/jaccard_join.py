"""N-gram Jaccard join by prefixes under several global token orders.

1. Each document's set of word shingles becomes sorted hashes. Equal sets form a class, represented
   by the smallest id; from here on only representatives count.
2. Frequencies of all shingles (by 40-bit cell) are counted over all documents, summed by task before
   they are sent, so that a cell of very many documents is no one task's work. Frequent cells, at most
   HOT_CELLS by the choice of the threshold, are broadcast.
3. Under an order (rare before frequent; frequent ones by frequency or by hash, ties and rare ones by one
   of several hashes), two sets that are similar enough share a token within their prefixes, and at their
   first shared token enough of both sets is left. Pairs of one posting list that pass the size and
   position bounds are candidates of the order. A list of a rare cell has a bounded length. Candidates of
   all orders are intersected: sets that share a rare shingle share their first one of every order.
4. Sets whose prefix reaches frequent cells have families under each order: components over frequent
   prefix cells shared by sets of near enough sizes. Only sets of one family under every order are
   compared: the families of all orders are intersected, too. What is left is compared as a whole, in
   blocks of bounded size, without a row for a pair.
5. Candidates are verified on whole sets that were sent once to each task that needs them. Tasks
   return a spanning forest of their links, and components are found over those.

No link between different sets is lost: every step's bound is a necessary condition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import drop_saved, lean, lean_group, partitions, saved, table
from rasterloom.llm.components import components
from rasterloom.llm.shingles import Shingler, mixed

#: Bits of a cell, least frequency of a frequent cell, most frequent cells, odd factors of the hash orders.
CELL_BITS, HOT, HOT_CELLS = 40, 32, 1 << 20
ORDERS = (0x1, 0x9E3779B97F4A7C15)
#: Pairs that one verifying task gets, sets of one block of a family, shingles that a counting task sorts at a time.
TASK_PAIRS, BLOCK, SORTED = 1024, 1024, 1_000_000


def packed(x: np.ndarray, width: int) -> bytes:
    """Whole numbers by byte planes: leading zero bytes then vanish when Spark compresses a shuffle."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def cells(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - CELL_BITS)


def bucket_edges(sorted_cells: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of the equal ranges of cells begins."""
    return np.searchsorted(sorted_cells, (np.arange(buckets + 1, dtype=np.float64) * ((1 << CELL_BITS) / buckets)).astype(np.uint64))


class Bound:
    """Jaccard of at least num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, a, b):
        return -(-self.num * (a + b) // (self.num + self.den))

    def sizes(self, a, b):
        return self.num * np.maximum(a, b) <= self.den * np.minimum(a, b)


def prefix_of(hashes: np.ndarray, order: int, length: int, hot: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, int]:
    """The first cells under an order, and how many of them are not frequent."""
    own = cells(hashes)
    at = np.minimum(np.searchsorted(hot, own), max(0, len(hot) - 1))
    often = hot[at] == own if len(hot) else np.zeros(len(own), bool)
    keyed = mixed(hashes * np.uint64(order)) if order != 1 else hashes
    rare = np.flatnonzero(~often)
    if len(rare) > length:
        rare = rare[np.argpartition(keyed[rare], length)[:length]]
    rare = rare[np.argsort(keyed[rare])]
    found = own[rare]
    if len(rare) < length:
        more = np.flatnonzero(often)
        by = np.lexsort((keyed[more], freq[at[more]])) if order == ORDERS[0] else np.argsort(keyed[more])
        more = more[by][: length - len(rare)]
        found = np.concatenate([found, own[more]])
    return found, len(rare)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (x, root) of a spanning forest of links a-b between 0..n-1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in range(n) if (r := root(x)) != x]


def linked_in(sets: list[np.ndarray], bound: Bound) -> list[tuple[int, int]]:
    """Spanning forest of all links within a list of sets, by counting shared tokens over posting lists."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    edge = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
    ends = np.r_[edge[1:], len(tokens)]
    where = np.empty(len(tokens), np.int64)
    where[order] = np.repeat(np.arange(len(edge)), ends - edge)
    starts = np.cumsum(size) - size
    a, b = [], []
    for i in range(n):
        lists = where[starts[i] : starts[i] + size[i]]
        lists = lists[ends[lists] - edge[lists] > 1]
        if not len(lists):
            continue
        shared = np.zeros(n, np.int64)
        for lo in range(0, len(lists), 4096):
            part = lists[lo : lo + 4096]
            count = ends[part] - edge[part]
            at = np.repeat(edge[part] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            shared += np.bincount(owner[at], minlength=n)
        j = np.flatnonzero(shared[:i])
        j = j[bound.den * shared[j] >= bound.num * (size[i] + size[j] - shared[j])]
        a.append(np.full(len(j), i))
        b.append(j)
    return forest(n, np.concatenate(a), np.concatenate(b)) if a else []


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text).

    Documents link when den * |intersection| >= num * |union| of their shingle sets; component_id is
    the smallest doc_id reachable, itself included. Null, empty and blank texts have no shingle and
    link with nothing. Rows of one id are taken to have one text; each is a row of the result. A null doc_id
    cannot be named: the row has its n_shingles and a null component, and links nothing. Other
    columns are not looked at. An empty table gives an empty result. Shingles are compared as 64-bit
    hashes.
    """
    spark = docs.sparkSession
    bound = Bound(num, den)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = 4 * partitions(docs)

    # 2: packed cells of all documents, by range of cells
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(words), [], 0

        def flushed() -> pa.RecordBatch:
            own = np.sort(np.concatenate(held))
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            times, own = np.diff(np.r_[begin, len(own)]), own[begin]
            edges = bucket_edges(own, buckets)
            full = np.flatnonzero(np.diff(edges))
            blobs, again = [], []
            for k in full:
                part = slice(edges[k], edges[k + 1])
                blobs.append(packed(np.diff(own[part], prepend=np.uint64(0)), 5))
                several = np.flatnonzero(times[part] > 1)  # few: where, and how often
                again.append(packed(several, 4) + packed(times[part][several], 4))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary()), pa.array(again, pa.binary())], ["bucket", "cells", "again"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(cells(shingler.set_of(text)))
                size += len(held[-1])
                if size >= SORTED:
                    yield flushed()
                    held, size = [], 0
        if size:
            yield flushed()

    def frequent(t: pa.Table) -> pa.Table:
        own = np.concatenate([np.cumsum(unpacked(c.as_py(), 5), dtype=np.uint64) for c in t.column("cells")])
        times, at = np.ones(len(own), np.int64), 0
        for cell, again in zip(t.column("cells"), t.column("again")):
            data = again.as_py()
            several, n = unpacked(data[: len(data) // 2], 4).astype(np.int64), unpacked(data[len(data) // 2 :], 4)
            times[at + several] = n
            at += len(cell.as_py()) // 5
        # most cells are there once and go; of those of several blocks and those counted before, the sums
        by = np.argsort(own)
        own, times = own[by], times[by]
        edge = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        count = np.add.reduceat(times, edge)
        hot = count > HOT
        return pa.table({"cell": pa.array(own[edge[hot]].astype(np.int64)), "n": pa.array(count[hot].astype(np.int64))})

    scanned = docs.select("text").mapInArrow(lean(scan), "bucket int, cells binary, again binary")
    counted = saved(scanned.groupBy("bucket").applyInArrow(lean_group(frequent), "cell long, n long"), "frequent")
    # the threshold is the least power of two from HOT on that keeps the broadcast below HOT_CELLS entries of 16 bytes
    sizes = counted.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).count().collect()
    floor = HOT
    while sum(r["count"] for r in sizes if 1 << r["b"] >= floor or floor == HOT) > HOT_CELLS:
        floor *= 2
    chosen = counted.where(F.col("n") >= floor).toArrow()
    by_cell = np.argsort(chosen.column("cell").to_numpy())
    hot = spark.sparkContext.broadcast((chosen.column("cell").to_numpy()[by_cell].astype(np.uint64), chosen.column("n").to_numpy()[by_cell]))

    # 1, 3: per document its size, two sums that identify its set, and its prefix under each order
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, (cell, freq) = Shingler(words), hot.value
        for batch in batches:
            got = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingler.set_of(text)
                one, two = (int(mixed(s ^ np.uint64(x)).sum(dtype=np.uint64)) - (1 << 63) for x in (0, 0x5851F42D4C957F2D))
                found = [prefix_of(s, o, bound.prefix(len(s)) if len(s) else 0, cell, freq) for o in ORDERS]
                got.append((doc, len(s), one, two, found[0][1], len(found[0][0]), *(packed(f[0], 5) for f in found)))
            cols = list(zip(*got)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    names = ["doc_id", "n", "fp1", "fp2", "rare", "all", *(f"p{k}" for k in range(len(ORDERS)))]
    kinds = [*[pa.int64()] * 6, *[pa.binary()] * len(ORDERS)]
    scanned = saved(docs.mapInArrow(lean(prefixes), ", ".join(f"`{n}` {'binary' if n[0] == 'p' else 'long'}" for n in names)), "prefixes")
    rows = scanned.select("doc_id", "n", "fp1", "fp2")
    full = scanned.where("doc_id is not null and n > 0")
    classes = saved(full.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # both sides are tables: a set that a third of all documents have is split by the join itself
    rep_of = saved(full.select("doc_id", "fp1", "fp2", "n").join(classes, ["fp1", "fp2", "n"]).select("doc_id", "rep").distinct(), "reps")

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rare, ids = (batch.column(k).to_numpy().astype(np.int64) for k in ("n", "rare", "doc_id"))
            for order in range(len(ORDERS)):
                parts = [unpacked(b.as_py(), 5)[:r] for b, r in zip(batch.column(f"p{order}"), rare)]
                if not parts:
                    continue
                own = np.concatenate(parts)
                row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                pos = np.concatenate([np.arange(len(p)) for p in parts])
                by = np.argsort(own, kind="stable")
                own, row, pos = own[by], row[by], pos[by]
                edges = bucket_edges(own, buckets)
                full = np.flatnonzero(np.diff(edges))
                cut = [slice(edges[k], edges[k + 1]) for k in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(full), order), pa.int32()), pa.array(full, pa.int32()),
                        *(pa.array(x, pa.binary()) for x in ([packed(np.diff(own[c], prepend=np.uint64(0)), 5) for c in cut], [packed(ids[row[c]], 8) for c in cut], [packed(size[row[c]], 4) for c in cut], [packed(pos[c], 4) for c in cut])),
                    ],
                    ["o", "bucket", "cells", "ids", "sizes", "pos"],
                )

    def candidates(t: pa.Table) -> pa.Table:
        read = lambda k, w: [unpacked(x.as_py(), w) for x in t.column(k)]
        own = np.concatenate([np.cumsum(c, dtype=np.uint64) for c in read("cells", 5)])
        ids, size, pos = (np.concatenate(read(k, w)).astype(np.int64) for k, w in (("ids", 8), ("sizes", 4), ("pos", 4)))
        by = np.argsort(own, kind="stable")
        own, ids, size, pos = own[by], ids[by], size[by], pos[by]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        length = np.diff(np.r_[first, len(own)])
        place = np.arange(len(own)) - np.repeat(first, length)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for step in range(1, int(length.max(initial=1))):  # each row with the one `step` places before in its list
            x = np.flatnonzero(place >= step)
            y = x - step
            good = bound.sizes(size[x], size[y]) & (ids[x] != ids[y])
            good &= 1 + np.minimum(size[x] - pos[x], size[y] - pos[y]) - 1 >= bound.overlap(size[x], size[y])
            a.append(np.minimum(ids[x], ids[y])[good])
            b.append(np.maximum(ids[x], ids[y])[good])
        pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        o = t.column("o")[0].as_py()
        return pa.table({"o": pa.array(np.full(len(pair), o), pa.int32()), "a": pa.array(pair[:, 0]), "b": pa.array(pair[:, 1])})

    posted = full.select("doc_id", "n", "rare", *names[6:]).where("rare > 0").mapInArrow(lean(postings), "o int, bucket int, cells binary, ids binary, sizes binary, pos binary")
    # a list of a rare cell has no more rows than the cell has documents, copies included
    found = posted.groupBy("o", "bucket").applyInArrow(lean_group(candidates), "o int, a long, b long")
    pairs = found.groupBy("a", "b").agg(F.expr("bit_or(shiftleft(1, o)) AS orders")).where(F.col("orders") == (1 << len(ORDERS)) - 1)
    by = lambda k: rep_of.select(F.col("doc_id").alias(k), F.col("rep").alias(f"r{k}"))
    pairs = pairs.join(by("a"), "a").join(by("b"), "b").where("ra <> rb")
    pairs = saved(pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "pairs")
    # sets whose prefix reaches frequent cells: what they share may be frequent cells only, under any order
    reaching = full.where(F.col("all") > F.col("rare")).select("doc_id", "n", "rare", *names[6:])
    families = family_blocks(reaching.join(rep_of.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi"), bound)
    tasks = max(1, -(-pairs.count() // TASK_PAIRS))
    pairs = pairs.withColumn("task", F.pmod(F.xxhash64("a"), F.lit(tasks)).cast("string"))
    needs = pairs.select("task", F.explode(F.array("a", "b")).alias("doc_id")).distinct().union(families)
    needs = saved(needs.groupBy("doc_id").agg(F.collect_list("task").alias("tasks")), "needs")

    # 4, 5: whole sets, once to each task that needs them
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for doc, text, tasks in zip(*(c.to_pylist() for c in batch.columns)):
                data = shingler.set_of(text).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(tasks), pa.array([doc] * len(tasks), pa.int64()), pa.array([data] * len(tasks), pa.binary())], ["task", "doc_id", "tokens"])

    given = docs.join(needs, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "tasks").mapInArrow(lean(sets), "task string, doc_id long, tokens binary")

    def verified(p: pa.Table, s: pa.Table) -> pa.Table:
        ids = s.column("doc_id").to_numpy()
        by = np.argsort(ids)
        ids, own = ids[by], [np.frombuffer(s.column("tokens")[int(i)].as_py(), np.uint64) for i in by]
        if p.num_rows:
            x, y = (np.searchsorted(ids, p.column(k).to_numpy()) for k in ("a", "b"))
            ok = []
            for i, j in zip(x.tolist(), y.tolist()):
                shared = len(np.intersect1d(own[i], own[j], assume_unique=True))
                ok.append(bound.den * shared >= bound.num * (len(own[i]) + len(own[j]) - shared))
            links = forest(len(ids), x[np.array(ok, bool)], y[np.array(ok, bool)])
        else:
            links = linked_in(own, bound)
        return pa.table({k: pa.array([int(ids[e[i]]) for e in links], pa.int64()) for i, k in enumerate(("u", "v"))})

    links = pairs.groupBy("task").cogroup(given.groupBy("task")).applyInArrow(lean_group(verified), "u long, v long")
    labels = saved(components(links), "labels")
    named_by = saved(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", "n", F.coalesce("label", "rep").alias("component_id")), "named")
    joined = rows.join(named_by, ["fp1", "fp2", "n"], "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def families(members: DataFrame, cells: str, bound: Bound) -> DataFrame:
    """node, label of members (doc_id, n, rare and a column of cells): components over frequent prefix cells.

    Sets that may be similar have sizes of one class or of two next to each other; a cell joins sets within
    two such classes only, each set being listed under its own class and the one above.
    """
    ratio = math.log(bound.den / bound.num) if bound.num < bound.den else 1.0

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [unpacked(c.as_py(), 5)[r:] for c, r in zip(batch.column(2), batch.column(3).to_pylist())]
            each = [len(c) for c in own]
            kind = np.floor(np.log(batch.column(1).to_numpy()) / ratio + 1e-9).astype(np.int64)
            ids, kind = np.repeat(batch.column(0).to_numpy(), each), np.repeat(kind, each)
            cell = np.concatenate(own).astype(np.int64) if own else ids
            for up in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cell), pa.array(kind + up, pa.int64())], ["doc_id", "cell", "kind"])

    lists = saved(members.select("doc_id", "n", cells, "rare").mapInArrow(listed, "doc_id long, cell long, kind long"), "hot-lists")
    heads = saved(lists.groupBy("cell", "kind").agg(F.min("doc_id").alias("head")), "heads")
    found = saved(components(lists.join(heads, ["cell", "kind"]).select(F.col("doc_id").alias("u"), F.col("head").alias("v"))), "families")
    drop_saved(lists, heads)
    return found


def family_blocks(members: DataFrame, bound: Bound) -> DataFrame:
    """task, doc_id: the blocks in which members (doc_id, n, rare, cells of each order) of each family are compared.

    A family is what has one label under every order. One of up to BLOCK members is one task; a larger
    one is cut into blocks, and each two of them are a task.
    """
    members = saved(members, "reaching")
    labels = [families(members, f"p{k}", bound).withColumnRenamed("label", f"l{k}") for k in range(len(ORDERS))]
    family = labels[0]
    for more in labels[1:]:
        family = family.join(more, "node")
    family = saved(family.select("node", F.concat_ws(":", *(f"l{k}" for k in range(len(ORDERS)))).alias("label")), "family")
    sizes = saved(family.groupBy("label").agg(F.count("*").alias("members")).where("members > 1").withColumn("blocks", F.ceil(F.col("members") / BLOCK)), "sizes")
    placed = family.join(sizes, "label").withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # a member of block i is in the task of blocks i and j for every other j
    return placed.withColumn("j", F.explode(F.expr("sequence(0L, blocks - 1)"))).where("i <> j or blocks = 1").select(
        F.concat_ws(":", F.lit("f"), "label", F.least("i", "j"), F.greatest("i", "j")).alias("task"), F.col("node").alias("doc_id")
    )


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


#: By all pairs that share a shingle; components by steps from every document. doc_id is unique in the driver's documents.
OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.v, r.root FROM r JOIN l ON r.doc_id = l.u),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
"""
