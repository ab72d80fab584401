"""The queries over the supplied tables, and the SQL that checks them.

Each embedding is read as a grid of 8 x 8 samples from 0 to 255; its vec_id is the frame's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.functions.keys import TRANSFORMS
from rasterloom.operators.grid import at, filtered, listed, rekeyed, restored, scrambled, with_layout
from rasterloom.sources.png import ADAM7

SIDE = 8
KEY = b"demo key"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
PX = """px AS (SELECT vec_id, cast(i - 1 AS INTEGER) AS idx,
  cast(least(255, greatest(0, floor(cast(embedding[i] AS DOUBLE) * 127 + 128))) AS INTEGER) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grids(spark: SparkSession, d: str) -> DataFrame:
    value = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 127 + 128))).cast("int")
    return read(spark, d, "embeddings").select("vec_id", F.transform("embedding", value).alias("g"))


@query(f"WITH {PX} SELECT vec_id, idx, idx % 8 AS x, idx // 8 AS y, v FROM px")
def grid_pixels(spark, d):
    return listed(grids(spark, d), F.col("g"), "vec_id").select("vec_id", "idx", (F.col("idx") % SIDE).alias("x"), F.expr("cast(idx div 8 AS int)").alias("y"), "v")


def lines():
    return W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def differences(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").withColumn("diff", (F.col("l_quantity") - F.lag("l_quantity", 1, 0).over(lines())).cast("long"))


def roundtrip(spark, d, mode="pixel", block=0):
    f = with_layout(grids(spark, d), KEY, "vec_id", SIDE, SIDE, mode, block)
    return listed(f, restored(scrambled(F.col("g"), F.col("layout")), F.col("layout")), "vec_id")


@query(f"WITH {PX} SELECT vec_id, idx, v FROM px")
def scramble_roundtrip(spark, d):
    return roundtrip(spark, d)


@query(f"WITH {PX} SELECT vec_id, idx, v FROM px")
def block_roundtrip(spark, d):
    return roundtrip(spark, d, "block", 3 | TRANSFORMS)


@query(f"WITH {PX} SELECT vec_id, idx, v FROM px")
def rekey_roundtrip(spark, d):
    f = with_layout(with_layout(grids(spark, d), KEY, "vec_id", SIDE, SIDE), b"new key", "vec_id", SIDE, SIDE, name="other")
    again = rekeyed(scrambled(F.col("g"), F.col("layout")), F.col("layout"), F.col("other"))
    return listed(f, restored(again, F.col("other")), "vec_id")


@query(f"WITH {PX} SELECT v, count(*) AS n FROM px GROUP BY v")
def scramble_histogram(spark, d):
    f = with_layout(grids(spark, d), KEY, "vec_id", SIDE, SIDE)
    return listed(f, scrambled(F.col("g"), F.col("layout")), "vec_id").groupBy("v").agg(F.count("*").alias("n"))


@query(f"""WITH {PX} SELECT vec_id, idx, CASE WHEN idx % 8 < 6 AND idx // 8 < 6 THEN (idx // 8 // 3) * 2 + idx % 8 // 3 ELSE -1 END AS tile FROM px""")
def tile_index(spark, d):
    inside = (F.col("idx") % 8 < 6) & (F.expr("idx div 8") < 6)
    return listed(grids(spark, d), F.col("g"), "vec_id").select("vec_id", "idx", F.when(inside, F.expr("(idx div 8 div 3) * 2 + idx % 8 div 3")).otherwise(-1).cast("int").alias("tile"))


@query("""SELECT p_partkey, p_size AS width, coalesce(max(b) FILTER ((p_size // b) * (p_size // b) = 0 OR (p_size // b) * (p_size // b) >= 8), 0) AS tile
FROM part, range(2, 17) t(b) GROUP BY p_partkey, p_size""")
def fit_tile_size(spark, d):
    fits = F.expr("array_max(filter(sequence(2, 16), b -> (p_size div b) * (p_size div b) = 0 OR (p_size div b) * (p_size div b) >= 8))")
    return read(spark, d, "part").select("p_partkey", F.col("p_size").alias("width"), F.coalesce(fits, F.lit(0)).cast("long").alias("tile"))


@query(f"""WITH {PX} SELECT vec_id, o, y * 8 + x AS idx, v FROM (SELECT vec_id, o, v,
 CASE o WHEN 1 THEN x WHEN 2 THEN 7 - x WHEN 3 THEN 7 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 7 - y WHEN 7 THEN 7 - y ELSE y END AS x,
 CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 7 - y WHEN 4 THEN 7 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 7 - x ELSE 7 - x END AS y
 FROM (SELECT vec_id, v, cast(vec_id % 8 + 1 AS INTEGER) AS o, idx % 8 AS x, idx // 8 AS y FROM px))""")
def orientation_map(spark, d):
    o = (F.col("vec_id") % 8 + 1).cast("int")
    p = listed(grids(spark, d).withColumn("o", o), F.col("g"), "vec_id", "o").selectExpr("vec_id", "o", "v", "idx % 8 AS x", "idx div 8 AS y")
    return p.selectExpr("vec_id", "o", """cast(if(o IN (1, 2, 5, 6), if(o < 5, y, x), 7 - if(o < 5, y, x)) * 8 + if(o IN (1, 4, 5, 8), if(o < 5, x, y), 7 - if(o < 5, x, y)) AS int) AS idx""", "v")


def _filter_sql(guess: str) -> str:
    return f"""WITH {PX}, n AS (SELECT vec_id, idx, v,
  CASE WHEN idx % 8 > 0 THEN lag(v, 1, 0) OVER w ELSE 0 END AS a, lag(v, 8, 0) OVER w AS b,
  CASE WHEN idx % 8 > 0 THEN lag(v, 9, 0) OVER w ELSE 0 END AS c FROM px WINDOW w AS (PARTITION BY vec_id ORDER BY idx))
SELECT vec_id, idx, cast((v - ({guess}) + 512) % 256 AS INTEGER) AS f FROM n"""


PAETH = "CASE WHEN abs(b - c) <= abs(a - c) AND abs(b - c) <= abs(a + b - 2 * c) THEN a WHEN abs(a - c) <= abs(a + b - 2 * c) THEN b ELSE c END"
GUESSES = {"none": "0", "sub": "a", "up": "b", "average": "(a + b) // 2", "paeth": PAETH}
for _kind in ("sub", "up", "average", "paeth"):

    def _f(spark, d, kind=_kind):
        return listed(grids(spark, d), filtered(F.col("g"), kind, SIDE), "vec_id", name="f")

    QUERIES[f"png_filter_{_kind}"], ORACLES[f"png_filter_{_kind}"] = _f, _filter_sql(GUESSES[_kind])


@query(f"""WITH {PX}, n AS (SELECT vec_id, idx, v, CASE WHEN idx % 8 > 0 THEN lag(v, 1, 0) OVER w ELSE 0 END AS a, lag(v, 8, 0) OVER w AS b,
  CASE WHEN idx % 8 > 0 THEN lag(v, 9, 0) OVER w ELSE 0 END AS c FROM px WINDOW w AS (PARTITION BY vec_id ORDER BY idx)),
k AS (SELECT vec_id, idx // 8 AS y, k, (v - (CASE k WHEN 0 THEN 0 WHEN 1 THEN a WHEN 2 THEN b WHEN 3 THEN (a + b) // 2 ELSE {PAETH} END) + 512) % 256 AS f FROM n, range(0, 5) t(k)),
s AS (SELECT vec_id, y, k, sum(least(f, 256 - f)) AS sad FROM k GROUP BY ALL)
SELECT vec_id, y, cast(min(sad) AS BIGINT) AS sad, cast(arg_min(k, sad * 8 + k) AS INTEGER) AS filter FROM s GROUP BY vec_id, y""")
def png_filter_pick(spark, d):
    cost = lambda kind: F.transform(filtered(F.col("g"), kind, SIDE), lambda f: F.least(f, 256 - f).cast("long"))
    f = grids(spark, d).select("vec_id", *(cost(k).alias(k) for k in GUESSES))
    total = lambda k: F.expr(f"aggregate(slice({k}, y * 8 + 1, 8), 0L, (s, x) -> s + x)")
    rows = f.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(7))))
    best = F.least(*(F.struct(total(k).alias("sad"), F.lit(i).alias("filter")) for i, k in enumerate(GUESSES)))
    return rows.select("vec_id", F.col("y").cast("long").alias("y"), best.alias("b")).select("vec_id", "y", "b.sad", "b.filter")


@query(f"WITH {PX} SELECT vec_id, idx, v FROM px")
def png_unfilter_sub(spark, d):
    f = grids(spark, d).select("vec_id", filtered(F.col("g"), "sub", SIDE).alias("f"))
    return listed(f, F.expr("transform(f, (v, i) -> cast(aggregate(slice(f, cast(i - i % 8 + 1 AS int), i % 8 + 1), 0, (s, x) -> s + x) % 256 AS int))"), "vec_id")


@query(f"WITH {PX} SELECT vec_id, idx, v FROM px")
def png_unfilter_up(spark, d):
    f = grids(spark, d).select("vec_id", filtered(F.col("g"), "up", SIDE).alias("f"))
    return listed(f, F.expr("transform(f, (v, i) -> cast(aggregate(transform(sequence(0, cast(i div 8 AS int)), y -> f[y * 8 + i % 8]), 0, (s, x) -> s + x) % 256 AS int))"), "vec_id")


_PASSES = "(VALUES " + ", ".join(f"({i + 1}, {a}, {b}, {c}, {e})" for i, (a, b, c, e) in enumerate(ADAM7)) + ") p(pass, x0, y0, dx, dy)"


def passes(spark, d):
    p = spark.createDataFrame([(i + 1, *p) for i, p in enumerate(ADAM7)], "pass int, x0 int, y0 int, dx int, dy int")  # seven rows
    sizes = read(spark, d, "part").selectExpr("p_partkey", "p_size AS w", "p_size + 3 AS h")
    return sizes.crossJoin(F.broadcast(p)).selectExpr("p_partkey", "pass", "greatest(0, (w - x0 + dx - 1) div dx) AS pw", "greatest(0, (h - y0 + dy - 1) div dy) AS ph")


_PASS_SQL = f"SELECT p_partkey, pass, greatest(0, (p_size - x0 + dx - 1) // dx) AS pw, greatest(0, (p_size + 3 - y0 + dy - 1) // dy) AS ph FROM part, {_PASSES}"


@query(f"SELECT p_partkey, pass, cast(pw AS BIGINT) AS pw, cast(ph AS BIGINT) AS ph FROM ({_PASS_SQL})")
def adam7_passes(spark, d):
    return passes(spark, d).selectExpr("p_partkey", "pass", "cast(pw AS long) AS pw", "cast(ph AS long) AS ph")


@query(f"SELECT p_partkey, cast(sum(CASE WHEN pw > 0 THEN ph * (1 + pw * 3) ELSE 0 END) AS BIGINT) AS raw_size FROM ({_PASS_SQL}) GROUP BY p_partkey")
def png_raw_size(spark, d):
    return passes(spark, d).groupBy("p_partkey").agg(F.sum(F.expr("if(pw > 0, ph * (1 + pw * 3), 0)")).cast("long").alias("raw_size"))


@query(f"WITH {PX} SELECT vec_id, cast((((64 + sum((64 - idx) * v)) % 65521) * 65536 + (1 + sum(v)) % 65521) AS BIGINT) AS adler FROM px GROUP BY vec_id")
def adler32(spark, d):
    return grids(spark, d).selectExpr("vec_id", "(((64 + aggregate(transform(g, (v, i) -> cast((64 - i) * v AS long)), 0L, (s, x) -> s + x)) % 65521) * 65536 + (1 + aggregate(g, 0L, (s, x) -> s + x)) % 65521) AS adler")


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def sha256_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"WITH {PX}, f AS (SELECT vec_id, v, min(idx) AS first_idx, count(*) AS n FROM px GROUP BY vec_id, v) SELECT vec_id, v, n, cast(row_number() OVER (PARTITION BY vec_id ORDER BY first_idx) - 1 AS INTEGER) AS slot FROM f")
def palette_order(spark, d):
    f = grids(spark, d).select("vec_id", "g", F.posexplode(F.array_distinct("g")).alias("slot", "v"))
    return f.select("vec_id", "v", F.expr("cast(size(filter(g, x -> x = v)) AS long)").alias("n"), "slot")


@query(f"WITH {PX} SELECT vec_id, bool_and(v % 17 = 0) AS four_bit, bool_and(v IN (0, 255)) AS one_bit, bool_and(v >= 128) AS bright FROM px GROUP BY vec_id")
def grey_flags(spark, d):
    return grids(spark, d).selectExpr("vec_id", "forall(g, v -> v % 17 = 0) AS four_bit", "forall(g, v -> v IN (0, 255)) AS one_bit", "forall(g, v -> v >= 128) AS bright")


@query(f"WITH {PX} SELECT vec_id, idx, cast((v * 257 * 255 + 32895) // 65536 AS INTEGER) AS narrow, cast((v * (idx * 4) + 255 * (255 - idx * 4) + 127) // 255 AS INTEGER) AS flat FROM px")
def sample_depth_and_alpha(spark, d):
    return listed(grids(spark, d), F.col("g"), "vec_id").selectExpr("vec_id", "idx", "cast((v * 257 * 255 + 32895) div 65536 AS int) AS narrow", "cast((v * (idx * 4) + 255 * (255 - idx * 4) + 127) div 255 AS int) AS flat")


@query(f"WITH {PX} SELECT vec_id, y2, x2, cast(sum(v) AS BIGINT) AS s FROM (SELECT vec_id, idx // 16 AS y2, idx % 8 // 2 AS x2, v FROM px) GROUP BY ALL")
def chroma_downsample(spark, d):
    cells = F.expr("transform(sequence(0, 15), k -> cast(g[(k div 4) * 16 + (k % 4) * 2] + g[(k div 4) * 16 + (k % 4) * 2 + 1] + g[(k div 4) * 16 + (k % 4) * 2 + 8] + g[(k div 4) * 16 + (k % 4) * 2 + 9] AS long))")
    return listed(grids(spark, d), cells, "vec_id", name="s").selectExpr("vec_id", "cast(idx div 4 AS int) AS y2", "cast(idx % 4 AS int) AS x2", "s")


@query("SELECT l_orderkey, l_linenumber, cast(l_quantity - lag(l_quantity, 1, 0) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS diff FROM lineitem")
def dc_difference(spark, d):
    return differences(spark, d).select("l_orderkey", "l_linenumber", "diff")


@query("SELECT l_orderkey, l_linenumber, cast(l_quantity AS BIGINT) AS dc FROM lineitem")
def dc_restore(spark, d):
    return differences(spark, d).select("l_orderkey", "l_linenumber", F.sum("diff").over(lines().rowsBetween(W.unboundedPreceding, 0)).alias("dc"))


@query(f"WITH {PX}, z AS (SELECT vec_id, idx, v // 64 - 2 AS q FROM px), s AS (SELECT vec_id, idx, q, max(CASE WHEN q <> 0 THEN idx END) OVER (PARTITION BY vec_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM z) SELECT vec_id, idx, cast(q AS INTEGER) AS q, cast(idx - coalesce(before, -1) - 1 AS INTEGER) AS run FROM s WHERE q <> 0")
def zero_run_lengths(spark, d):
    f = grids(spark, d).selectExpr("vec_id", "filter(transform(g, (v, i) -> struct(cast(i AS int) AS idx, cast(v div 64 - 2 AS int) AS q)), s -> s.q <> 0) AS nz")
    return f.select("vec_id", F.explode(F.expr("transform(nz, (s, k) -> struct(s.idx AS idx, s.q AS q, s.idx - coalesce(get(nz, k - 1).idx, -1) - 1 AS run))")).alias("r")).select("vec_id", "r.idx", "r.q", "r.run")


@query(f"WITH {PX} SELECT v // 16 AS symbol, count(*) AS n FROM px GROUP BY v // 16")
def symbol_histogram(spark, d):
    return listed(grids(spark, d), F.col("g"), "vec_id").groupBy(F.expr("cast(v div 16 AS int)").alias("symbol")).agg(F.count("*").alias("n"))


@query(f"WITH {PX} SELECT vec_id, (idx % 8) * 8 + idx // 8 AS idx, CASE WHEN (idx % 8) % 2 = 1 THEN -v ELSE v END AS v FROM px")
def dct_flip_block(spark, d):
    return listed(grids(spark, d), F.expr("transform(g, (v, i) -> if(i div 8 % 2 = 1, -1, 1) * g[(i % 8) * 8 + i div 8])"), "vec_id")


@query(f"WITH {PX} SELECT vec_id, idx, cast(sum(v) OVER (PARTITION BY vec_id, idx // 8 ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS s FROM px")
def box_blur_sum(spark, d):
    return listed(grids(spark, d), F.expr("transform(g, (v, i) -> aggregate(filter(transform(sequence(-2, 2), k -> if(i % 8 + k BETWEEN 0 AND 7, g[i + k], null)), x -> x IS NOT NULL), 0L, (s, x) -> s + x))"), "vec_id", name="s")


@query("""SELECT event_id, cast(last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS carried FROM events""")
def carry_forward_asof(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return read(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("carried"))


@query("SELECT label, count(*) AS frames, cast(sum(len(embedding)) AS BIGINT) AS pixels FROM embeddings GROUP BY label HAVING count(*) > 1")
def frame_totals(spark, d):
    return read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("frames"), F.sum(F.size("embedding").cast("long")).alias("pixels")).where("frames > 1")


@query("SELECT page_id, CASE WHEN html IS NULL THEN 'EMPTY' WHEN length(html) > 10000 THEN 'LIMIT' ELSE 'OK' END AS status FROM pages")
def limits_status(spark, d):
    return read(spark, d, "pages").selectExpr("page_id", "CASE WHEN html IS NULL THEN 'EMPTY' WHEN length(html) > 10000 THEN 'LIMIT' ELSE 'OK' END AS status")


_MAGIC = (("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("bmp", "424D"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("jxl", "FF0A"), ("jxl", "0000000C4A584C20"))
_CASE = "CASE " + " ".join(f"WHEN starts_with(h, '{m}') THEN '{k}'" for k, m in _MAGIC) + " END"


@query(f"SELECT p_partkey, {_CASE} AS format FROM (SELECT p_partkey, CASE p_size % 9 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (_, m) in enumerate(_MAGIC)) + " ELSE '00' END || '00FF' AS h FROM part)")
def detect_format(spark, d):
    blob = F.unhex(F.concat(F.coalesce(F.get(F.array(*(F.lit(m) for _, m in _MAGIC)), F.col("p_size") % 9), F.lit("00")), F.lit("00FF")))
    return read(spark, d, "part").select("p_partkey", F.hex(blob).alias("h")).select("p_partkey", F.expr(_CASE.replace("starts_with", "startswith")).alias("format"))


@query("""SELECT event_id, k AS tag FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) WHERE NOT regexp_matches(k, '^(ref|session|user).*', 'i')""")
def policy_antijoin(spark, d):
    e = read(spark, d, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("tag"))
    patterns = spark.createDataFrame([("(?i)^(ref|session|user).*",)], "pattern string")  # a policy's patterns: a few rows
    return e.join(F.broadcast(patterns), F.expr("rlike(tag, pattern)"), "left_anti")
