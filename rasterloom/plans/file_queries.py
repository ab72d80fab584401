"""Queries over image files made from the supplied tables, and over the tables that describe files."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rasterloom.operators.grid import listed
from rasterloom.plans.core_queries import KEY, PX, SIDE, grids, read
from rasterloom.sources import exif, images, png

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def grey_files(spark, d):
    """Each grid as a grey PNG file."""

    def made(cells):
        return {"content": png.png_file(png.Header(SIDE, SIDE, 8, 0), np.array(cells, np.uint8).reshape(SIDE, SIDE, 1))}

    return grids(spark, d).select("vec_id", images.per_file(made, images.FILE, F.col("g"))["content"].alias("content"))


def samples(files, content):
    def read_back(data):
        parts = png.chunks(data)
        head = png.header(parts)
        return {"g": png.decoded(head, png.frames(parts, head)[0][1]).ravel().tolist()}

    return listed(files.select("vec_id", images.per_file(read_back, "struct<g:array<int>,code:string>", content)["g"].alias("g")), F.col("g"), "vec_id")


def salt():
    return F.col("vec_id").cast("string").cast("binary")


@query(f"WITH {PX} SELECT vec_id, idx, v FROM px")
def png_file_roundtrip(spark, d):
    f = grey_files(spark, d).withColumn("hidden", images.png_scrambled(F.col("content"), KEY, salt(), "block", 2)["content"])
    return samples(f, images.png_restored(F.col("hidden"), KEY)["content"])


@query(f"WITH {PX} SELECT vec_id, idx, v FROM px")
def png_file_rekey(spark, d):
    f = grey_files(spark, d).withColumn("hidden", images.png_scrambled(F.col("content"), KEY, salt())["content"])
    f = f.withColumn("again", images.png_rekeyed(F.col("hidden"), KEY, b"new key", salt())["content"])
    return samples(f, images.png_restored(F.col("again"), b"new key")["content"])


@query("SELECT vec_id, 'WRONG_KEY' AS code FROM embeddings")
def png_wrong_key(spark, d):
    f = grey_files(spark, d).withColumn("hidden", images.png_scrambled(F.col("content"), KEY, salt())["content"])
    return f.select("vec_id", images.png_restored(F.col("hidden"), b"other")["code"].alias("code"))


@query("SELECT vec_id, cast(8 AS BIGINT) AS width, cast(8 AS BIGINT) AS height, 8 AS depth, 0 AS color_type, 1 AS frames, true AS scrambled, 'pixel' AS mode FROM embeddings")
def png_inspect(spark, d):
    f = grey_files(spark, d).select("vec_id", images.png_info(images.png_scrambled(F.col("content"), KEY, salt())["content"]).alias("i"))
    return f.select("vec_id", *(f"i.{k}" for k in ("width", "height", "depth", "color_type", "frames", "scrambled", "mode")))


@query("""SELECT p_partkey, unnest([271, 274, 33434, 36867]) AS tag, unnest(['ifd0', 'ifd0', 'exif', 'exif']) AS ifd,
 unnest([p_brand, cast(p_size % 8 + 1 AS VARCHAR), p_size || '/50', 'day ' || p_partkey]) AS text FROM part""")
def exif_tag_rows(spark, d):
    def made(brand, size, key):
        o = "<" if key % 2 else ">"
        own = [("ifd0", 271, 2, brand.encode() + b"\0"), ("ifd0", 274, 3, struct.pack(o + "H", size % 8 + 1)), ("exif", 33434, 5, struct.pack(o + "II", size, 50)), ("exif", 36867, 2, f"day {key}\0".encode())]
        return {"content": exif.block_of(own, o)}

    f = read(spark, d, "part").select("p_partkey", images.per_file(made, images.FILE, F.col("p_brand"), F.col("p_size"), F.col("p_partkey"))["content"].alias("b"))
    tags = f.select("p_partkey", F.explode(images.exif_tags(F.col("b"))["tags"]).alias("t"))
    return tags.select("p_partkey", "t.tag", "t.ifd", "t.text").where(~F.col("tag").isin(*exif.POINTERS))


@query("""SELECT page_id, unnest([0, 1]) AS ord, unnest([224, 254]) AS marker, unnest([4, least(60000, strlen(coalesce(url, '')))]) AS length FROM pages""")
def jpeg_segment_rows(spark, d):
    comment = F.coalesce("url", F.lit("")).cast("binary")

    def made(text):
        body = text[:60000]
        return {"content": b"\xff\xd8\xff\xe0\x00\x06JFIF\xff\xfe" + (len(body) + 2).to_bytes(2, "big") + body + b"\xff\xd9"}

    f = read(spark, d, "pages").select("page_id", images.jpeg_segments(images.per_file(made, images.FILE, comment)["content"])["segments"].alias("s"))
    return f.select("page_id", F.explode("s").alias("s")).select("page_id", "s.ord", "s.marker", "s.length")


@query("SELECT t AS transform, CASE WHEN t >= 4 THEN 4 + (t % 2) * 2 + t // 2 % 2 ELSE t END AS inverse FROM (SELECT cast(unnest(range(8)) AS BIGINT) AS t)")
def invert_transform(spark, d):
    # a transposed tile swaps its flips when turned back; others are their own inverse
    return spark.range(8).selectExpr("id AS transform", "if(id >= 4, 4 + shiftleft(id & 1, 1) + shiftright(id & 2, 1), id) AS inverse")


@query(f"WITH {PX} SELECT vec_id, idx, cast(least(255, sum(v - 128) OVER (PARTITION BY vec_id, idx // 8 ORDER BY idx)) AS BIGINT) AS cover FROM px")
def coverage_prefix(spark, d):
    sums = F.expr("transform(g, (v, i) -> least(255L, aggregate(slice(g, cast(i - i % 8 + 1 AS int), cast(i % 8 + 1 AS int)), 0L, (s, x) -> s + x - 128)))")
    return listed(grids(spark, d), sums, "vec_id", name="cover")


PLACED = "SELECT p_partkey, cast(floor(s + 0.5) AS BIGINT) AS size, cast(floor((w - s) / 2 + 0.5) AS BIGINT) AS x FROM (SELECT p_partkey, w, greatest(8, least(64, w * 0.25)) AS s FROM {})"


@query(PLACED.format("(SELECT p_partkey, cast(p_size * 10 AS DOUBLE) AS w FROM part)"))
def place_watermark(spark, d):
    return spark.sql(PLACED.format("{sizes}"), sizes=read(spark, d, "part").selectExpr("p_partkey", "cast(p_size * 10 AS double) AS w"))


PALETTE = (0, 51, 102, 128, 153, 204, 255)


@query(f"WITH {PX}, p AS (SELECT unnest(range({len(PALETTE)})) AS k, unnest({list(PALETTE)}) AS c) SELECT vec_id, idx, cast(arg_min(k, abs(v - c) * 8 + k) AS INTEGER) AS slot FROM px, p GROUP BY vec_id, idx")
def palette_nearest(spark, d):
    slot = lambda v: F.array_min(F.array(*(F.struct(F.abs(v - c).alias("far"), F.lit(k).alias("k")) for k, c in enumerate(PALETTE))))["k"]
    return listed(grids(spark, d), F.transform("g", slot), "vec_id", name="slot")


REASONS = (("ref.*", "strip pattern"), ("session.*", "privacy group"), ("user.*", "privacy group"))


@query("""SELECT event_id, k AS tag, CASE WHEN regexp_matches(k, '^ref', 'i') THEN 'strip pattern' WHEN regexp_matches(k, '^(session|user)', 'i') THEN 'privacy group' END AS reason
FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events)""")
def policy_reason(spark, d):
    why = F.coalesce(*(F.when(F.col("tag").rlike(f"(?i)^{p}"), w) for p, w in REASONS))
    return read(spark, d, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("tag")).withColumn("reason", why)


@query("""SELECT p_partkey, p_size AS tag, CASE p_size WHEN 1 THEN 'InteropIndex' WHEN 2 THEN 'InteropVersion' ELSE '0x' || lpad(lower(to_hex(p_size)), 4, '0') END AS name FROM part""")
def tag_dimension_join(spark, d):
    names = spark.createDataFrame([(1, "InteropIndex"), (2, "InteropVersion")], "tag int, name string")  # a few rows
    p = read(spark, d, "part").select("p_partkey", F.col("p_size").alias("tag"))
    return p.join(F.broadcast(names), "tag", "left").select("p_partkey", "tag", F.coalesce("name", F.concat(F.lit("0x"), F.lpad(F.lower(F.hex("tag")), 4, "0"))).alias("name"))


@query("SELECT conv_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text)) AS digest, count(*) AS parts FROM conversations GROUP BY conv_id")
def segment_reassembly(spark, d):
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(parts, lambda s: s["text"]), ""), 256).alias("digest"), F.count("*").alias("parts"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'exact' WHEN p_size % 2 = 0 THEN 'fast' ELSE 'builtin' END AS decoder FROM part")
def first_match_plugin(spark, d):
    return read(spark, d, "part").selectExpr("p_partkey", "coalesce(if(p_size % 3 = 0, 'exact', null), if(p_size % 2 = 0, 'fast', null), 'builtin') AS decoder")


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS dropped FROM events GROUP BY user_id")
def dropped_distinct(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("dropped"))


@query("SELECT p_partkey, p_size % 4 = p_size % 6 AS conflict FROM part")
def keep_strip_conflict(spark, d):
    return read(spark, d, "part").select("p_partkey", F.arrays_overlap(F.array(F.col("p_size") % 4), F.array(F.col("p_size") % 6)).alias("conflict"))


@query("SELECT p_partkey, cast(p_size // gcd(p_size, 100) AS BIGINT) AS num, cast(100 // gcd(p_size, 100) AS BIGINT) AS den FROM part")
def apng_delay(spark, d):
    common = "array_max(filter(sequence(1, 100), k -> p_size % k = 0 AND 100 % k = 0))"
    return read(spark, d, "part").withColumn("k", F.expr(common)).selectExpr("p_partkey", "cast(p_size div k AS long) AS num", "cast(100 div k AS long) AS den")


@query("SELECT user_id, event_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq FROM events")
def renumber_sequence(spark, d):
    return read(spark, d, "events").select("user_id", "event_id", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("seq"))
