"""Queries of the verbs, metadata and watermarks over files made from the supplied tables, and their SQL."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from rasterloom.functions.limits import checked
from rasterloom.functions.params import params, read_marker
from rasterloom.metadata import exif as exif_model
from rasterloom.metadata import iptc, text, xmp
from rasterloom.metadata.tags import TAGS
from rasterloom.operators import files
from rasterloom.operators.grid import listed
from rasterloom.plans.core_queries import KEY, PX, SIDE, grids, read
from rasterloom.sources import detect, images, jpeg, jpeg_pixels, jxl, png, raster, sink
from rasterloom.watermark.definition import compiled
from rasterloom.watermark.render import placed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: A watermark of a red square.
MARK = compiled({"format": "test-watermark", "version": 1, "id": "square", "name": "square", "box": [0, 0, 1000, 1000], "size": {"relative": 0.25, "min": 8, "max": 64}, "fit": {"maxWidth": 1, "maxHeight": 1, "minSize": 0}, "margin": {"min": 0, "max": 0}, "anchor": "center", "shapes": [{"d": "M0 0L1000 0L1000 1000L0 1000Z", "fill": "#ff0000"}]})


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def square(cells, scale: int = 1) -> np.ndarray:
    """A grid as RGBA, each sample as a square of pixels."""
    v = np.kron(np.array(cells, np.uint8).reshape(SIDE, SIDE), np.ones((scale, scale), np.uint8))
    return np.dstack([v, v, v, np.full_like(v, 255)])


def spread(spark, d):
    """Grids dealt to all cores: few rows, and much work for each."""
    return grids(spark, d).repartition(spark.sparkContext.defaultParallelism)


def salt():
    return F.col("vec_id").cast("string").cast("binary")


def grey_jpeg(cells) -> dict:
    return {"content": jpeg_pixels.jpeg_file(square(cells), quality=100)}


SIGN = "CASE WHEN {} % 4 IN (0, 3) THEN 1 ELSE -1 END"


@query(f"""WITH {PX}, s AS (SELECT vec_id, v - 128 AS v, {SIGN.format("idx % 8")} AS sx, {SIGN.format("(idx // 8)")} AS sy FROM px),
c AS (SELECT vec_id, unnest([0, 4, 32, 36]) AS idx, unnest([sum(v), sum(v * sx), sum(v * sy), sum(v * sx * sy)]) AS t FROM s GROUP BY vec_id)
SELECT vec_id, cast(idx AS INTEGER) AS idx, cast(sign(t) * floor(abs(t) / 8.0 + 0.5) AS BIGINT) AS c FROM c""")
def jpeg_file_roundtrip(spark, d):
    """Coefficients of grids as JPEG files, after scrambling, a change of key and restoring."""

    def read_back(data):
        flat = jpeg.read(data)[1].components[0].coefs[0, 0]
        return {"c": [{"idx": i, "c": int(flat[i])} for i in (0, 4, 32, 36)]}

    f = spread(spark, d).select("vec_id", images.per_file(grey_jpeg, images.FILE, F.col("g"))["content"].alias("f"))
    f = f.withColumn("f", images.scrambled(F.col("f"), KEY, salt())["content"])
    f = f.withColumn("f", images.rekeyed(F.col("f"), KEY, b"new", salt())["content"])
    f = f.withColumn("c", images.per_file(read_back, "struct<c:array<struct<idx:int,c:bigint>>,code:string>", images.restored(F.col("f"), b"new")["content"])["c"])
    return f.select("vec_id", F.explode("c").alias("c")).select("vec_id", "c.idx", "c.c")


@query(f"""WITH {PX} SELECT vec_id, bool_or(v <> w) AS moves, true AS same_samples FROM (SELECT vec_id, v, min(v) OVER (PARTITION BY vec_id) AS w FROM px) GROUP BY vec_id""")
def scramble_moves_pixels(spark, d):
    """That scrambling moves samples of pictures that have more than one, and changes none."""

    def look(cells):
        plain = square(cells, 4)
        mixed = raster.decoded(files.encode(raster.png_file(raster.Picture(plain))[0], KEY, b"s", transforms=False, block=4)).rgba
        return {"moves": bool((plain != mixed).any()), "same_samples": bool((np.sort(plain, axis=None) == np.sort(mixed, axis=None)).all())}

    f = spread(spark, d).select("vec_id", images.per_file(look, "struct<moves:boolean,same_samples:boolean,code:string>", F.col("g")).alias("l"))
    return f.select("vec_id", "l.moves", "l.same_samples")


@query(f"WITH {PX} SELECT vec_id, idx, v, true AS covered, 'square' AS mark FROM px")
def visible_watermark_roundtrip(spark, d):
    """Samples after restoring pictures that were scrambled under a visible watermark."""

    def run(cells):
        data = raster.png_file(raster.Picture(square(cells, 4)))[0]
        hidden = files.encode(data, KEY, b"s", visible_watermark=MARK, watermark=MARK)
        covered = (raster.decoded(hidden).rgba != raster.decoded(files.encode(data, KEY, b"s")).rgba).any()
        back = raster.decoded(files.decode(hidden, KEY)).rgba
        return {"g": back[::4, ::4, 0].ravel().astype(int).tolist(), "covered": bool(covered), "mark": files.inspect(hidden)["watermark"]["id"]}

    f = spread(spark, d).select("vec_id", images.per_file(run, "struct<g:array<int>,covered:boolean,mark:string,code:string>", F.col("g")).alias("r"))
    return f.select("vec_id", F.posexplode("r.g").alias("idx", "v"), "r.covered", "r.mark")


@query(f"""WITH {PX}, q AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN v // 128 * 255 WHEN 1 THEN v // 64 * 85 WHEN 2 THEN v // 16 * 17 ELSE v END AS v FROM px)
SELECT vec_id, CASE WHEN bool_and(v % 255 = 0) THEN 1 WHEN bool_and(v % 85 = 0) THEN 2 WHEN bool_and(v % 17 = 0) THEN 4 ELSE 8 END AS depth, 0 AS color_type FROM q GROUP BY vec_id""")
def smallest_color_type(spark, d):
    """The depth that grey pictures are written with."""

    def run(cells, vec_id):
        v = np.array(cells)
        v = [v // 128 * 255, v // 64 * 85, v // 16 * 17, v][vec_id % 4]
        head = png.header(png.chunks(raster.png_file(raster.Picture(square(v)))[0]))
        return {"depth": head.depth, "color_type": head.color_type}

    f = grids(spark, d).select("vec_id", images.per_file(run, "struct<depth:int,color_type:int,code:string>", F.col("g"), F.col("vec_id")).alias("h"))
    return f.select("vec_id", "h.depth", "h.color_type")


@query(f"WITH {PX} SELECT vec_id, idx, cast((v * (idx * 4) + 17 * (255 - idx * 4) + 127) // 255 AS INTEGER) AS v FROM px")
def alpha_flatten(spark, d):
    """Pictures shown on a colour."""

    def run(cells):
        rgba = square(cells)
        rgba[:, :, 3] = np.arange(64).reshape(8, 8) * 4
        return {"g": jpeg_pixels.over(rgba, "#111111")[:, :, 0].ravel().astype(int).tolist()}

    return listed(grids(spark, d).select("vec_id", images.per_file(run, "struct<g:array<int>,code:string>", F.col("g"))["g"].alias("g")), F.col("g"), "vec_id")


@query(f"WITH {PX}, n AS (SELECT vec_id, idx, v AS r, lead(v, 1, 0) OVER w AS g, lead(v, 2, 0) OVER w AS b FROM px WINDOW w AS (PARTITION BY vec_id ORDER BY idx)) SELECT vec_id, idx, cast((299 * r + 587 * g + 114 * b + 500) // 1000 AS INTEGER) AS y FROM n")
def ycc_convert(spark, d):
    """Brightness in whole numbers, of samples as red and their next two as green and blue."""
    y = "cast((299 * v + 587 * coalesce(get(g, i + 1), 0) + 114 * coalesce(get(g, i + 2), 0) + 500) div 1000 AS int)"
    return listed(grids(spark, d), F.expr(f"transform(g, (v, i) -> {y})"), "vec_id", name="y")


@query(f"""WITH {PX}, r AS (SELECT vec_id, vec_id % 5 AS x0, vec_id % 3 AS y0, vec_id % 5 + 3 AS x1, vec_id % 3 + 4 AS y1 FROM embeddings)
SELECT px.vec_id, idx, v FROM px JOIN r ON px.vec_id = r.vec_id AND idx % 8 >= x0 AND idx % 8 < x1 AND idx // 8 >= y0 AND idx // 8 < y1""")
def patch_range_join(spark, d):
    """Samples within a rectangle of each picture: cut out of the array, before any row is made."""
    inside = F.expr("filter(transform(g, (v, i) -> struct(cast(i AS int) AS idx, v)), s -> s.idx % 8 BETWEEN vec_id % 5 AND vec_id % 5 + 2 AND s.idx div 8 BETWEEN vec_id % 3 AND vec_id % 3 + 3)")
    return grids(spark, d).select("vec_id", F.explode(inside).alias("s")).select("vec_id", "s.idx", "s.v")


@query("SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'jxl' END AS format FROM embeddings")
def file_formats(spark, d):
    """Formats of real files, by an expression over their bytes."""

    def run(cells, vec_id):
        plain = raster.png_file(raster.Picture(square(cells)))[0]
        return {"content": [plain, grey_jpeg(cells)["content"], b"GIF89a" + bytes(9), jxl.written([], b"\xff\x0a"), b"none of them"][vec_id % 5]}

    f = grids(spark, d).select("vec_id", images.per_file(run, images.FILE, F.col("g"), F.col("vec_id"))["content"].alias("f"))
    return f.select("vec_id", detect.format_column(F.col("f")).alias("format"))


def put(name: str, value, order: str = "<"):
    return exif_model.encoded(exif_model.settable(name), value, order)


@query("""SELECT p_partkey, unnest(['Make', 'Orientation', 'FNumber']) AS name, unnest([p_brand, cast(p_size % 8 + 1 AS VARCHAR), cast(p_size AS VARCHAR)]) AS value FROM part""")
def privacy_policy_rows(spark, d):
    """The EXIF tags that are left of files under a policy that removes owners, times and places."""

    def made(brand, name, size, key):
        order = "<>"[key % 2]
        model = exif_model.Exif(order, {"IFD0": [put("Make", brand, order), put("Artist", name, order), put("DateTime", "2024:01:02 03:04:05", order), put("Orientation", size % 8 + 1, order)], "Exif": [put("FNumber", size, order), put("BodySerialNumber", str(key), order)], "GPS": [put("GPSLatitude", [size, 1, 2.5], order)]})
        return {"content": raster.png_file(raster.Picture(np.full((4, 4, 4), 255, np.uint8), meta={"exif": exif_model.written(model)[0]}))[0]}

    f = read(spark, d, "part").select("p_partkey", images.per_file(made, images.FILE, F.col("p_brand"), F.col("p_name"), F.col("p_size"), F.col("p_partkey"))["content"].alias("f"))
    tags = images.metadata(images.with_policy(F.col("f"), "privacy")["content"])["exif"]
    return f.select("p_partkey", F.explode(tags).alias("t")).select("p_partkey", "t.name", "t.value")


@query("""SELECT p_partkey, unnest(['dc:title', 'photoshop:Headline']) AS name, unnest(['["' || p_name || '"]', p_type || ' & <' || p_brand || '>']) AS value FROM part""")
def xmp_property_rows(spark, d):
    """Properties set in packets, read back, without those that a pattern removes."""

    def made(name, kind, brand):
        packet = xmp.Packet(xmp.EMPTY)
        packet.set("dc:title", name)
        packet.set("photoshop:Headline", f"{kind} & <{brand}>")
        packet.set("xmp:CreateDate", "2024")
        data = raster.png_file(raster.Picture(np.full((4, 4, 4), 255, np.uint8), meta={"xmp": str(packet)}))[0]
        return {"content": data}

    f = read(spark, d, "part").select("p_partkey", images.per_file(made, images.FILE, F.col("p_name"), F.col("p_type"), F.col("p_brand"))["content"].alias("f"))
    found = images.metadata(images.with_policy(F.col("f"), {"remove": ["xmp:xmp:Create*"]})["content"])["xmp"]
    return f.select("p_partkey", F.explode(found).alias("p")).select("p_partkey", "p.name", "p.value")


@query("""SELECT s_suppkey, unnest(['By-line', 'Caption-Abstract']) AS name, unnest(['nobody', s_name]) AS value FROM supplier""")
def iptc_dataset_rows(spark, d):
    """Datasets of JPEG files under a policy that removes one and sets another."""
    byline, city, caption = (iptc.dataset_number(n) for n in ("By-line", "City", "Caption-Abstract"))

    def made(name, key):
        body = b"".join(iptc.Dataset(2, n, v).written() for n, v in ((byline, str(key).encode()), (city, b"x"), (caption, name.encode())))
        payload = iptc.SIGNATURE + iptc.Resource(iptc.IPTC, b"8BIM\x04\x04\0\0", body).written()
        segments, _ = jpeg.parsed(jpeg_pixels.jpeg_file(np.full((8, 8, 3), 9, np.uint8)))
        return {"content": jpeg.written([segments[0], jpeg.Segment(0xED, payload), *segments[1:]])}

    f = read(spark, d, "supplier").select("s_suppkey", images.per_file(made, images.FILE, F.col("s_name"), F.col("s_suppkey"))["content"].alias("f"))
    found = images.metadata(images.with_policy(F.col("f"), {"remove": ["iptc:City"], "set": {"artist": "nobody"}})["content"])["iptc"]
    return f.select("s_suppkey", F.explode(found).alias("p")).select("s_suppkey", "p.name", "p.value")


@query("SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL AND text <> '' AND strlen(text) < 65000")
def comment_rows(spark, d):
    """Turns as comments of JPEG segments, read back; texts that a segment does not hold are left out by both."""
    rows = read(spark, d, "conversations").where("text IS NOT NULL AND text <> '' AND octet_length(text) < 65000")
    back = images.per_file(lambda t: {"t": text.comment(text.comment_bytes(t))}, "struct<t:string,code:string>", F.col("text"))["t"]
    return rows.select("conv_id", "turn", back.alias("text"))


@query("SELECT c_custkey, 'Title' AS keyword, c_name || ' 中é' AS text FROM customer")
def png_text_rows(spark, d):
    """Text chunks of both kinds, written and read."""

    def run(name):
        word, value = text.read_text(*text.text_chunk("Title", name))
        return {"keyword": word, "text": value}

    f = read(spark, d, "customer").select("c_custkey", images.per_file(run, "struct<keyword:string,text:string,code:string>", F.concat("c_name", F.lit(" 中é"))).alias("t"))
    return f.select("c_custkey", "t.keyword", "t.text")


@query("""SELECT p_partkey, CASE WHEN p_size * 3 > 100 THEN 'BAD_OPTION' WHEN p_size < 2 THEN 'BAD_OPTION' WHEN p_size % 4 = 3 THEN 'BAD_OPTION' END AS code FROM part""")
def options_status(spark, d):
    """Which options are refused."""

    def run(size):
        checked({"quality": max(1, size * 3), "block": size, "mode": ("pixel", "block", "mcu", "none")[size % 4]})
        return {"code": None}

    return read(spark, d, "part").select("p_partkey", images.per_file(run, "struct<code:string>", F.col("p_size"))["code"].alias("code"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'BAD_MARKER' WHEN 2 THEN 'UNSUPPORTED' ELSE 'BAD_MARKER' END AS code FROM part")
def marker_status(spark, d):
    """Markers that are whole, cut, of another version, and of no mode."""

    def run(size):
        from rasterloom.functions.params import marker

        data = marker(params("block", 16, salt=b"s" * size), b"1234")
        read_marker([data, data[:-1], b"\x05" + data[1:], data[:1] + b"\x09" + data[2:]][size % 4])
        return {"code": None}

    return read(spark, d, "part").select("p_partkey", images.per_file(run, "struct<code:string>", F.col("p_size"))["code"].alias("code"))


@query("SELECT p_partkey, cast(floor(s + 0.5) AS BIGINT) AS size, cast(floor((w - s) / 2 + 0.5) AS BIGINT) AS x FROM (SELECT p_partkey, w, greatest(8, least(64, w * 0.25)) AS s FROM (SELECT p_partkey, cast(p_size * 10 AS DOUBLE) AS w FROM part))")
def watermark_place(spark, d):
    """Where the engine puts a watermark on squares of several sizes."""

    def run(side):
        place = placed(MARK, side, side)
        return {"size": int(place.em + 0.5), "x": place.ox}

    f = read(spark, d, "part").select("p_partkey", images.per_file(run, "struct<size:bigint,x:bigint,code:string>", F.col("p_size") * 10).alias("p"))
    return f.select("p_partkey", "p.size", "p.x")


@query("""SELECT p_partkey, regexp_replace(p_name, '[^a-z]', '_', 'g') || '.scrambled.' || CASE p_size % 2 WHEN 0 THEN 'jpg' ELSE 'png' END AS name FROM part""")
def output_names(spark, d):
    """Names of results by the rule."""
    p = read(spark, d, "part").select("p_partkey", F.concat(F.lit("a.b/"), F.regexp_replace("p_name", "[^a-z]", "_"), F.lit(".tiff")).alias("path"), F.when(F.col("p_size") % 2 == 0, "jpeg").otherwise("png").alias("f"))
    return p.select("p_partkey", sink.output_name("encode", F.col("path"), F.col("f")).alias("name"))


@query("SELECT p_partkey, unnest(['ftyp', 'xml ', 'jumb', 'jxlc']) AS box, unnest([12, strlen(p_name), p_size, 10]) AS length FROM part")
def jxl_box_rows(spark, d):
    """Boxes of JPEG XL containers."""

    def run(name, size):
        boxes, _, _ = jxl.read(jxl.written([(b"xml ", name.encode()), (b"jumb", bytes(size))], b"\xff\x0a" + bytes(8)))
        return {"b": [{"box": k.decode(), "length": len(v)} for k, v in boxes]}

    f = read(spark, d, "part").select("p_partkey", images.per_file(run, "struct<b:array<struct<box:string,length:bigint>>,code:string>", F.col("p_name"), F.col("p_size"))["b"].alias("b"))
    return f.select("p_partkey", F.explode("b").alias("b")).select("p_partkey", "b.box", "b.length")


@query("SELECT p_partkey, 'gif' AS format, cast(p_size AS BIGINT) AS width, cast(p_size + 7 AS BIGINT) AS height, cast(p_size % 3 + 1 AS INTEGER) AS frames FROM part")
def gif_heads(spark, d):
    """GIF files of several images, described without unpacking."""

    def made(size):
        image = b"\x2c" + struct.pack("<4HB", 0, 0, size, size, 0) + b"\x02\x02\x4c\x01\x00"
        return {"content": b"GIF89a" + struct.pack("<HHBBB", size, size + 7, 0, 0, 0) + image * (size % 3 + 1) + b"\x3b"}

    f = read(spark, d, "part").select("p_partkey", images.inspected(images.per_file(made, images.FILE, F.col("p_size"))["content"]).alias("i"))
    return f.select("p_partkey", *(f"i.{k}" for k in ("format", "width", "height", "frames")))


@query("""SELECT DISTINCT page_id, lower(n) AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS n FROM pages) WHERE NOT regexp_matches(n, '^(script|h.*)$', 'i')""")
def element_antijoin(spark, d):
    """Names of pages' elements that a policy's patterns leave."""
    names = read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("n"))
    patterns = spark.createDataFrame([("(?i)^script$",), ("(?i)^h.*$",)], "pattern string")  # a policy's patterns: a few rows
    return names.join(F.broadcast(patterns), F.expr("rlike(n, pattern)"), "left_anti").select("page_id", F.lower("n").alias("name")).distinct()


@query("""SELECT p_partkey, CASE WHEN p_size % 5 IN (0, 4) THEN 'UNSUPPORTED' END AS code, CASE p_size % 5 WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'png' END AS format FROM part""")
def conversion_status(spark, d):
    """Formats that results have, and codes of files that cannot be handled."""
    plain = raster.png_file(raster.Picture(np.full((4, 4, 4), 200, np.uint8)))[0]
    photo = jpeg_pixels.jpeg_file(np.full((4, 4, 3), 200, np.uint8))

    def run(size):
        if size % 5 == 0:
            return files.convert(plain, format="jxl")
        got = {1: lambda: files.convert(plain, format="jpeg"), 2: lambda: files.convert(photo, format="png"), 3: lambda: files.convert(plain), 4: lambda: files.convert(b"RIFF    WEBP")}[size % 5]()
        return {"format": files.known_format(got.content)}

    f = read(spark, d, "part").select("p_partkey", images.per_file(run, "struct<format:string,code:string>", F.col("p_size")).alias("r"))
    return f.select("p_partkey", "r.code", "r.format")


@query("SELECT 'Exif' AS ifd, 37386 AS tag, 'FocalLength' AS name UNION ALL SELECT 'GPS', 2, 'GPSLatitude' UNION ALL SELECT 'IFD0', 274, 'Orientation' UNION ALL SELECT 'Interop', 1, 'InteropIndex'")
def tag_table(spark, d):
    """Tags by number, from the engine's own table."""
    tags = spark.createDataFrame([(t.ifd, t.tag, t.name) for t in TAGS], "ifd string, tag int, name string")  # fewer than 200 rows
    return tags.where("(ifd, tag) IN (('IFD0', 274), ('Exif', 37386), ('GPS', 2), ('Interop', 1))")
