"""Folders of image files as tables, and column functions over files held in a binary column.

A file is one row; functions run per row over Arrow batches and need no shuffle. A file that cannot be
handled gives a null result and a code, never a failed job.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.errors import ImageError
from rasterloom.metadata.policy import policy as resolved_policy
from rasterloom.metadata.read import metadata_of
from rasterloom.operators import files
from rasterloom.sources import exif, png

INFO = "struct<width:bigint,height:bigint,depth:int,color_type:int,interlace:int,frames:int,scrambled:boolean,mode:string,block:int,code:string>"
FILE = "struct<content:binary,code:string>"
TAGS = "struct<tags:array<struct<ifd:string,ord:int,tag:int,type:int,count:bigint,data:binary,text:string>>,code:string>"
PAIRS = "array<struct<name:string,value:string>>"
CONVERTED = "struct<content:binary,format:string,transferred:array<string>,dropped:array<string>,notes:array<string>,code:string>"
APPLIED = "struct<content:binary,removed:array<string>,`set`:array<string>,notes:array<string>,code:string>"
INSPECTED = "struct<format:string,width:bigint,height:bigint,frames:int,scrambled:boolean,mode:string,transforms:boolean,orientation:int,watermark:string,code:string>"
METADATA = f"struct<format:string,orientation:int,exif:array<struct<ifd:string,tag:string,name:string,type:string,value:string>>,xmp:{PAIRS},iptc:{PAIRS},text:{PAIRS},other:{PAIRS},icc:string,code:string>"
SEGMENTS = "struct<segments:array<struct<ord:int,marker:int,length:int,coded:int,data:binary>>,code:string>"


def image_files(spark: SparkSession, path: str, max_bytes: int, stream: bool = False, keep_large: bool = False) -> DataFrame:
    """path, modificationTime, length, content of files of at most max_bytes; the bound is applied before
    contents are read. As a stream, new files of the folder arrive as they are put there. With
    keep_large, longer files have a row, too, with null content (which is never read) and code LIMIT."""
    kinds = "path string, modificationTime timestamp, length bigint, content binary"

    def files() -> DataFrame:
        reader = (spark.readStream if stream else spark.read).format("binaryFile").schema(kinds).option("recursiveFileLookup", "true")
        return reader.load(path)

    short = files().where(F.col("length") <= max_bytes)
    if not keep_large:
        return short
    large = files().where(F.col("length") > max_bytes).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return short.withColumn("code", F.lit(None).cast("string")).unionByName(large.withColumn("code", F.lit("LIMIT")))


def per_file(f: Callable[..., dict], kind: str, *cols: Column) -> Column:
    """f of each row's values as a struct of a kind with a field code: null, or why f gave nothing.

    A null in any column gives null fields and code EMPTY. Whatever f raises becomes a code, FAULT where it
    has none of its own, so that one file never fails a job.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    arrow_kind = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(*given: pa.Array) -> pa.Array:
        out = []
        for values in zip(*given):
            values = [v.as_py() for v in values]
            try:
                out.append({"code": "EMPTY"} if None in values else f(*values))
            except ImageError as e:
                out.append({"code": e.code})
            except Exception:  # noqa: BLE001 - damaged input may break any reader
                out.append({"code": "FAULT"})
        return pa.array(out, arrow_kind)

    return run(*cols)


def png_info(content: Column) -> Column:
    return per_file(png.info, INFO, content)


def png_scrambled(content: Column, key: bytes, salt: Column, mode: str = "pixel", block: int = 0) -> Column:
    return per_file(lambda c, s: {"content": png.scrambled(c, key, s, mode, block)}, FILE, content, salt)


def png_restored(content: Column, key: bytes) -> Column:
    return per_file(lambda c: {"content": png.restored(c, key)}, FILE, content)


def png_rekeyed(content: Column, old: bytes, new: bytes, salt: Column) -> Column:
    return per_file(lambda c, s: {"content": png.rekeyed(c, old, new, s)}, FILE, content, salt)


def exif_tags(block: Column) -> Column:
    return per_file(lambda b: {"tags": exif.tags(b)}, TAGS, block)


def jpeg_segments(content: Column) -> Column:
    return per_file(lambda c: {"segments": exif.segments(c)}, SEGMENTS, content)


# ---- files of any format


def scrambled(content: Column, key: str | bytes, salt: Column | None = None, **options) -> Column:
    """Files scrambled in their format or the one asked for; without a salt, each with a random one of its own."""
    files.checked_options(options)
    if salt is None:
        return per_file(lambda c: {"content": files.encode(c, key, **options)}, FILE, content)
    return per_file(lambda c, s: {"content": files.encode(c, key, s, **options)}, FILE, content, salt)


def restored(content: Column, key: str | bytes, **options) -> Column:
    return per_file(lambda c: {"content": files.decode(c, key, **options)}, FILE, content)


def rekeyed(content: Column, old: str | bytes, new: str | bytes, salt: Column, **options) -> Column:
    return per_file(lambda c, s: {"content": files.rekey(c, old, new, s, **options)}, FILE, content, salt)


def converted(content: Column, **options) -> Column:
    """Files in another format with what was carried over, dropped and noted."""
    files.checked_options(options)

    def run(c: bytes) -> dict:
        got = files.convert(c, **options)
        return {"content": got.content, "format": got.format, "transferred": got.transferred, "dropped": got.dropped, "notes": got.notes}

    return per_file(run, CONVERTED, content)


def inspected(content: Column, **options) -> Column:
    """What the heads of files of any format tell."""

    def run(c: bytes) -> dict:
        got = files.inspect(c, **options)
        mark = got.get("watermark") or {}
        return {**{k: got.get(k) for k in ("format", "width", "height", "frames", "scrambled", "mode", "transforms", "orientation")}, "watermark": mark.get("id")}

    return per_file(run, INSPECTED, content)


def with_policy(content: Column, policy: str | dict, **options) -> Column:
    """Files under a metadata policy, which is checked here, with what went and what was set."""
    given = resolved_policy(policy)

    def run(c: bytes) -> dict:
        data, report = files.apply_metadata(c, given, **options)
        return {"content": data, "removed": report.removed, "set": report.set, "notes": report.notes}

    return per_file(run, APPLIED, content)


def metadata(content: Column) -> Column:
    """EXIF tags, XMP properties, IPTC datasets, texts and other blocks of files, for people; values that are no text as JSON."""
    shown = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    def run(c: bytes) -> dict:
        got = metadata_of(c)
        return {
            "format": got["format"], "orientation": got["orientation"],
            "exif": [{"ifd": t["ifd"], "tag": t["tag"], "name": t["name"], "type": t["type"], "value": shown(t["value"])} for t in (got["exif"] or {}).get("tags", [])],
            "xmp": [{"name": p["name"], "value": shown(p["value"])} for p in (got["xmp"] or {}).get("properties", [])],
            "iptc": got["iptc"] or [], "text": [{"name": t["keyword"], "value": t["text"]} for t in got["text"]],
            "other": [{"name": o.get("label", o["type"]), "value": str(o["bytes"])} for o in got["other"]], "icc": (got["icc"] or {}).get("description"),
        }

    return per_file(run, METADATA, content)
