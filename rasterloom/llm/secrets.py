"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns find spans in whole texts. A wider pattern finds further candidates: long runs that
mix letters and digits. The hash of every value found is aggregated over the corpus by distinct
repositories and owners. A value is a widely copied example where it is in several repositories of
several owners, or in very many repositories of whomever; else it is specific to its owners and looks
live. Wider candidates become spans only where they look live; base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import saved, table


def _either(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# The kinds in their order, their patterns, the group that holds the value, its least length.
ASSIGN = "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
#: Wider candidates: their kind and pattern.
OWNED, WIDE = "owned", r"[A-Za-z0-9_+/=-]{24,}"
#: A value is widely copied from so many owners on, if it is in so many repositories, too, or from so many repositories on.
OWNERS, REPOSITORIES, VERY_MANY = 2, 3, 50
SPAN = "array<struct<start:long,kind:int,end:long,value:string>>"
#: Matches that are added up in one go; a text of very many matches is worked off in chunks of these.
CHUNK = 256


def found(text: Column, kind: int, pattern: str, group: int) -> Column:
    """Leftmost non-overlapping matches of pattern as spans in code points, with the sha-256 of the value."""
    whole, value, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    # length before each match, its own length, and its value
    steps = F.zip_with(F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("b"), whole.alias("w")), value, lambda p, v: F.struct(F.length(p["b"]).cast("long").alias("gap"), F.length(p["w"]).cast("long").alias("n"), v.alias("v")))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + s["n"]).alias("end"), s["v"].alias("value"))
        return F.struct((start + s["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def none(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))

    def chunk(acc: Column, i: Column, all_steps: Column) -> Column:
        part = F.aggregate(F.slice(all_steps, i * CHUNK + 1, F.lit(CHUNK)), none(acc["at"]), add)
        return F.struct(part["at"].alias("at"), F.concat(acc["out"], part["out"]).alias("out"))

    spans = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / CHUNK).cast("int")), none(F.lit(0).cast("long")), lambda acc, i: chunk(acc, i, steps))["out"]
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPAN))


def long_enough(spans: Column, least: int) -> Column:
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*(n for n, *_ in KINDS), OWNED)))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """Per row of docs (doc_id, text and the columns named as repository and owner): doc_id, row_key,
    base and added (arrays of start, kind, end, value), n_shared (its values that are widely copied).

    A null text is empty. A null repository or owner counts as one of its own. Repeated rows are rows
    of their own. Spans are sorted by start and kind. Other columns are not looked at. An empty table
    gives an empty result. Values leave the scan as sha-256 only.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), text.alias("text"))
    base = [long_enough(found(F.col("text"), i, p, g), least) for i, (_, p, g, least) in enumerate(KINDS)]
    wide = F.filter(found(F.col("text"), len(KINDS), WIDE, 0), lambda s: F.rlike(s["value"], F.lit("[0-9]")) & F.rlike(s["value"], F.lit("[A-Za-z]")))
    hashed = lambda spans: F.transform(spans, lambda s: s.withField("value", F.sha2(s["value"], 256)))
    scanned = rows.select("doc_id", "repository", "owner", F.concat(*base).alias("base"), wide.alias("wide"))
    apart = F.filter("wide", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    scanned = scanned.select("doc_id", "repository", "owner", F.array_sort(hashed(F.col("base"))).alias("base"), hashed(apart).alias("wide"), F.monotonically_increasing_id().alias("row_key"))
    scanned = saved(scanned, "scanned")
    values = saved(scanned.where("size(base) + size(wide) > 0").select("row_key", "repository", "owner", F.explode(F.concat("base", "wide")).alias("span")).select("row_key", "repository", "owner", "span", F.col("span.value").alias("value")), "values")
    # distinct rows of value, owner and repository first, so a value of very many documents is no one task's work
    held = values.select("value", F.coalesce("owner", F.lit("\1")).alias("owner"), F.coalesce("repository", F.lit("\1")).alias("repository")).distinct()
    owners = saved(held.groupBy("value").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories")), "owners")
    shared = (F.col("owners") >= OWNERS) & (F.col("repositories") >= REPOSITORIES) | (F.col("repositories") >= VERY_MANY)
    # both sides are tables, so that the join itself can split the values that very many rows have
    judged = values.join(owners, "value").select("row_key", "span", shared.alias("shared"))
    per_row = judged.groupBy("row_key").agg(
        F.array_sort(F.collect_list(F.when(~F.col("shared") & (F.col("span.kind") == len(KINDS)), F.col("span")))).alias("added"),
        F.count_if("shared").alias("n_shared"),
    )
    return scanned.select("doc_id", "row_key", "base").join(per_row, "row_key", "left").select(
        "doc_id", "row_key", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared")
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each stretch that spans cover replaced by mark; overlapping spans are one stretch."""

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return (
            F.when(s["end"] <= acc["at"], acc)
            .when(s["start"] < acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out")))
            .otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out")))
        )

    done = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), add)
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.lit(2**31 - 1)))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return secret_spans(table(spark, sf_dir, "documents")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), "n_shared",
    )


def _sql_kind(i: int, name: str, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, source, {i} AS kind, '{name}' AS name, s AS start_at, s + length(w) AS end_at, v AS value
    FROM (SELECT doc_id, source, unnest(ws) AS w, unnest(vs) AS v,
                 unnest(list_transform(range(1, len(ws) + 1), lambda i: cast(list_sum(list_transform(gaps[:i], lambda g: length(g))) AS BIGINT)
                        + coalesce(cast(list_sum(list_transform(ws[:i - 1], lambda x: length(x))) AS BIGINT), 0))) AS s
          FROM (SELECT doc_id, source, regexp_extract_all(t, '{p}', 0) AS ws, regexp_extract_all(t, '{p}', {group}) AS vs,
                       regexp_split_to_array(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')))
    WHERE {keep}"""


#: doc_id is unique in the driver's documents.
OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_sql_kind(i, n, p, g, f"length(v) >= {least}") for i, (n, p, g, least) in enumerate(KINDS))}),
wide AS (SELECT * FROM ({_sql_kind(len(KINDS), OWNED, WIDE, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')")}) c
         WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.start_at < c.end_at AND c.start_at < b.end_at)),
everything AS (SELECT * FROM base UNION ALL SELECT * FROM wide),
owners AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS n, count(DISTINCT doc_id) AS r FROM everything GROUP BY value),
judged AS (SELECT e.*, (o.n >= {OWNERS} AND o.r >= {REPOSITORIES}) OR o.r >= {VERY_MANY} AS shared FROM everything e JOIN owners o USING (value)),
rows_of AS (SELECT doc_id, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access, count(*) FILTER (name = 'hex') AS n_hex,
       string_agg(name || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, kind) FILTER (kind < {len(KINDS)}) AS b,
       string_agg(name || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, kind) FILTER (kind < {len(KINDS)} OR NOT shared) AS a,
       count(*) FILTER (shared) AS n_shared FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_shared, 0) AS n_shared
FROM d LEFT JOIN rows_of USING (doc_id)
"""
