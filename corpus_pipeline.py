"""A pipeline over documents: language id, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of docs, extra ones included.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.best_fit import best_fit_packing
from rasterloom.llm.common import drop_saved, drop_scratch, saved, scratch_left
from rasterloom.llm.jaccard_join import jaccard_components
from rasterloom.llm.language_id import COLUMNS, UNKNOWN, Model, fit, in_fold, language_of
from rasterloom.llm.secrets import redacted, secret_spans
from rasterloom.llm.source_mix import source_mix

#: A language is told where it is at least as likely as all others together.
LEAST_SCORE = 0.5


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that no column of docs has."""
    out: list[str] = []
    for name in names:
        while name.lower() in {c.lower() for c in (*docs.columns, *out)}:
            name = "_" + name
        out.append(name)
    return out


def stage(work):
    """A stage whose scratch tables go when the next one begins: by then its result is written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, *(p for p in _used if p in scratch_left()))
        before = set(scratch_left())
        out = work(spark, docs, sf_dir)
        _used[:] = [p for p in scratch_left() if p not in before]
        return out

    run.__doc__, run.__name__ = work.__doc__, work.__name__
    return run


_used: list[str] = []


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """(docs with a number for each row, written once, so that it is the same wherever it is read; its name)."""
    [row] = fresh(docs, "row_number")
    return saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def with_text(docs: DataFrame, text) -> DataFrame:
    """docs with another text, and n_chars, where there is one, to match."""
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, by a model fitted on three of four folds; a null lang becomes the
    predicted one. Rejected are texts without letters, and those of which no language is as likely as all
    others together (a score below LEAST_SCORE). Where those folds name no language, there is nothing to tell: only
    texts without letters go, and lang stays null."""
    model = fit(docs.where(~in_fold("doc_id")))
    known = bool(model.names)
    if not known:
        model = Model.of({"any": (1, np.zeros(COLUMNS))})
    [found] = fresh(docs, "found_language")
    told = docs.withColumn(found, language_of(model, F.col("text"))).where((F.col(found)["lang"] != UNKNOWN) & (F.col(found)["score"] >= LEAST_SCORE))
    return told.select(*(F.coalesce(c, F.col(found)["lang"]).alias(c) if c == "lang" and known else F.col(f"`{c}`") for c in docs.columns))


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar ones (five words, 0.8): that of the smallest id, null after all
    others. Rows of equal or null ids are rows of their own. Texts without words stay."""
    rows, row = numbered(docs)
    groups = jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), words=5, num=4, den=5).select(F.col("doc_id").alias(row), "component_id")
    members = saved(rows.select(row, "doc_id").join(groups, row), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))[row].alias(row))
    dropped = saved(members.join(first, row, "left_anti").select(row), "dropped")
    # a merge at any size: the ids grow with the documents
    return rows.join(dropped.hint("merge"), row, "left_anti").select(*(f"`{c}`" for c in docs.columns))


@stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    rows, row = numbered(docs)
    [own] = fresh(rows, "own_spans")
    spans = secret_spans(rows.select(F.col(row).alias("doc_id"), "source", "text")).select(F.col("doc_id").alias(row), F.concat("base", "added").alias(own))
    spans = saved(spans.where(F.size(own) > 0), "spans")
    text = F.when(F.col(own).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(own)))
    return with_text(rows.join(spans.hint("merge"), row, "left"), text).select(*(f"`{c}`" for c in docs.columns))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row for each time that words of a document are taken. A row that takes
    all its words keeps its text; one that takes some has their runs. Texts without words go."""
    rows, row = numbered(docs)
    turn, runs_of, words_of = fresh(rows, "own_turn", "own_runs", "own_words")
    _, mix = source_mix(rows.select(F.col(row).alias("doc_id"), "source", "text"))
    runs = mix.groupBy(F.col("doc_id").alias(row), "first_word").agg(F.first("n_words").alias("n"), F.count("*").alias("times"))
    turns = runs.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    taken = turns.groupBy(row, turn).agg(F.array_sort(F.collect_list(F.struct("first_word", "n"))).alias(runs_of), F.sum("n").alias(words_of))
    taken = saved(taken.select(row, runs_of, words_of), "taken")
    words = F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    some = F.array_join(F.flatten(F.transform(runs_of, lambda r: F.slice(words, r["first_word"].cast("int") + 1, r["n"].cast("int")))), " ")
    text = F.when(F.col(words_of) == size, F.col("text")).otherwise(some)
    return with_text(rows.join(taken.hint("merge"), row), text).select(*(f"`{c}`" for c in docs.columns))


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids."""
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard", near_duplicates),
    ("secret_scan", secrets),
    ("source_mix", mixing),
    ("best_fit_packing", packing),
]

#: Language, shingle components and tokens are not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, work in STAGES[:-1]:
        before, docs = docs, saved(work(spark, docs, sf_dir), name)
        drop_saved(before)
    return STAGES[-1][1](spark, docs, sf_dir)
