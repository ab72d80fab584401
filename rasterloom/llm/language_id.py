"""Language identification by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; runs of anything but letters become one space. Its n-grams of 1 to 3
characters are hashed into a fixed number of columns. The log-probability matrix (languages x
columns, single precision) has a fixed size and is broadcast. A batch of texts is scored together: the
n-grams of all its texts, one after the other, gather their rows of the matrix, which are added up per text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import table

COLUMNS, ORDERS = 1 << 16, (1, 2, 3)
#: The bounded sample the model is fitted on: about so many labelled documents a language, by a hash
#: of their id. A language of fewer documents gives all of them.
FIT_DOCUMENTS = 2_000
#: Most languages of a model; the matrix then has LANGUAGES x COLUMNS x 4 bytes = 64 MB at most.
LANGUAGES = 256
#: N-grams that are scored at a time, and tasks that count the sample's.
GATHERED, COUNTING = 1 << 16, 8
UNKNOWN = "und"

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case letters, each run of other characters as one space, a space at both ends; "" without letters."""
    kept = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    return f" {kept} " if any(c.isalpha() for c in kept[:64]) or any(map(str.isalpha, kept)) else ""


def columns(text: str) -> np.ndarray:
    """The hash columns of all n-grams of letters(text)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in ORDERS:
        h = (h[: len(c) - n + 1] + c[n - 1 :] + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append(h & np.uint32(COLUMNS - 1))
    return np.concatenate(out)


@dataclass
class Model:
    """names: languages in order; prior: their log shares; grams: log P(column | language), a row a language."""

    names: list[str]
    prior: np.ndarray
    grams: np.ndarray

    @staticmethod
    def of(counts: dict[str, tuple[int, np.ndarray]]) -> Model:
        names = sorted(counts)
        docs = np.array([counts[k][0] for k in names], float)
        grams = np.array([counts[k][1] for k in names], float).reshape(len(names), COLUMNS) + 0.5
        return Model(names, np.log(docs / docs.sum()), np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32))

    def predictions(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Of each text the likeliest language and its share of probability, tempered: the log odds of a
        text are divided by the square root of its n-grams, which overlap and so are far from independent."""
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.names:
            return out
        which, held, size = [], [], 0

        def scored() -> None:
            n = np.array([len(c) for c in held])
            ends = np.cumsum(n)
            total = np.zeros((len(held), len(self.names)))
            every = np.concatenate(held)
            for lo in range(0, size, GATHERED):  # a long text's rows are gathered part by part
                at = every[lo : lo + GATHERED]
                first = np.searchsorted(ends, lo, "right")
                begins = np.maximum(ends - n - lo, 0)
                some = np.flatnonzero((begins < len(at)) & (ends > lo) & (np.arange(len(n)) >= first))
                for k, row in enumerate(self.grams):
                    total[some, k] += np.add.reduceat(row[at], begins[some], dtype=np.float64)
            odds = total + self.prior
            best = odds.argmax(1)
            share = 1 / np.exp((odds - odds.max(1, keepdims=True)) / np.sqrt(n)[:, None]).sum(1)
            for i, k, p in zip(which, best.tolist(), share.tolist()):
                out[i] = (self.names[k], p)

        for i, text in enumerate(texts):
            if known := letters(text):
                which.append(i)
                held.append(columns(known))
                size += len(held[-1])
                if size >= GATHERED:
                    scored()
                    which, held, size = [], [], 0
        if held:
            scored()
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predictions([text])[0]


def in_fold(doc_id, fold: int = 2, folds: int = 4):
    """crc32(doc_id as text) mod folds = fold."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold


def fit(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> Model:
    """A model from labelled docs (doc_id, text, lang): per language, the rows whose hash of doc_id is in
    the share that gives fit_documents rows. Rows without language or letters are left out."""
    labelled = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    # the shares come from one narrow column, summed before they are shuffled
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    cuts = [(lang, min(1 << 31, math.ceil(fit_documents / n * (1 << 31)))) for lang, n in sizes.items()]
    cuts = F.broadcast(docs.sparkSession.createDataFrame(cuts, "lang string, cut long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if known := letters(text):
                    own = found.setdefault(lang, [0, np.zeros(COLUMNS, np.int64)])
                    own[0] += 1
                    own[1] += np.bincount(columns(known), minlength=COLUMNS)
        yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([zlib.compress(v[1].tobytes(), 1) for v in found.values()], pa.binary())], ["lang", "docs", "grams"])

    # every task of the scan filters; what is left has a bounded size, and so have its counts
    sample = labelled.join(cuts, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.col("cut")).select("text", "lang")
    counts: dict[str, tuple[int, np.ndarray]] = {}
    for lang, n, grams in sample.repartition(COUNTING).mapInArrow(count, "lang string, docs long, grams binary").collect():
        old = counts.get(lang, (0, 0))
        counts[lang] = (old[0] + n, old[1] + np.frombuffer(zlib.decompress(bytes(grams)), np.int64))
    return Model.of(counts)


def language_id(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text).

    Null, empty and letterless texts are und with score 0, and so is every text under a model of no
    language. Equal odds go to the language first in code point order. held_out is null where doc_id
    is. Repeated rows are rows of their own; other columns are not looked at. Long texts are scored
    whole, block by block. There is no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predictions(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold("doc_id").alias("held_out"), "text").mapInArrow(run, PREDICTED)


def language_of(model: Model, text: Column) -> Column:
    """The predicted language and its score as a struct, for plans that keep all other columns of a row."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        found = shared.value.predictions(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang", "score"])

    return predicted(text)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(docs, fit(docs.where(~in_fold("doc_id"))))
