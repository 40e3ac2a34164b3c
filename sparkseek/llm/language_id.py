"""Language identification by segmentation-marginalised unigrams.

Each language has its own piece probabilities over one fixed public vocabulary. A text's score under a language is the
sum of its words' log marginal probabilities (see :mod:`lattice`); the prediction is the best language and its posterior
under equal priors. Words are maximal runs without ASCII white space, digits or punctuation, lower-cased.

Training is on a bounded sample of labelled rows: at most ``PER_LANGUAGE`` documents of each language, those with the
smallest hashes; equal rows count once. Every language is learned. A text is scored under ``LANGUAGES`` languages at a time,
and beyond that in one pass for each block of languages, so a worker's model has a fixed size. Prediction reads every whole
text, and only the text.

Defined cases: null text or text without a letter is ``und`` with score 0, as is any text when nothing was learned;
equal scores take the smallest language name; characters outside the vocabulary are spelled as bytes; rows with null id
train; very long texts are scored whole. Columns of the input that are not named do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm import lattice
from sparkseek.llm._common import cut, map_arrow

PER_LANGUAGE = 1500
#: Languages of one pass over the texts.
LANGUAGES = 64
ALPHA = 0.1
UNKNOWN = "und"
#: Scores (of words under languages) that a worker keeps; the table is emptied when full.
CACHE = 1_600_000
#: Texts that a worker scores at a time.
BLOCK = 2000
_CLEAN = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_LETTER = re.compile("[A-Za-z]")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_CLEAN).split()


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(c.isalpha() for c in text))


def sample(docs: DataFrame, lang: str, id_col: str, text: str = "text", per_language: int = PER_LANGUAGE) -> DataFrame:
    """``(lang, text)`` of at most ``per_language`` labelled rows of each language, those with the smallest hashes.

    A filter on the hash, set by an estimate of the language's distinct ones, leaves about that many rows of each language
    before any are ranked, so a language with most of the rows is no larger a task than another.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(id_col), F.col(text)).alias("h"))
    rows = rows.filter("lang is not null and text is not null")
    slim = cut(rows.select("lang", "h"))
    share = F.lit(1.1 * per_language + 1000) / F.col("distinct")
    sizes = slim.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("distinct"))
    limits = _small(sizes.select("lang", (F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), share)).alias("limit")))
    near = slim.join(limits, "lang").filter(F.col("h").cast("double") <= F.col("limit")).select("lang", "h").distinct()
    ranked = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    last = _small(ranked.filter(F.col("r") <= per_language).groupBy("lang").agg(F.max("h").alias("last")))
    return rows.join(last, "lang").filter("h <= last").dropDuplicates(["lang", "h"]).select("lang", "text")


def _small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A row a language: broadcast where a count shows that these are few."""
    table = cut(table)
    return F.broadcast(table) if table.count() <= most else table


class Model:
    """Piece counts by language; tables of log probabilities are made for some languages at a time."""

    def __init__(self, names: list[str], counts: DataFrame, path: str) -> None:
        self.names, self.counts, self.path = names, counts, path

    def blocks(self, size: int) -> Iterator[tuple[list[str], np.ndarray]]:
        """(languages, log probabilities by language and piece), at most ``size`` languages each; one empty block of none."""
        pieces = len(lattice.load(self.path)[1])
        for lo in range(0, max(1, len(self.names)), size):
            names = self.names[lo : lo + size]
            found = self.counts.filter(F.col("lang").isin(names)).toPandas() if names else None
            tables = np.zeros((len(names), pieces))
            for k, name in enumerate(names):
                own, counts = found[found["lang"] == name], np.zeros(pieces)
                counts[own["piece"].to_numpy()] = own["n"].to_numpy()
                tables[k] = lattice.log_probabilities(counts, self.path, ALPHA)[0]
            yield names, tables


def train(docs: DataFrame, lang: str = "lang", id_col: str = "doc_id", text: str = "text", path: str | None = None, **bounds: int) -> Model:
    """Piece counts of every language; the names reach the driver."""
    path = path or lattice.vocabulary_path()
    rows = sample(docs, lang, id_col, text, **bounds)
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("piece", T.IntegerType()), T.StructField("n", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[str, Counter] = {}
            for one, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.setdefault(one, Counter()).update(words_of(text))
            for one, counter in seen.items():
                counts = lattice.piece_counts(path, [w.decode("utf-8", "replace") for w in counter], np.array(list(counter.values()), float))
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at])], ["lang", "piece", "n"])

    found = cut(map_arrow(rows, run, schema).groupBy("lang", "piece").agg(F.sum("n").alias("n")))
    return Model(sorted(r[0] for r in found.select("lang").distinct().collect()), found, path)


class Scorer:
    """For texts: the best of some languages, its log probability, and the log of the sum over these languages."""

    def __init__(self, names: list[str], tables: np.ndarray, path: str) -> None:
        self.names = names
        self.words = lattice.WordScores(lattice.Lattice(path, tables), max(1, CACHE // len(names))) if names else None

    def score(self, texts: list[str | None]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """Texts without a letter, and all if there are no languages, have no best language."""
        known = np.array([bool(self.names) and has_letter(t) for t in texts], bool)
        if not known.any():
            return [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        total = self.words.totals([Counter(words_of(t)) if k else {} for t, k in zip(texts, known, strict=True)])
        best, top = total.argmax(axis=1), total.max(axis=1)
        return [self.names[i] if k else None for i, k in zip(best, known, strict=True)], top, top + np.log(np.exp(total - top[:, None]).sum(axis=1))


def predict(docs: DataFrame, keep: list[str], model: Model, text: str = "text") -> DataFrame:
    """``keep`` plus ``lang_pred`` and ``score`` of every row; a broadcast holds at most ``LANGUAGES`` x pieces numbers."""
    path = model.path
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    k = len(keep)
    sofar = [T.StructField("_lang", T.StringType()), T.StructField("_top", T.DoubleType()), T.StructField("_all", T.DoubleType())]
    judged = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    blocks = max(1, -(-len(model.names) // LANGUAGES))
    for nth, block in enumerate(model.blocks(LANGUAGES), 1):
        shipped, last = docs.sparkSession.sparkContext.broadcast(block), nth == blocks
        schema = T.StructType([*rows.schema.fields[:k], *(judged if last else [rows.schema.fields[k], *sofar])])

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, last=last, names=schema.names) -> Iterator[pa.RecordBatch]:
            scorer = Scorer(*shipped.value, path)
            for b in batches:
                found = [scorer.score(b.column(k).slice(lo, BLOCK).to_pylist()) for lo in range(0, b.num_rows, BLOCK)]
                lang, top, whole = [x for f in found for x in f[0]], *(np.concatenate([f[i] for f in found] or [np.zeros(0)]) for i in (1, 2))
                if b.num_columns > k + 1:  # earlier languages have smaller names, so they keep equal scores
                    was, was_top = b.column(k + 1).to_pylist(), b.column(k + 2).to_numpy()
                    lang = [x if up else old for x, old, up in zip(lang, was, top > was_top, strict=True)]
                    top, whole = np.maximum(top, was_top), np.logaddexp(whole, b.column(k + 3).to_numpy())
                if last:
                    score = np.where([x is not None for x in lang], np.exp(top - whole), 0.0) if lang else np.zeros(0)
                    new = [pa.array([UNKNOWN if x is None else x for x in lang], pa.string()), pa.array(score)]
                else:
                    new = [b.column(k), pa.array(lang, pa.string()), pa.array(top), pa.array(whole)]
                yield pa.RecordBatch.from_arrays([*b.columns[:k], *new], names)

        rows = map_arrow(rows, run, schema)
        rows = rows if last else cut(rows)
    return rows


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % k
