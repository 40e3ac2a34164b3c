"""Language-model scoring by subword lattice likelihood.

A fixed public vocabulary weighs all segmentations of a text: piece probabilities come from the training documents, and a
forward recursion in log space gives each word's marginal probability, so the text's (see :mod:`lattice`). Beside it goes
an add-one unigram score over words. Everything is counted over all training documents.

Each distinct word is scored once. The ``HEAD`` most frequent words (of at most ``HEAD_BYTES`` bytes, so the table has a
proven bound) are broadcast, and a document adds them up where it is read; only its other, rare words are shuffled by
word to their counts and scores, so no word is hot. Sums are kept in whole billionths, independent of order.

Defined cases: null text is empty and scores its end alone; rows with a null id train; without training documents all
pieces are equally likely and the counts are zero; repeated rows count and are returned as often as they occur.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm import lattice
from sparkseek.llm._common import cut, drop, map_arrow

HEAD, HEAD_BYTES = 65_536, 64
ALPHA = 0.1
#: Rounds of expectation-maximisation over all words.
EM_ROUNDS = 2
#: Distinct words a worker counts before it passes them on.
FLUSH = 300_000
UNIT = 1e9


def word_table(docs: DataFrame, trains: Column, text: str = "text") -> DataFrame:
    """``(word, c, t)``: occurrences in training and in all documents, by lower-cased word."""
    rows = docs.select(F.col(text).cast("binary").alias("_text"), F.coalesce(trains, F.lit(False)).alias("_trains"))
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("c", T.LongType()), T.StructField("t", T.LongType())])

    def batch(seen: Counter, rest: Counter) -> pa.RecordBatch:
        words = list(seen.keys() | rest.keys())
        c = np.fromiter((seen[w] for w in words), np.int64, len(words))
        t = c + np.fromiter((rest[w] for w in words), np.int64, len(words))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(t)], ["word", "c", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rest = Counter(), Counter()
        for b in batches:
            for t, trains_it in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                (seen if trains_it else rest).update((t.as_py() or b"").lower().split())
                if len(seen) + len(rest) > FLUSH:
                    yield batch(seen, rest)
                    seen, rest = Counter(), Counter()
        yield batch(seen, rest)

    return map_arrow(rows, run, schema).groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


_PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("n", T.DoubleType())])


def _pieces(words: DataFrame, count: Callable[[list[str], np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Piece counts of weighted words, summed over tasks; a row a piece reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size)
        for b in batches:
            found += count([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()], b.column(1).to_numpy().astype(float))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at])], _PIECE.names)

    out = np.zeros(size)
    rows = map_arrow(words, run, _PIECE).groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
    out[rows["piece"].to_numpy(np.int64)] = rows["n"].to_numpy()
    return out


def train_pieces(words: DataFrame, ends: int, path: str, alpha: float = ALPHA, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, float]:
    """(log probabilities by piece, that of the end) from the training counts of all words.

    The public tokenizer's own segmentation of every word gives the first counts, then rounds of expectation-maximisation
    over all segmentations of every word replace them.
    """
    size = len(lattice.load(path)[1])
    trained = words.filter("c > 0").select("word", "c")
    counts = _pieces(trained, lambda texts, c: lattice.piece_counts(path, texts, c), size)
    for _ in range(rounds):
        shipped = words.sparkSession.sparkContext.broadcast(lattice.log_probabilities(counts, path, alpha, float(ends))[0])
        models: list[lattice.Lattice] = []

        def expected(texts: list[str], c: np.ndarray, shipped=shipped, models=models) -> np.ndarray:
            if not models:
                models.append(lattice.Lattice(path, shipped.value[None, :]))
            return models[0].expected(texts, c)

        counts = _pieces(trained, expected, size)
    return lattice.log_probabilities(counts, path, alpha, float(ends))


def word_scores(words: DataFrame, table: np.ndarray, path: str, total: int, distinct: int) -> DataFrame:
    """``(word, t, known, base, lp)``: log10 of the unigram and of the marginal probability, in billionths."""
    shipped = words.sparkSession.sparkContext.broadcast(table)  # one number a piece
    schema = T.StructType([T.StructField("word", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("t", "known", "base", "lp")]])
    shift = log10(total + distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            model = model or lattice.Lattice(path, shipped.value[None, :])
            c = b.column(1).to_numpy()
            lp = model.words([w.decode("utf-8", "replace") for w in b.column(0).to_pylist()])[:, 0] / log(10)
            new = [b.column(2), pa.array((c > 0).astype(np.int64)), pa.array(np.rint((np.log10(c + 1) - shift) * UNIT).astype(np.int64)), pa.array(np.rint(lp * UNIT).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), *new], ["word", "t", "known", "base", "lp"])

    return map_arrow(words.select("word", "c", "t"), run, schema)


def frequent_words(scored: DataFrame) -> DataFrame:
    """The most frequent words, at most ``HEAD`` of at most ``HEAD_BYTES`` bytes.

    The cut is a frequency: a histogram of frequencies by eighths of a power of two says from which on they are few
    enough. Only a row a histogram bin and the words themselves reach the driver.
    """
    short = scored.filter(F.length("word") <= HEAD_BYTES).withColumn("_bin", F.floor(F.log2("t") * 8))
    least, seen = None, 0
    for b, n in sorted(((r[0], r[1]) for r in short.groupBy("_bin").count().collect()), reverse=True):
        if seen + n > HEAD:
            break
        least, seen = b, seen + n
    return short.filter(F.lit(False) if least is None else F.col("_bin") >= least)


def score(docs: DataFrame, trains: Column, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """``keep`` plus n_tokens, n_known, train_tokens, base_score and score of every row."""
    path = path or lattice.vocabulary_path()
    words = cut(word_table(docs, trains, text))
    ends = docs.filter(F.coalesce(trains, F.lit(False))).count()
    total, distinct = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    table, end = train_pieces(words, ends, path)
    scored = cut(word_scores(words, table, path, total, distinct))
    head = {bytes(w): (k, b, p) for w, k, b, p in frequent_words(scored).select("word", "known", "base", "lp").toPandas().itertuples(index=False)}
    shipped = docs.sparkSession.sparkContext.broadcast(head)
    last = (int(ends > 0), round((log10(ends + 1) - log10(total + distinct + 1)) * UNIT), round(end / log(10) * UNIT))
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias("_text"))
    sums = ["n_tokens", "known", "base", "lp"]
    rare = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.IntegerType())]))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_row", T.LongType()), *[T.StructField(c, T.LongType()) for c in sums], T.StructField("rare", rare)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, at = shipped.value, TaskContext.get().partitionId() << 36
        for b in batches:
            cols: list[list[int]] = [[], [], [], []]
            offsets, names, times = [0], [], []
            for t in b.column(len(keep)):
                found = Counter((t.as_py() or b"").lower().split())
                tokens, k, base, lp = 1, *last
                for w, n in found.items():
                    tokens += n
                    one = known.get(w)
                    if one is None:
                        names.append(w)
                        times.append(n)
                    else:
                        k += n * one[0]
                        base += n * one[1]
                        lp += n * one[2]
                for col, x in zip(cols, (tokens, k, base, lp), strict=True):
                    col.append(x)
                offsets.append(len(names))
            pairs = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(times, pa.int32())], ["word", "n"])
            keys = pa.array(np.arange(at, at + b.num_rows, dtype=np.int64))
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], keys, *[pa.array(c, pa.int64()) for c in cols], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], [*keep, "_row", *sums, "rare"])

    parts = cut(map_arrow(rows, run, schema))
    tail = parts.select("_row", F.explode("rare").alias("x")).select("_row", "x.word", "x.n")
    joined = tail.join(scored.select("word", "known", "base", "lp"), "word")
    more = joined.groupBy("_row").agg(*[F.sum(F.col("n") * F.col(c)).alias(f"{c}2") for c in ("known", "base", "lp")])
    out = parts.drop("rare").join(more, "_row", "left")
    both = lambda c: F.col(c) + F.coalesce(f"{c}2", F.lit(0))
    drop(words)
    return out.select(*keep, "n_tokens", both("known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (both("base") / UNIT).alias("base_score"), (both("lp") / UNIT).alias("score"))
