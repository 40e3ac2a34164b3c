"""Quality rules: statistics of each text, fixed limits, and isolation forests over the statistics.

A forest's trees split random features at random values of a bounded sample (``TREES`` samples of ``PSI`` rows, the
smallest hashes; equal rows count once); a row that random splits isolate after few steps is anomalous. All rule statistics
take part, in forms that do not depend on a text's length. What is rare in one respect, such as a clean text with a refrain,
can hide what is bad in another, so beside the forest over all features there is one for each kind of statistic. The cut-off
on each forest's score is calibrated on the labelled rows, all of them, through a histogram of scores by label: the one that
removes the most bad rows while of the good ones no more than the forest's part of ``1 - KEEP_GOOD`` go, the highest of equal
ones. A row goes if any forest removes it.

Defined cases: null text has no words and fails the base rules; without labelled rows of both kinds nothing beyond the
base rules is removed; a doc id labelled both ways counts both ways; repeated rows repeat their result; very long texts are
counted whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm._common import cut, hash_sample, map_arrow

TREES, PSI, SEED = 200, 64, 9
KEEP_GOOD = 0.998
BINS = 1000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Square roots of shares: symbols, and ``!``, ``?`` and ``|``, among the words' characters; lines that repeat among lines with
#: a word; words in repeated windows among words; capitals among characters. Logarithms: mean word length, words a line.
FEATURES = ["symbol_rate", "mark_rate", "capital_rate", "dup_line_rate", "repeat_rate", "word_length", "line_words"]
FORESTS = {"signs": FEATURES[:2], "letters": ["capital_rate", "word_length"], "repeats": FEATURES[3:5], "shape": FEATURES[5:], "all": FEATURES}
_MARKS, _CAPITALS = b"!?|", bytes(range(65, 91))


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pair = ids[:-2] * len(number) + ids[1:-1]
    if len(number) > 2_000_000:  # three numbers would not fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair * len(number) + ids[2:]
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    many = n[back] > 1
    covered = np.zeros(len(words), bool)
    covered[:-2] |= many
    covered[1:-1] |= many
    covered[2:] |= many
    return int(covered.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(the five counts, the forest's features)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    cont = lambda b: len(b) - len(b.translate(None, _CONT))  # noqa: E731  UTF-8 continuation bytes
    chars = sum(map(len, words)) - cont(raw)
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line.split(None, 1):
            lines += 1
            dup += line in seen
            seen.add(line)
    marks, capitals = (len(raw) - len(raw.translate(None, x)) for x in (_MARKS, _CAPITALS))
    repeats = repeat_words(words)
    shares = ((symbols, chars), (marks, chars), (capitals, chars), (dup, lines), (repeats, n))
    return [n, chars, symbols, dup, repeats], [*(math.sqrt(a / max(b, 1)) for a, b in shares), math.log((chars + 1) / (n + 1)), math.log((n + 1) / (lines + 1))]


_CONT = bytes(range(0x80, 0xC0))


def rule_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus the counts, ``base_failed`` and the feature columns of every row."""
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in STATS], *[T.StructField(c, T.DoubleType()) for c in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t.as_py()) for t in b.column(len(keep))]
            counts, features = np.array([x[0] for x in found], np.int64).reshape(-1, len(STATS)), np.array([x[1] for x in found]).reshape(-1, len(FEATURES))
            new = [pa.array(x) for x in [*np.ascontiguousarray(counts.T), *np.ascontiguousarray(features.T)]]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *new], [*keep, *STATS, *FEATURES])

    out = map_arrow(rows, run, schema)
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


class IsolationForest:
    """Random trees over rows; score 2 ** (-mean path / c(psi)), near 1 for anomalies."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.psi = max(2, min(psi, len(sample)))
        self.trees = [self._tree(sample[rng.choice(len(sample), min(psi, len(sample)), replace=False)], rng) for _ in range(trees)] if len(sample) else []

    def _tree(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, value, left, right, length = [], [], [], [], []
        limit = math.ceil(math.log2(self.psi))

        def grow(part: np.ndarray, depth: int) -> int:
            k = len(feature)
            for x in (feature, left, right):
                x.append(-1)
            value.append(0.0)
            length.append(depth + average_path(len(part)))
            lo, hi = (part.min(axis=0), part.max(axis=0)) if len(part) else (None, None)
            if depth < limit and len(part) > 1 and (wide := np.flatnonzero(hi > lo)).size:
                f = int(rng.choice(wide))
                v = float(rng.uniform(lo[f], hi[f]))
                feature[k], value[k] = f, v
                left[k] = grow(part[part[:, f] < v], depth + 1)
                right[k] = grow(part[part[:, f] >= v], depth + 1)
            return k

        grow(rows, 0)
        return np.array(feature), np.array(value), np.array(left), np.array(right), np.array(length)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        for feature, value, left, right, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            live = np.flatnonzero(feature[at] >= 0)
            while len(live):
                node = at[live]
                at[live] = np.where(rows[live, feature[node]] < value[node], left[node], right[node])
                live = live[feature[at[live]] >= 0]
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / average_path(self.psi))


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n values."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


def fit(stats: DataFrame, id_col: str = "doc_id", trees: int = TREES, psi: int = PSI) -> dict[str, IsolationForest]:
    """The forests on the at most ``trees * psi`` rows that pass the base rules and have the smallest hashes."""
    key = F.xxhash64(F.lit(SEED), F.col(id_col), *[F.col(c) for c in FEATURES])
    rows = hash_sample(stats.filter(~F.col("base_failed")), key, trees * psi).orderBy("_hash").select(*FEATURES).toPandas()
    return {name: IsolationForest(rows[own].to_numpy(float), trees, psi) for name, own in FORESTS.items()}


def anomaly_scores(stats: DataFrame, forests: dict[str, IsolationForest]) -> DataFrame:
    """``stats`` without its features, plus ``anomaly``, a score a forest. A forest has at most 2 * TREES * PSI nodes."""
    shipped = stats.sparkSession.sparkContext.broadcast(forests)
    keep = [c for c in stats.columns if c not in FEATURES]
    rows = stats.select(*keep, *FEATURES)
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("anomaly", T.ArrayType(T.DoubleType()))])
    at = {name: [FEATURES.index(c) for c in own] for name, own in FORESTS.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns[len(keep) :]])
            scores = np.column_stack([f.score(x[:, at[name]]) for name, f in shipped.value.items()])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * scores.shape[1], pa.int32()), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists], [*keep, "anomaly"])

    return map_arrow(rows, run, schema)


def cut_off(bins: list[tuple[int, int, int]], spare: float) -> float:
    """From ``(bin, good, bad)`` rows: the score from which the most bad ones go, at most the share ``spare`` of the good ones."""
    good, bad = sum(r[1] for r in bins), sum(r[2] for r in bins)
    best = (0, 2.0)
    if good and bad:
        for t in sorted({int(r[0]) for r in bins}):
            lost, gone = sum(r[1] for r in bins if r[0] >= t), sum(r[2] for r in bins if r[0] >= t)
            if lost <= spare * good and gone > lost and gone >= best[0]:
                best = (gone, t / BINS)
    return best[1]


def calibrate(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", keep_good: float = KEEP_GOOD) -> list[float]:
    """The anomaly score of each forest from which rows go. One row a forest and histogram bin reaches the driver."""
    own = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_q")).filter("_id is not null and _q is not null").distinct()
    passed = scored.filter(~F.col("base_failed")).select(F.col(id_col).alias("_id"), F.posexplode("anomaly").alias("_forest", "_score"))
    passed = passed.select("_id", "_forest", F.floor(F.col("_score") * BINS).alias("_bin"))
    found = passed.join(own, "_id").groupBy("_forest", "_bin").agg(F.sum((F.col("_q") != 0).cast("long")), F.sum((F.col("_q") == 0).cast("long"))).collect()
    return [cut_off([tuple(r)[1:] for r in found if r[0] == k], (1 - keep_good) / len(FORESTS)) for k in range(len(FORESTS))]


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep``, the counts, ``base_failed``, ``anomaly`` (a score a forest) and ``kept`` of every row."""
    stats = cut(rule_statistics(docs, [*dict.fromkeys([*keep, id_col])], text))
    scored = cut(anomaly_scores(stats, fit(stats, id_col)))
    limits = calibrate(scored, labels, id_col)
    low = [F.col("anomaly")[k] < F.lit(limit) for k, limit in enumerate(limits)]
    kept = ~F.col("base_failed")
    for one in low:
        kept &= one
    return scored.select(*keep, *STATS, "base_failed", "anomaly", kept.alias("kept"))
