"""Secret scans: fixed patterns, then character Markov models of random strings against ordinary identifiers.

Both models are first-order chains over characters: a candidate is a run of ``[A-Za-z0-9+/_=-]`` of 20 or more
characters, without what a pattern's span covers; its score is the log-likelihood ratio per character, random over
ordinary. The models are trained on labelled strings: values that the patterns found and seeded random strings (base 62,
hex and base 64) on one side, words and identifiers of the documents on the other. The threshold lies above the score of
every held-out ordinary string and at least at ``LEAST``; so prose and identifiers stay.

The sample is bounded: ``SAMPLE_DOCS`` documents with the smallest hashes; equal rows count once. All their strings count,
whole, each distinct one once; only transition counts and one score reach the driver. Every whole text is scanned.

Defined cases: null text is empty and has no spans; repeated rows repeat their result; spans count code points, the end
exclusive; the method's spans never overlap the patterns'; without rows the random strings alone train.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm._common import cut, hash_sample, map_arrow

ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_WORDS = ("pass", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS = ("assign", "access", "hex", "markov")
SAMPLE_DOCS = 2000
SEED = 8
LEAST = 0.5
#: What the lines of strings for training hold.
ORDINARY, SECRET, HELD = range(3)
_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_INDEX = {c: i for i, c in enumerate(_ALPHABET)}
_CODES = np.full(128, 0, np.int64)
for _c, _i in _INDEX.items():
    _CODES[ord(_c)] = _i


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(character numbers of all strings in a row, number of the string by character, places of the first characters)."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    ids = _CODES[np.frombuffer("".join(strings).encode("ascii"), np.uint8)]
    return ids, np.repeat(np.arange(len(strings)), sizes), np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]


def transitions(strings: list[str]) -> np.ndarray:
    """Counts of a first-order chain; the last row counts first characters."""
    n = len(_ALPHABET)
    ids, owner, first = _codes(strings)
    inside = owner[1:] == owner[:-1]
    counts = np.bincount(ids[:-1][inside] * n + ids[1:][inside], minlength=n * (n + 1))
    return (counts + np.bincount(n * n + ids[first], minlength=n * (n + 1))).reshape(n + 1, n)


def log_probabilities(counts: np.ndarray, alpha: float = 0.2) -> np.ndarray:
    return np.log((counts + alpha) / (counts + alpha).sum(axis=1, keepdims=True))


def ratios(table: np.ndarray, strings: list[str]) -> np.ndarray:
    """Log-likelihood ratio per character of strings that are not empty; ``table`` is random minus ordinary."""
    ids, owner, first = _codes(strings)
    worth = np.r_[0.0, table[ids[:-1], ids[1:]]] if len(ids) else np.zeros(0)
    worth[first] = table[-1, ids[first]]
    return np.bincount(owner, worth, len(strings)) / np.bincount(owner, minlength=len(strings))


def ratio(table: np.ndarray, s: str) -> float:
    return float(ratios(table, [s])[0])


def random_strings(n: int = 3000, seed: int = SEED) -> list[str]:
    rng = random.Random(seed)
    kinds = (string.ascii_letters + string.digits, "0123456789abcdef", _ALPHABET, string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    return ["".join(rng.choices(kinds[i % len(kinds)], k=rng.randint(20, 48))) for i in range(n)]


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, float]:
    """(log ratio table, threshold) from a bounded sample of documents."""
    rows = docs.select(F.col(text).alias("t"), F.xxhash64(F.lit(SEED), F.col(id_col), F.col(text)).alias("h")).filter("t is not null")
    last = hash_sample(rows.select("h"), F.col("h"), sample_docs).agg(F.max("_hash")).first()[0]
    counts, worst = np.zeros((2, len(_ALPHABET) + 1, len(_ALPHABET))), 0.0
    table = lambda: log_probabilities(counts[SECRET] + transitions(random_strings())) - log_probabilities(counts[ORDINARY])
    if last is None:
        return table(), LEAST
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("s", T.StringType())])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                found = sorted(set(labelled(t.as_py())))
                kinds, values = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string())], schema.names)

    picked = rows.filter(F.col("h") <= last).dropDuplicates(["h"]).select("t")
    picked = cut(map_arrow(picked, strings, schema).distinct())
    sums = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column(0).to_numpy()
            for kind in (ORDINARY, SECRET):
                found = transitions(b.column(1).filter(pa.array(kinds == kind)).to_pylist()).ravel()
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(found[at])], sums.names)

    for kind, cell, n in map_arrow(picked, count, sums).groupBy("kind", "cell").agg(F.sum("n")).collect():  # a row a transition
        counts[kind].reshape(-1)[cell] = n
    trained = table()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(ratios(trained, b.column(0).to_pylist()))], ["r"])

    held = picked.filter((F.col("kind") == HELD) & (F.length("s") >= 20)).select("s")
    worst = map_arrow(held, score, T.StructType([T.StructField("r", T.DoubleType())])).agg(F.max("r")).first()[0]
    return trained, max(LEAST, (worst or 0.0) + 0.1)


def labelled(text: str) -> Iterator[tuple[int, str]]:
    """Strings to learn from: values of the patterns' spans, and words outside them, of letters only or joined by ``_-/``.

    A fourth of the words, by their hashes, is held out. Neighbours by name make longer strings: two that train become an
    identifier, two that are held out one word.
    """
    spans = base_spans(text)
    for start, _, end in spans:
        for m in CANDIDATE.finditer(text[start:end]):
            yield SECRET, m[0]
    at, words = 0, set()
    for start, _, end in [*spans, (len(text), 0, len(text))]:
        words.update(m[0] for m in re.finditer(r"[A-Za-z][A-Za-z]*(?:[_/-][A-Za-z]+)*", text[at:start] if start > at else "") if len(m[0]) >= 3)
        at = max(at, end)
    held = {w for w in words if hashlib.md5(w.encode()).digest()[0] < 64}
    for kind, own, joint in ((ORDINARY, sorted(words - held), "_"), (HELD, sorted(held), "")):
        yield from ((kind, w) for w in own)
        yield from ((kind, joint.join(p)) for p in zip(own, own[1:], strict=False))


def scan(text: str, table: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """All spans of a text: the patterns' and the method's."""
    base = base_spans(text)
    more = []
    for m in CANDIDATE.finditer(text):
        at, whole = m.start(), ratio(table, m[0]) > threshold
        # the base spans are cut out; a part is a span if it scores as random, a short one only within such a run
        for a, b in [*sorted((a, b) for a, _, b in base if a < m.end() and m.start() < b), (m.end(), m.end())]:
            part = text[at:a]
            if part and (whole or len(part) >= 20) and ratio(table, part) > threshold:
                more.append((at, 3, a))
            at = max(at, b)
    return sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, keep: list[str], model: tuple[np.ndarray, float], text: str = "text", redact: str | None = None) -> DataFrame:
    """``keep`` plus n_assign, n_access, n_hex, n_markov, base_sha256, spans; with ``redact`` also ``redacted``, the text
    with every span replaced by that string (null where the text is null)."""
    table, threshold = model
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    longs, strings = ["n_assign", "n_access", "n_hex", "n_markov"], ["base_sha256", "spans", *(["redacted"] if redact is not None else [])]
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in longs], *[T.StructField(c, T.StringType()) for c in strings]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: dict[str, list] = {c: [] for c in [*longs, *strings]}
            for t in b.column(len(keep)):
                raw = t.as_py()
                spans = scan(raw or "", table, threshold)
                for k, c in enumerate(longs):
                    cols[c].append(sum(s[1] == k for s in spans))
                cols["base_sha256"].append(hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest())
                cols["spans"].append(joined(spans))
                if redact is not None:
                    cols["redacted"].append(replaced(raw, spans, redact))
            new = [pa.array(cols[c], pa.int64()) for c in longs] + [pa.array(cols[c], pa.string()) for c in strings]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *new], [*keep, *cols])

    return map_arrow(rows, run, schema)


def replaced(text: str | None, spans: list[tuple[int, int, int]], by: str) -> str | None:
    """The text with the union of the spans replaced, each run of overlapping spans once."""
    if text is None or not spans:
        return text
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            out += [text[at:a], by] if end < 0 else [text[end:a], by]
            at = a
        end = max(end, b)
    return "".join([*out, text[end:]])
