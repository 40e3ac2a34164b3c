"""Near copies of texts: every pair of a five-word Jaccard similarity of 0.8 or more, as connected components.

Texts of the same set of shingles are one class. Classes that agree on a band of four min-hashes share a shard, and a
BK-tree over their SimHash fingerprints finds the pairs within ``RADIUS`` bits. Both steps only propose: a pair links when
the exact similarity of its two shingle sets reaches the limit. A pair at exactly 0.8 is missed with a chance of about
3e-5 by the bands and 1e-4 by the radius, more similar ones less.

A pair that the tree finds is proposed only if the parity bitmaps of its sets allow a link. Each shingle flips one bit, so
the bitmaps of two sets differ in no more bits than the sets differ in shingles: the test loses no link, and pairs that are
alike but clearly below the limit end there, where they are found, instead of as rows. Bitmaps have four to eight bits a
shingle; one of twice the size folds onto the other.

Proposals come in two rounds, since a large group of near copies has too many pairs to list. The first verifies a spanning
forest of each shard, nearest pairs first; the second lists every pair of a shard whose classes are still apart.

Defined cases: null or wordless text has the empty set, so all of them are one class; text under five words is one shingle,
its whole word sequence; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm._common import connected_components, cut, drop, map_arrow, partitions
from sparkseek.llm.simhash import _EDGE, Forest, _groups

SHINGLE = 5
#: The least similarity of a link, as a fraction of whole numbers.
LEAST = (4, 5)
BANDS, WIDTH = 20, 4
#: Expected distance at the limit is 10 to 12 bits, with a deviation of about 3.
RADIUS = 24
#: Radii of the first round: near pairs enter the forest before far ones.
RISING = (4, 10, 16, RADIUS)
#: Classes of one shard that one task takes at a time.
CHUNK = 1024
#: Bits of a bitmap at most; sets of more than a fourth as many shingles are told apart less sharply before the verification.
MOST_BITS = 65_536
_PIECE = 16_384
#: Rows that a task gathers before it works on them, and 64-bit words of bitmaps that it compares at a time.
_BATCH, _WORDS = 10_000, 4_000_000
_rng = np.random.default_rng(42)
_MUL = _rng.integers(0, 2**64, BANDS * WIDTH, np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, BANDS * WIDTH, np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (XXH64, seed 42) of the A-Z lower-cased words' shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, ends = b" ".join(words), [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    size = min(size, len(words))
    digest, starts = xxhash.xxh64_intdigest, [0, *(e + 1 for e in ends)]
    return np.unique(np.fromiter((digest(line[s:e], 42) for s, e in zip(starts, ends[size - 1 :], strict=False)), np.uint64))


def similar(a: int, b: int, common: int) -> bool:
    """Whether sets of ``a`` and ``b`` shingles with ``common`` shared ones reach the limit."""
    return LEAST[1] * common >= LEAST[0] * (a + b - common)


def sketch(s: np.ndarray) -> tuple[int, int, list[int]]:
    """Of a shingle set: its hash, its SimHash and its band keys; the empty set has no bands."""
    counts, least = np.zeros(64, np.int64), np.full(BANDS * WIDTH, 2**64 - 1, np.uint64)
    for k in range(0, len(s), _PIECE):
        part = s[k : k + _PIECE]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (part[:, None] * _MUL + _ADD).min(axis=0))
    fp = int(np.packbits(counts * 2 > len(s), bitorder="little").view(np.uint64)[0])
    keys = [xxhash.xxh64_intdigest(band.tobytes()) for band in least.reshape(BANDS, WIDTH)] if len(s) else []
    return xxhash.xxh3_64_intdigest(s.tobytes()), fp, keys


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap (64-bit words) of a shingle set: each shingle flips the bit of its lowest hash bits."""
    bits = min(max(64, 1 << (4 * len(s) - 1).bit_length()), MOST_BITS) if len(s) else 64
    flips = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def allowed(a: np.ndarray, b: np.ndarray, n: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
    """Which pairs of row numbers (a, b), of sets of ``n`` shingles each, may be similar by their bitmaps."""
    words = np.fromiter(map(len, maps), np.int64, len(maps))
    level, ok = np.minimum(words[a], words[b]), np.zeros(len(a), bool)
    for w in np.unique(level):
        at = np.flatnonzero(level == w)
        rows, back = np.unique(np.r_[a[at], b[at]], return_inverse=True)
        table = np.empty((len(rows), w), np.uint64)
        for k, r in enumerate(rows):
            table[k] = np.bitwise_xor.reduce(maps[r].reshape(-1, w), axis=0)
        left, right = back[: len(at)], back[len(at) :]
        most = (LEAST[1] - LEAST[0]) * (n[a[at]] + n[b[at]])
        for lo in range(0, len(at), step := max(1, _WORDS // int(w))):
            part = slice(lo, lo + step)
            differ = np.bitwise_count(table[left[part]] ^ table[right[part]]).sum(axis=1, dtype=np.int64)
            ok[at[part]] = (LEAST[1] + LEAST[0]) * differ <= most[part]
    return ok


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def sketches(docs: DataFrame, row: str, text: str = "text") -> DataFrame:
    """(row, sid, fp, n, bands, bits) of every row."""
    rows = docs.select(F.col(row), F.col(text).cast("binary").alias("_text"))
    longs = [T.StructField(c, T.LongType()) for c in ("sid", "fp", "n")]
    schema = T.StructType([rows.schema.fields[0], *longs, T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, made, maps = [], [], []
            for t in b.column(1):
                s = shingles(t.as_py())
                sizes.append(len(s))
                made.append(sketch(s))
                maps.append(parity(s).tobytes())
            bands = pa.array([_signed(m[2]) for m in made], pa.list_(pa.int64()))
            cols = [b.column(0), pa.array(_signed([m[0] for m in made])), pa.array(_signed([m[1] for m in made])), pa.array(sizes, pa.int64()), bands, pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema.names)

    return map_arrow(rows, run, schema)


def _sets(docs: DataFrame, reps: DataFrame, row: str, text: str) -> DataFrame:
    """(sid, set) of the classes ``reps(row, sid)``, from the text of the row that stands for each."""
    rows = docs.select(F.col(row), F.col(text).cast("binary").alias("_text")).join(reps, row).select("sid", "_text")
    schema = T.StructType([T.StructField("sid", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], schema.names)

    return map_arrow(rows, run, schema)


def spanning(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (a, b) that join two sets of ``parent``, none twice; ``parent`` is united and stays flat."""
    used_a, used_b = [a[:0]], [b[:0]]
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return np.concatenate(used_a), np.concatenate(used_b)
        a, b, high, low = a[apart], b[apart], np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
        high, at = np.unique(high, return_index=True)
        used_a.append(a[at])
        used_b.append(b[at])
        parent[high] = low[at]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _pairs(group: np.ndarray, tree: np.ndarray, fp: np.ndarray, n: np.ndarray, label: np.ndarray, maps: list[np.ndarray], every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Proposed pairs of row numbers: all between two labels, or a forest that spans them."""
    nodes = np.flatnonzero(tree)
    value = fp.view(np.uint64)
    forest = Forest(group[nodes], value[nodes])
    has_other = np.zeros(group.max() + 1, bool)
    has_other[group[~tree]] = True
    ask = np.flatnonzero(np.where(has_other[group], ~tree, True))
    parent = np.arange(len(fp))
    for radius in (RADIUS,) if every else RISING:
        for q, node in forest.search(group[ask], value[ask], radius):
            a, b = ask[q], nodes[node]
            # what is joined already needs no more pairs, and sets too different in size cannot be similar
            apart = label[a] != label[b] if every else parent[a] != parent[b]
            ok = apart & (a != b) & (LEAST[1] * np.minimum(n[a], n[b]) >= LEAST[0] * np.maximum(n[a], n[b]))
            a, b = a[ok], b[ok]
            ok = allowed(a, b, n, maps)
            a, b = a[ok], b[ok]
            yield (a, b) if every else spanning(parent, a, b)


def proposals(members: DataFrame, bits: DataFrame, rows: int, every: bool) -> DataFrame:
    """``members(t, key, m, sid, fp, n, label)`` -> pairs (a, b) of classes that share a shard and may be similar, a < b.

    A shard of ``m`` chunks is dealt into its pairs of chunks, and ``bits(sid, bits)`` join the members before.
    """
    dealt = members.join(bits, "sid").withColumn("s", F.pmod(F.xxhash64("sid"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("t", "key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "sid", "fp", "n", "label", (F.col("s") <= F.col("o")).alias("tree"), "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key, i, j, sid, fp, n, label, tree, raw in _groups(batches, _BATCH):
            new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            if not many.any():
                continue
            sid, maps = sid[many], [np.frombuffer(x, np.uint64) for x in raw[many]]
            for a, b in _pairs(group[many], tree[many], np.ascontiguousarray(fp[many]), n[many], label[many], maps, every):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[a], sid[b])), pa.array(np.maximum(sid[a], sid[b]))], ["a", "b"])

    by = ["t", "key", "i", "j"]
    count = partitions(members.sparkSession, rows * BANDS, 2_000_000)
    return map_arrow(dealt.repartition(count, *by).sortWithinPartitions(*by), run, _EDGE).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose shingle sets reach the limit."""
    a, b = (sets.select(F.col("sid").alias(c), F.col("set").alias(f"_{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b")
    common = both.withColumn("_c", F.size(F.array_intersect("_a", "_b")))
    return common.filter(similar(F.size("_a"), F.size("_b"), F.col("_c"))).select("a", "b")


def near_copies(docs: DataFrame, row: str, text: str = "text") -> DataFrame:
    """(row, component) of every row; ``row`` tells the rows apart, ``component`` is never null."""
    prints = cut(sketches(docs, row, text))
    classes = cut(prints.groupBy("sid").agg(*[F.first(c).alias(c) for c in ("fp", "n", "bands", "bits")], F.min(row).alias(row)))
    rows = classes.count()
    keyed = classes.select("sid", "fp", "n", F.posexplode("bands").alias("t", "key"))
    shared = keyed.groupBy("t", "key").count().filter("count > 1").select("t", "key", F.ceil(F.col("count") / CHUNK).cast("int").alias("m"))
    members = cut(keyed.join(shared, ["t", "key"]).withColumn("label", F.col("sid")))
    bits = classes.select("sid", "bits")
    first = cut(proposals(members, bits, rows, every=False))
    # a class of any proposal is in the forest of its shard, so no other class comes up in the second round
    named = cut(first.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    sets = cut(_sets(docs, classes.select(row, "sid").join(named, "sid"), row, text))
    links = cut(verified(first, sets))
    found = cut(connected_components(links))
    labels = named.join(found, F.col("sid") == F.col("node"), "left").select("sid", F.coalesce("component", "sid").alias("label"))
    again = cut(members.drop("label").join(labels, "sid"))
    apart = again.groupBy("t", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("t", "key")
    second = proposals(again.join(apart, ["t", "key"], "left_semi"), bits, rows, every=True).join(first, ["a", "b"], "left_anti")
    whole = cut(connected_components(links.unionByName(verified(cut(second), sets))))
    out = cut(prints.select(row, "sid").join(whole, F.col("sid") == F.col("node"), "left").select(row, F.coalesce("component", "sid").alias("component")))
    for table in (prints, classes, members, first, named, sets, links, found, again, whole):
        drop(table)
    return out
