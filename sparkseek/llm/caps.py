"""Embedding near-duplicates by spherical-cap filters.

A filter is the cap of all vectors within an angle of a direction. The directions are a structured random product code:
the space is cut into two halves, each half has ``K`` seeded random unit codewords, and every pair of codewords is a
direction. List-decoding finds all directions that exceed the cap's height for a vector without looking at all ``K * K``:
codewords of the first half in falling order of their inner product, and for each only those of the second half that
make up the rest. Vectors are joined on filters and verified by their exact cosine in double precision.

``K`` and the height follow the number of vectors: a vector lies in ``LIST`` caps on average and a cap holds about
``CAP`` vectors of an unclustered table. Vectors of one length are compared; equal vectors are one class. A cap beyond ``CHUNK``
vectors is dealt into chunks, and each pair of chunks is one task. To its caps a vector travels in one byte a component, with
the length of what rounding took: this bounds every cosine from above, so a first pass finds the vectors of a cap that may have
a partner there, and only these are sent whole and verified. A pair that shares several caps is counted in the
smallest one. Links are summed where they are found and reported as a spanning forest: no pair leaves a task.

The filters are probabilistic: recall is measured against brute force in the tests and in the README; no pair below the threshold is ever
linked. Vectors that are null, zero, or hold null or non-finite components link with nothing and are their own component.
Rows with null id keep null as component; an id that repeats is one row each, and its equal vectors are links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm._common import connected_components, cut, map_arrow, partitions

THRESHOLD = 0.95
LIST = 12
#: Every vector lies in this many caps at least: those of its best directions.
MIN_LIST = 12
CAP = 64
CHUNK = 1024
SEED = 10


def code(dim: int, rows: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(codewords of the first half, of the second, height) for ``rows`` vectors of ``dim`` components."""
    share = min(0.25, CAP / max(rows, 1))  # of all vectors in one cap
    k = max(8, math.ceil(math.sqrt(LIST / share)))
    rng = np.random.default_rng([SEED, dim, k])
    halves = []
    for d in (dim - dim // 2, dim // 2):
        words = rng.standard_normal((k, max(d, 1)))
        halves.append(words / np.linalg.norm(words, axis=1, keepdims=True))
    return halves[0], halves[1], NormalDist().inv_cdf(1 - share) / math.sqrt(max(dim, 1))


def decode(unit: np.ndarray, first: np.ndarray, second: np.ndarray, height: float) -> list[np.ndarray]:
    """The filters of each unit vector: all directions that exceed the height, and its ``MIN_LIST`` best at least."""
    h = first.shape[1]
    a = unit[:, :h] @ first.T / math.sqrt(2)
    b = unit[:, h:] @ second.T / math.sqrt(2) if unit.shape[1] > h else np.zeros((len(unit), len(second)))
    k, out = len(second), []
    order_a, order_b = np.argsort(-a, axis=1), np.argsort(-b, axis=1)
    a, b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
    best = (a[:, :MIN_LIST, None] + b[:, None, :MIN_LIST]).reshape(len(unit), -1)
    heights = np.minimum(height, np.sort(best, axis=1)[:, -MIN_LIST])
    for x, y, rows, by, low in zip(a, b, order_a, order_b, heights, strict=True):
        last = int(np.searchsorted(-(x + y[0]), -low, "right"))
        n = np.searchsorted(-y, x[:last] - low, "right")
        take = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(np.sort(np.repeat(rows[:last], n) * k + by[take]))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_HIT = T.StructType([T.StructField(c, T.LongType()) for c in ("cls", "other", "n")])
_NEAR = T.StructType([T.StructField(c, t()) for c, t in (("dim", T.IntegerType), ("f", T.LongType), ("i", T.IntegerType), ("j", T.IntegerType), ("s", T.IntegerType), ("cls", T.LongType))])


def links(classes: DataFrame, threshold: float, rows: int) -> DataFrame:
    """``classes(cls, size, v)`` -> rows (cls, other, n): ``n`` links found, ``other`` a smaller class joined to it, or null."""
    spark = classes.sparkSession
    own = [T.StructField("dim", T.IntegerType()), T.StructField("fs", T.ArrayType(T.LongType())), T.StructField("q", T.ArrayType(T.ByteType())), T.StructField("scale", T.DoubleType()), T.StructField("err", T.DoubleType())]
    schema = T.StructType([*own, *classes.select("cls", "size", "v").schema.fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, tuple] = {}
        for b in batches:
            v = b.column(2)
            dims = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
            starts = np.cumsum(dims) - dims
            filters: list = [None] * len(dims)
            bytes_, scale, err = np.zeros(len(flat), np.int8), np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                codes.setdefault(dim, code(int(dim), rows))
                for part in np.array_split(at, -(-len(at) // 1000)):
                    place = starts[part][:, None] + np.arange(dim)
                    unit = _unit(flat[place])
                    bytes_[place], scale[part], err[part] = _rounded(unit)
                    for k, found in zip(part, decode(unit, *codes[dim]), strict=True):
                        filters[k] = found
            offsets = np.cumsum([0, *map(len, filters)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(filters) if filters else np.zeros(0, np.int64), pa.int64()))
            small = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(flat)].astype(np.int32)), pa.array(bytes_))
            yield pa.RecordBatch.from_arrays([pa.array(dims.astype(np.int32)), lists, small, pa.array(scale), pa.array(err), *b.columns], schema.names)

    found = cut(map_arrow(classes.select("cls", "size", "v"), assign, schema))
    filed = found.select("dim", F.explode("fs").alias("f"), "cls", "q", "scale", "err")
    hot = cut(filed.groupBy("dim", "f").count().filter(F.col("count") > CHUNK).select("dim", "f", F.ceil(F.col("count") / CHUNK).cast("int").alias("m")))
    side = F.broadcast(hot) if hot.count() <= 100_000 else hot
    dealt = filed.join(side, ["dim", "f"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("cls"), F.col("m")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("dim", "f", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "s", "cls", "q", "scale", "err")
    by = ["dim", "f", "i", "j"]
    n = partitions(spark, rows * LIST, 100_000)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            some = _screen(group, threshold)
            if len(some):
                yield group.select(_NEAR.names).take(pa.array(some)).to_batches()[0]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            hits = _verify(group, threshold)
            if hits is not None:
                yield pa.RecordBatch.from_arrays([pa.array(hits[0]), pa.array(hits[1], mask=hits[1] < 0), pa.array(hits[2])], _HIT.names)

    near = map_arrow(dealt.repartition(n, *by).sortWithinPartitions(*by), screen, _NEAR)
    # of a vector's filters only those below the one at hand travel: they tell whether a pair was counted there
    whole = near.join(found.select("cls", "size", "v", "fs"), "cls").withColumn("fs", F.filter("fs", lambda x: x < F.col("f")))
    return map_arrow(whole.repartition(n, *by).sortWithinPartitions(*by), verify, _HIT)


def _rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows in one byte a component: (bytes, what one step is worth, length of the difference)."""
    scale = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / scale[:, None]).astype(np.int8)
    return small, scale, np.linalg.norm(unit - small * scale[:, None], axis=1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each whole (dim, f, i, j) group of sorted batches, in one chunk."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        keys = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("dim", "f", "i", "j")])
        if held is not None:
            last = [held.column(c)[0].as_py() for c in ("dim", "f", "i", "j")]
            if (keys[:, 0] != last).any():
                yield held.combine_chunks()
                held = None
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), t.num_rows]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = t.slice(lo, hi - lo)
            part = pa.concat_tables([held, part]) if held is not None and k == 0 else part
            if hi == t.num_rows:
                held = part
            else:
                held = None
                yield part.combine_chunks()
    if held is not None:
        yield held.combine_chunks()


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """(rows of the one chunk, rows of the other, whether both are the same)."""
    i, j, s = group.column("i")[0].as_py(), group.column("j")[0].as_py(), group.column("s").to_numpy()
    return (np.arange(len(s)), np.arange(len(s)), True) if i == j else (np.flatnonzero(s == i), np.flatnonzero(s == j), False)


def _lists(group: pa.Table, name: str) -> pa.ListArray:
    return group.column(name).combine_chunks()


def _screen(group: pa.Table, threshold: float) -> np.ndarray:
    """Rows that may have a partner in the group: the rounded cosine and all that rounding can have taken reach the threshold."""
    if group.num_rows < 2:
        return np.zeros(0, np.int64)
    left, right, same = _sides(group)
    x = _lists(group, "q").flatten().to_numpy().reshape(group.num_rows, -1) * group.column("scale").to_numpy()[:, None]
    err = group.column("err").to_numpy()
    # u.w - u'.w' = u.(w - w') + (u - u').w', and w' is no longer than 1 + err of w
    near = x[left] @ x[right].T + err[left][:, None] * (1 + err[right]) + err[right] >= threshold - 1e-9
    if same:
        np.fill_diagonal(near, False)
    some = np.zeros(group.num_rows, bool)
    some[left] |= near.any(axis=1)
    some[right] |= near.any(axis=0)
    return np.flatnonzero(some)


def _verify(group: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Links of one cap (or of one pair of its chunks) that no smaller shared cap has: (class, smaller class or -1, links)."""
    if group.num_rows < 2:
        return None
    left, right, same = _sides(group)
    cls, size, fs = group.column("cls").to_numpy(), group.column("size").to_numpy(), _lists(group, "fs")
    n, flat = np.diff(fs.offsets.to_numpy()), fs.flatten().to_numpy()
    v = _unit(np.array(_lists(group, "v").flatten(), float).reshape(group.num_rows, -1))
    near = v[left] @ v[right].T >= threshold
    if same:
        np.fill_diagonal(near, False)
    if not near.any():
        return None
    back = np.repeat(np.arange(len(cls)), n)
    seen, col = np.unique(flat, return_inverse=True)
    if len(seen):
        member = np.zeros((len(cls), len(seen)), np.float32)
        member[back, col] = 1
        near &= (member[left] @ member[right].T) == 0
    if not near.any():
        return None
    total = np.zeros(len(cls), np.int64)
    total[left] += near @ size[right]
    if not same:
        total[right] += near.T @ size[left]
    label = np.arange(len(cls))
    while True:  # least index over links, flattened each round
        new = label.copy()
        new[left] = np.minimum(new[left], np.where(near, label[right][None, :], len(cls)).min(axis=1))
        new[right] = np.minimum(new[right], np.where(near, label[left][:, None], len(cls)).min(axis=0))
        if (new == label).all():
            break
        label = new[new]
    some = np.flatnonzero((total > 0) | (label != np.arange(len(cls))))
    other = np.where(label[some] != some, cls[label[some]], -1)
    return cls[some], other, total[some]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """Every row: its id, ``n_links``, ``component_id`` and ``kept``.

    ``n_links`` is the number of other rows linked directly, ``component_id`` the smallest id reachable.
    """
    base = vectors.select(F.col(id_col).alias("_id"), F.col(vector).alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("_v", lambda x: x != 0), F.lit(False))
    key = F.when(good, F.struct(F.xxhash64("_v").alias("h"), F.sha2(F.to_json("_v").cast("binary"), 256).alias("s")))
    rows = cut(base.withColumn("_key", key))
    classes = rows.filter("_key is not null").groupBy("_key").agg(F.count("*").alias("size"), F.min("_id").alias("least"), F.first("_v").alias("v"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    n = classes.count()
    found = cut(links(classes, threshold, n))
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    members = cut(connected_components(found.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))))
    named = classes.select("_key", "cls", "size", "least").join(counts, "cls", "left").join(members, F.col("cls") == F.col("node"), "left")
    named = named.select("_key", "least", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "cls").alias("c"))
    smallest = named.groupBy("c").agg(F.min("least").alias("component"))
    labels = cut(named.join(smallest, "c").select(F.col("_key").alias("_k"), "n_links", F.col("component").alias("component_id")))
    linked = rows.join(labels, F.col("_key") == F.col("_k")).select("_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    # rows without a key take no part in the join, where they would all meet in one task
    alone = rows.filter("_key is null").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    kept = F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True))
    return linked.union(alone).select(F.col("_id").alias(id_col), "n_links", "component_id", kept.alias("kept"))
