"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, connected components.

Distinct fingerprints are sharded by pigeonhole: of ``b`` bit blocks at most ``radius`` can hold a differing bit, so
two fingerprints within the radius agree on some choice of ``b - radius`` blocks, and each choice is a table of shards.
``b`` grows with the number of fingerprints to keep shards small; every ``b`` finds every link. A shard is a BK-tree:
a child hangs from its parent by their integer Hamming distance, and a search at distance d follows the edges from
d - radius to d + radius only. Trees of many shards are built and searched together as arrays. A shard beyond
``CHUNK`` fingerprints is dealt into chunks, and each pair of chunks is one task's tree and its queries.

A shard reports a spanning forest of its links, never all pairs; components are then joined across shards.

Defined cases: null or wordless text has fingerprint zero and links like any other; text under four words hashes its
whole word sequence; equal rows share a fingerprint; null ids count for no component's smallest id (a component of
null ids alone has a null component_id); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.llm._common import connected_components, cut, drop, map_arrow, partitions

RADIUS = 4
SHINGLE = 4
#: Fingerprints of one shard that one task takes at a time.
CHUNK = 4096
#: Fingerprints a shard should hold on average; decides the number of blocks.
SHARD_MEAN = 64
_BATCH = 60_000
_FRONTIER = 500_000


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """64-bit SimHash of the A-Z lower-cased words' shingles (XXH64, seed 42); a bit needs over half the hashes."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    size = min(size, len(words))
    digest, starts = xxhash.xxh64_intdigest, [0, *(e + 1 for e in ends)]
    counts, total = np.zeros(64, np.int64), len(words) - size + 1
    hashes = (digest(line[s:e], 42) for s, e in zip(starts, ends[size - 1 :], strict=False))
    whole = np.fromiter(hashes, np.uint64, total)
    for k in range(0, total, 65_536):
        bits = np.unpackbits(whole[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``fp``, the fingerprint as a signed long."""
    rows = docs.select(*[F.col(c) for c in keep], F.col(text).cast("binary").alias("_text"))
    schema = T.StructType([*(f for f in rows.schema.fields[:-1]), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(len(keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(fp, pa.int64())], [*keep, "fp"])

    return map_arrow(rows, run, schema)


class Forest:
    """BK-trees over groups of distinct 64-bit values, as arrays."""

    def __init__(self, group: np.ndarray, value: np.ndarray) -> None:
        """``group`` sorted; the first value of a group is its root."""
        self.value = value
        n = len(value)
        first = np.r_[True, group[1:] != group[:-1]] if n else np.zeros(0, bool)
        at = np.flatnonzero(first)
        self.groups, self.roots = group[at], at
        under = at[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        active = np.flatnonzero(~first)
        under = under[active]
        keys, kids = [], []
        while len(active):
            d = np.bitwise_count(value[active] ^ value[under]).astype(np.int64)
            key = under * 65 + d
            order = np.argsort(key, kind="stable")
            key, active = key[order], active[order]
            new = np.r_[True, key[1:] != key[:-1]]
            keys.append(key[new])
            kids.append(active[new])
            under = active[new][np.cumsum(new) - 1][~new]
            active = active[~new]
        key, kid = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, kids))
        order = np.argsort(key, kind="stable")
        self.key, self.kid = key[order], kid[order]

    def search(self, group: np.ndarray, value: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, in bounded pieces."""
        k = np.searchsorted(self.groups, group)
        ok = k < len(self.groups)
        ok[ok] &= self.groups[k[ok]] == group[ok]
        q = np.flatnonzero(ok)
        todo = [(q[i : i + _FRONTIER], self.roots[k[q[i : i + _FRONTIER]]]) for i in range(0, len(q), _FRONTIER)]
        while todo:
            q, node = todo.pop()
            d = np.bitwise_count(value[q] ^ self.value[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right") - lo
            ends = np.cumsum(n)
            a = 0
            while a < len(q):  # pieces of bounded size
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _FRONTIER, "right")))
                m = n[a:b]
                if m.any():
                    at = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    todo.append((np.repeat(q[a:b], m), self.kid[at]))
                a = b


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs (a, b) in ``parent``, which stays flat with the least index of a set as its root."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _shard_links(t: np.ndarray, fp: np.ndarray, tree: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of whole groups: ``t`` group numbers, ``tree`` marks rows of the tree; all rows of a pure group query."""
    value = fp.view(np.uint64)
    nodes = np.flatnonzero(tree)
    forest = Forest(t[nodes], value[nodes])
    has_other = np.zeros(t.max() + 1, bool)
    has_other[t[~tree]] = True
    ask = np.flatnonzero(np.where(has_other[t], ~tree, True))
    parent = np.arange(len(fp))
    for q, node in forest.search(t[ask], value[ask], radius):
        unite(parent, ask[q], nodes[node])
    moved = np.flatnonzero(parent != np.arange(len(fp)))
    return fp[moved], fp[parent[moved]]


_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[np.ndarray]]:
    """Columns (t, key, i, j, ...) of sorted batches, re-cut so that no (t, key, i, j) group is split."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        rows += b.num_rows
        if rows < least:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]) | (cols[3] != cols[3][-1]))
        end = last[-1] + 1 if len(last) else 0
        if end:
            yield [c[:end] for c in cols]
        held, rows = [[c[end:] for c in cols]], len(cols[0]) - end
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def links(fps: DataFrame, radius: int = RADIUS, rows: int | None = None) -> DataFrame:
    """``fps(fp)``, distinct -> edges (a, b) that connect whatever is linked within the radius."""
    rows = fps.count() if rows is None else rows
    blocks = radius + 1
    while rows / 2 ** (64 * (blocks - radius) / blocks) > SHARD_MEAN and blocks < radius + 6:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << edges[i + 1]) - (1 << edges[i]) for i in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)]))
    keyed = fps.select("fp", keys.alias("x")).select("x.t", "x.key", "fp")
    hot = cut(keyed.groupBy("t", "key").count().filter(F.col("count") > CHUNK).select("t", "key", F.ceil(F.col("count") / CHUNK).cast("int").alias("m")))
    side = F.broadcast(hot) if hot.count() <= 100_000 else hot
    dealt = keyed.join(side, ["t", "key"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    dealt = dealt.select("t", "key", F.least("s", "o").alias("i"), F.greatest("s", "o").alias("j"), "fp", (F.col("s") <= F.col("o")).alias("tree"))
    n = partitions(fps.sparkSession, rows * len(masks), 2_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key, i, j, fp, tree in _groups(batches, _BATCH):
            new = np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            if many.any():
                a, b = _shard_links(group[many], np.ascontiguousarray(fp[many]), tree[many], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    by = ["t", "key", "i", "j"]
    found = map_arrow(dealt.repartition(n, *by).sortWithinPartitions(*by), run, _EDGE)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(prints: DataFrame, keep: list[str], id_col: str, radius: int = RADIUS) -> DataFrame:
    """``keep`` and ``fp`` -> plus ``component_id``, the smallest id reachable over links, itself included, and ``component``, a
    key of the component that is never null."""
    prints = cut(prints)
    classes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    found = links(classes.select("fp"), radius)
    members = cut(connected_components(found))
    named = classes.join(members, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("c"))
    linked = named.filter("c is not null")
    smallest = linked.groupBy("c").agg(F.min("least").alias("component_id"))
    labels = cut(linked.join(smallest, "c").select(F.col("fp").alias("_fp"), "component_id", F.col("c").alias("component")))
    drop(members)
    return prints.join(labels, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """Every row's ``keep``, ``fp``, ``component_id`` and ``component``."""
    return components(fingerprints(docs, keep, text), keep, id_col, radius)
