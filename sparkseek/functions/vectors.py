"""Vector column functions and parameters of the index, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in order of the components (V2)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero (V1). ``v`` should be a plain column: its norm is computed once a row."""
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(F.when(norm(v) == 0, 1.0).otherwise(norm(v)), F.size(v)).alias("n")), lambda z: z.x.cast("double") / z.n)


def shard_of(id: Column, shards: int) -> Column:
    """Shard of an id: non-negative remainder (V4)."""
    return F.pmod(id, F.lit(shards))


def resolve_nlist(n_vectors: int, n_train: int, nlist: int | None = None) -> int:
    """Cells of a shard: a power of two near four square roots, at least 16, then at most a 39th of the training rows (V5)."""
    want = nlist if nlist else 2 ** max(4, round(math.log2(max(2.0, 4 * math.sqrt(n_vectors)))))
    return max(1, min(want, n_train // 39))


def resolve_pq_m(dim: int, pq_m: int | None = None) -> int:
    """Sub-spaces: an eighth of the dimensions unless given; must divide them (V6)."""
    m = pq_m or dim // 8
    if not m or dim % m:
        raise ValueError(f"{m} sub-spaces do not divide {dim} dimensions")
    return m


def cosine_from_l2(squared: Column) -> Column:
    """Cosine of unit vectors from their squared distance; null becomes minus infinity (V3)."""
    return F.coalesce(1.0 - squared / 2.0, F.lit(float("-inf")))
