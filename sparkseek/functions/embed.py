"""Embedders as Arrow UDFs. The hash embedder needs no model; a sentence model can be plugged in."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.session import ship

_WORD = re.compile(r"\w+")


def hash_vector(text: str | None, dim: int) -> np.ndarray:
    """Signed feature hashing of words and neighbouring pairs; bit 31 of the CRC is the sign; unit length or zero."""
    words = _WORD.findall((text or "").lower())
    grams = words + ["_".join(p) for p in zip(words, words[1:], strict=False)]
    h = np.fromiter((zlib.crc32(g.encode()) for g in grams), np.int64, len(grams))
    out = np.bincount(h % dim, np.where(h >> 31 & 1, 1.0, -1.0), dim) if len(h) else np.zeros(dim)
    n = np.linalg.norm(out)
    return out / n if n else out


def hash_embedder(dim: int = 384) -> Callable[[Column], Column]:
    ship(SparkSession.active())

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: hash_vector(t, dim))

    return embed


#: Texts embedded at a time by :func:`hash_rows`.
SLICE = 512


def _hashed(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, SLICE):
                part = b.slice(lo, SLICE)
                x = np.concatenate([hash_vector(t.as_py(), dim) for t in part.column(1)])
                v = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * dim), pa.array(x))
                yield pa.RecordBatch.from_arrays([part.column(0), v], ["id", "v"])

    return run


def hash_rows(rows: DataFrame, id: str, text: str, dim: int = 384) -> DataFrame:
    """(id, v) of many texts, as :func:`hash_embedder` embeds them: a slice of vectors leaves before the next is made."""
    ship(rows.sparkSession)
    kind = rows.schema[id].dataType
    return rows.select(F.col(id).alias("id"), F.col(text).alias("t")).mapInArrow(_hashed(dim), T.StructType([T.StructField("id", kind), T.StructField("v", T.ArrayType(T.DoubleType()))]))


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], query_prefix: str = "") -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """(document, query) column functions of a model that ``load`` makes once a worker (L1); only queries get the prefix."""
    ship(SparkSession.active())

    def of(prefix: str) -> Callable[[Column], Column]:
        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for s in batches:
                yield pd.Series(list(map(list, np.asarray(model([prefix + (t or "") for t in s]), float))), index=s.index)

        return embed

    return of(""), of(query_prefix)
