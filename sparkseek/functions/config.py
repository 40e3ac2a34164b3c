"""Typed settings and request checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from functools import reduce
from typing import Any


@dataclass(frozen=True)
class RetrievalConfig:
    """Knobs of ingest, retrieval and answers (D11); ``from_env`` reads ``SPARKSEEK_<NAME>``."""

    chunk_size: int = 900
    chunk_overlap: int = 150
    min_chunk_chars: int = 40
    dim: int = 384
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    dense_k: int = 50
    sparse_k: int = 50
    rerank_top_n: int = 30
    final_k: int = 5
    max_context_chars: int = 12_000
    max_sentences: int = 3

    @classmethod
    def from_env(cls) -> RetrievalConfig:
        found = {f.name: type(f.default)(os.environ[key]) for f in fields(cls) if (key := f"SPARKSEEK_{f.name.upper()}") in os.environ}
        return replace(cls(), **found)


@dataclass(frozen=True)
class IndexConfig:
    """Layout of a vector index."""

    dim: int = 64
    shards: int = 4
    nlist: int | None = None
    pq_m: int | None = None
    pq_bits: int = 8
    nprobe: int = 24
    rerank_factor: int = 4

    def search_defaults(self, nprobe: int | None, rerank_factor: int | None) -> tuple[int, int]:
        """Zero or no nprobe means the default; a rerank factor of zero is honoured."""
        return nprobe or self.nprobe, self.rerank_factor if rerank_factor is None else rerank_factor


def merge_config(base: dict, *layers: dict, overrides: tuple[str, ...] = ()) -> dict:
    """Defaults, then layers, then ``a.b=v`` overrides; strings that spell numbers become numbers."""
    out: dict[str, Any] = {}
    for layer in (base, *layers):
        out = _deep(out, layer)
    for item in overrides:
        path, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"override {item!r} needs name=value")
        out = _deep(out, reduce(lambda inner, name: {name: inner}, reversed(path.split(".")), value))
    return _numbers(out)


def _deep(a: dict, b: dict) -> dict:
    return a | {k: _deep(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}


def _numbers(x: Any) -> Any:
    if isinstance(x, dict):
        return {k: _numbers(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_numbers(v) for v in x]
    if isinstance(x, str):
        if x.lower() in ("true", "false"):
            return x.lower() == "true"
        for kind in (int, float):
            try:
                return kind(x)
            except ValueError:
                continue
    return x


_LIMITS = {"top_k": (1, 20), "k": (1, 1000), "nprobe": (1, 4096), "rerank_factor": (0, 64), "batch": (1, 256), "ids": (1, 10_000), "question": (1, 2000)}


def check_request(**values: Any) -> None:
    """Raise ValueError for a value outside its limits; lengths count for texts and lists (P10)."""
    for name, value in values.items():
        if value is None:
            continue
        low, high = _LIMITS[name]
        size = len(value) if hasattr(value, "__len__") else value
        if not low <= size <= high:
            raise ValueError(f"{name} must be between {low} and {high}, not {size}")


def check_query(vector: list | None, text: str | None, dim: int) -> None:
    """Exactly one of vector and text, and a vector of the index's length."""
    if (vector is None) == (text is None):
        raise ValueError("give either a vector or a text")
    if vector is not None and len(vector) != dim:
        raise ValueError(f"the vector has {len(vector)} components, the index {dim}")
