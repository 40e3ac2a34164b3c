"""Named queries of the engine's own operators, with DuckDB SQL where SQL can state them."""

from __future__ import annotations

from sparkseek.plans import curation, retrieval, stores, vector

_ALL = retrieval.QUERIES | vector.QUERIES | curation.QUERIES | stores.QUERIES


def queries() -> dict:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
