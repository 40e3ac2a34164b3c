"""Training-data queries against their SQL, row by row."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from sparkseek.llm import oracles, queries


def compare(frame, want):
    assert sorted(frame.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in frame.columns]
    assert sorted((tuple(r) for r in frame.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    compare(queries.queries()[name](spark, sf), con.sql(queries.oracle_sql()[name]))


def test_caps_with_links_against_sql(spark, tmp_path):
    """Copies, a chain, a cluster, and vectors that link with nothing."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((60, 64))
    rows = [*base, *base[:3], *(base[4] + rng.standard_normal((30, 64)) * 0.02), *(base[5] + np.arange(1, 9)[:, None] * 0.06 * base[6])]
    rows = [x.tolist() for x in rows] + [None, [], [0.0] * 64, [float("nan")] * 64, [1.0, None], [1.0, 2.0], [2.0, 4.0]]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.op10_spherical_caps(spark, str(tmp_path))
    assert got.filter("n_links > 0").count() > 40
    compare(got, con.sql(oracles.spherical_caps()))
