"""Searches in cells and by code: no pair of a query and a row outside a tile, results of brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.operators import ivfpq, knn, tiles
from sparkseek.plans import vector
from tests.test_operators import matrix


@pytest.fixture(scope="module")
def small(spark):
    x = np.random.default_rng(3).standard_normal((300, 16)).astype(np.float32)
    rows = matrix(spark, x)
    asked = rows.filter("id < 9").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    u = tiles.unit(x.astype(float))
    cells = spark.createDataFrame([(i * 3, u[i].tolist()) for i in range(6)], "cell_id long, c array<double>")
    books = spark.createDataFrame([(s, c, u[20 + c, s * 4 : s * 4 + 4].tolist()) for s in range(4) for c in range(5)], "sub long, code long, w array<double>")
    return rows, asked, u, cells, books


def test_no_join_of_rows_and_probes(spark, sf):
    """such a join made 30 to 80 in 100 of all pairs of rows and queries."""
    plan = vector._probed(spark, sf, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_nearest_cells_of_ties_and_blanks():
    c = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0]])
    u = np.array([[1.0, 0.0], [0.0, 1.0], [np.nan, np.nan], [0.0, 0.0]])
    assert tiles.nearest(u, c, 1)[:, 0].tolist() == [0, 1, 0, 0]
    assert tiles.nearest(u, c, 9).tolist() == [[0, 2, 1], [1, 0, 2], [0, 1, 2], [0, 1, 2]]


def test_best_of_each_probed_cell(spark, small):
    rows, asked, u, cells, _ = small
    centroids = u[:6]
    dist = np.round(((u[:, None] - centroids) ** 2).sum(2), 9)
    order = np.argsort(dist, axis=1, kind="stable")
    held, probes = ivfpq.assign_cells(rows, cells), ivfpq.probe_cells(asked, cells, 2, "qid", "q")
    assert {(r.qid, r.cell_rank): r.cell_id for r in probes.collect()} == {(q, n + 1): 3 * int(order[q, n]) for q in range(9) for n in range(2)}
    got = {(r.qid, r.rank, r.id) for r in knn.merge(ivfpq.cell_search(held, probes, asked, 7), 7).collect()}
    s = np.round(u[:9] @ u.T, 9)
    want = set()
    for q in range(9):
        inside = [i for i in range(300) if order[i, 0] in order[q, :2]]
        want |= {(q, n, i) for n, i in enumerate(sorted(inside, key=lambda i: (-s[q, i], i))[:7], 1)}
    assert got == want


@pytest.mark.parametrize("rerank", [0, 3])
def test_search_by_code(spark, small, rerank):
    """the best by code, scored again with the vector that is at hand, without a join by id."""
    rows, asked, u, cells, books = small
    index, probes = ivfpq.pq_encode(ivfpq.assign_cells(rows, cells), books, 4, 16), ivfpq.probe_cells(asked, cells, 6, "qid", "q")
    found = ivfpq.search(index, probes, asked, books, 4, 16, 5, rerank)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    words = np.array([[u[20 + c, s * 4 : s * 4 + 4] for c in range(5)] for s in range(4)])
    codes = np.array([[int(np.argmin(np.round(((v[s * 4 : s * 4 + 4] - words[s]) ** 2).sum(1), 9))) for s in range(4)] for v in u])
    decoded = np.array([np.concatenate([words[s][c[s]] for s in range(4)]) for c in codes])
    d, exact = np.round(((u[:9, None] - decoded) ** 2).sum(2), 9), np.round(u[:9] @ u.T, 9)
    want = set()
    for q in range(9):
        near = sorted(range(300), key=lambda i: (d[q, i], i))[: 5 * max(rerank, 1)]
        want |= {(q, n, i) for n, i in enumerate(sorted(near, key=lambda i: (-exact[q, i], i))[:5] if rerank else near, 1)}
    assert {(r.qid, r.rank, r.id) for r in found.collect()} == want
