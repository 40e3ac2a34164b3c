"""Search kernels: memory of a task, odd vectors, ties, against brute force."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sparkseek.operators import tiles

NAMES = ["g", "qid", "id", "cell_rank", "d", "score"]


def batch(x, ids, group=0, extra=()):
    v = pa.array([None if r is None else list(map(float, r)) for r in x], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([group] * len(ids)), pa.array(ids), v, *extra], ["g", "id", "v", "codes"][: 3 + len(extra)])


def found(out):
    return sorted(zip(*(pa.Table.from_batches(out)[c].to_pylist() for c in ("qid", "id", "score")), strict=True), key=repr) if out else []


def test_memory_of_a_task_is_that_of_its_tiles():
    """10,000 rows x 4,000 queries are 320 MB of scores."""
    rng = np.random.default_rng(0)
    q, rows = tiles.unit(rng.standard_normal((4000, 16))), batch(rng.standard_normal((10_000, 16)), range(10_000))
    run = tiles.searcher(SimpleNamespace(value=(np.arange(4000), q, np.zeros(4000, bool), None, None)), 10, NAMES, 64)
    tracemalloc.start()
    n = sum(b.num_rows for b in run(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 40_000 and peak < 60 << 20


@pytest.mark.parametrize("rows", [3, 64, 1024])
def test_copies_tie_by_id_across_tiles(monkeypatch, rows):
    monkeypatch.setattr(tiles, "ROWS", rows)
    monkeypatch.setattr(tiles, "QUERIES", 2)
    rng = np.random.default_rng(1)
    x = np.repeat(rng.standard_normal((20, 8)), 15, axis=0)
    ids = rng.permutation(300)
    q = tiles.unit(x[::60])
    run = tiles.searcher(SimpleNamespace(value=(np.arange(5), q, np.zeros(5, bool), None, None)), 10, NAMES, 64)
    s = np.round(q @ tiles.unit(x).T, 9)
    want = sorted(((j, int(ids[i]), float(s[j, i])) for j in range(5) for i in np.lexsort((ids, -s[j]))[:10]), key=repr)
    assert found(list(run(iter([batch(x, ids)])))) == want


def test_rows_and_queries_without_a_vector_stay_below_all_others():
    x = [[1.0, 0.0], None, [0.0, 0.0], [-1.0, 0.0], [float("nan"), 1.0]]
    q = np.array([[1.0, 0.0], [0.0, 0.0]])
    probes = {0: (np.array([0, 1]), np.array([1, 2]))}
    run = tiles.searcher(SimpleNamespace(value=(np.array([7, 8]), q, np.array([False, True]), probes, None)), 4, NAMES, 64)
    got = pa.Table.from_batches(list(run(iter([batch(x, range(5))])))).to_pylist()
    assert [(r["id"], r["cell_rank"]) for r in got if r["qid"] == 7] == [(4, 1), (0, 1), (2, 1), (3, 1)]
    assert [(r["id"], r["score"]) for r in got if r["qid"] == 8] == [(0, None), (1, None), (2, None), (3, None)]


def test_vectors_of_several_lengths_are_an_error():
    run = tiles.searcher(SimpleNamespace(value=(np.array([7]), np.ones((1, 2)), np.array([False]), None, None)), 4, NAMES, 64)
    with pytest.raises(ValueError, match="2 and of 3"):
        list(run(iter([batch([[1, 2], [1, 2, 3]], [0, 1])])))
