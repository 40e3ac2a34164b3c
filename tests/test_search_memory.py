"""What a task of a search holds does not grow with its rows: all in one, in shards, in cells, by code."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from sparkseek.operators import tiles

NAMES = ["g", "qid", "id", "cell_rank", "d", "score"]
DIM, SUBS, ASKED, BATCH = 16, 4, 2000, 10_000


def batches(rows, groups):
    rng = np.random.default_rng(0)
    for lo in range(0, rows, BATCH):
        v, ids = rng.standard_normal(BATCH * DIM), np.arange(lo, lo + BATCH)
        codes = rng.integers(0, 8, BATCH * SUBS)
        lists = (pa.ListArray.from_arrays(pa.array(np.arange(BATCH + 1, dtype=np.int32) * n), pa.array(x)) for n, x in ((DIM, v), (SUBS, codes)))
        yield pa.RecordBatch.from_arrays([pa.array(ids % groups), pa.array(ids), *lists], ["g", "id", "v", "codes"])


def peak(rows, groups, k, probed, coded):
    rng = np.random.default_rng(1)
    q = tiles.unit(rng.standard_normal((ASKED, DIM)))
    probes = {g: (np.flatnonzero((np.arange(ASKED) + g) % groups < 3), np.ones(ASKED, np.int64)) for g in range(groups)} if probed else None
    books = rng.standard_normal((SUBS, 8, DIM // SUBS)) if coded else None
    run = tiles.searcher(SimpleNamespace(value=(np.arange(ASKED), q, np.zeros(ASKED, bool), probes, books)), k, NAMES, 64)
    tracemalloc.start()
    n = sum(b.num_rows for b in run(batches(rows, groups)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == ASKED * k * (3 if probed else groups)
    return most


@pytest.mark.parametrize(
    ("groups", "k", "probed", "coded"),
    [
        pytest.param(1, 10, False, False, id="knn_padded delta_search truth_cache"),
        pytest.param(4, 10, False, False, id="two_node_merge gateway_degraded_merge sharded_topk_merge"),
        pytest.param(10, 10, True, False, id="ivf_probe_topk ann_recall_at_k nprobe_sweep"),
        pytest.param(10, 40, True, True, id="ivfpq_sweep ivfpq_rerank"),
    ],
)
def test_memory_of_a_task_does_not_grow_with_its_rows(groups, k, probed, coded):
    """A batch of 10,000 rows alone makes 160 MB of scores, all rows here 640."""
    few, many = (peak(n, groups, k, probed, coded) for n in (BATCH, 4 * BATCH))
    assert many < 1.1 * few + (1 << 20) and many < 80 << 20


@pytest.mark.parametrize("coded", [False, True])
def test_copies_take_no_more_memory_than_other_rows(coded):
    """all pairs of a tile with copies were sorted and their vectors gathered; larger ids come first here."""
    rng = np.random.default_rng(2)
    n, x = 8192, rng.standard_normal((2, DIM))
    books = rng.standard_normal((SUBS, 8, DIM // SUBS)) if coded else None
    at, ids, codes = (rng.random(n) < 0.01).astype(int), np.arange(n)[::-1].copy(), rng.integers(0, 8, (2, SUBS))
    lists = (pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * w.shape[1]), pa.array(w[at].ravel())) for w in (x, codes))
    b = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(ids), *lists], ["g", "id", "v", "codes"])
    q = tiles.unit(rng.standard_normal((512, DIM)))
    probes = {0: (np.arange(512), np.ones(512, np.int64))}
    tracemalloc.start()
    got = pa.Table.from_batches(list(tiles.searcher(SimpleNamespace(value=(np.arange(512), q, np.zeros(512, bool), probes, books)), 40, NAMES, 64)(iter([b]))))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 << 20
    exact = np.round(q @ tiles.unit(x).T, 9)
    key = exact
    if coded:
        decoded = np.array([np.concatenate([books[s][c[s]] for s in range(SUBS)]) for c in codes])
        key = -np.round(((q[:, None] - decoded) ** 2).sum(2), 9)
    for w in range(0, 512, 37):
        want = np.lexsort((ids, -key[w][at]))[:40]
        mine = got.filter(pa.compute.equal(got["qid"], w))
        assert mine["id"].to_pylist() == ids[want].tolist()
        assert np.allclose(mine["score"].to_numpy(), exact[w][at[want]], atol=2e-9)
