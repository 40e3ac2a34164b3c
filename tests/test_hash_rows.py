"""texts are embedded in slices, so a task's memory does not follow the batch that it is given."""

import tracemalloc

import numpy as np
import pyarrow as pa

from sparkseek.functions import embed


def test_slices_bound_the_memory_of_a_batch():
    """8,000 texts in one batch are 24 MB of vectors."""
    texts = [f"word{i % 97} of text {i}" for i in range(7999)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array(texts)], ["id", "t"])
    tracemalloc.start()
    n = sum(out.num_rows for out in embed._hashed(384)(iter([b])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8000 and peak < 8 << 20


def test_as_the_embedder(spark):
    rows = spark.createDataFrame([(3, "Red fox red"), (1, None), (2, "")], "doc_id long, text string")
    got = {r.id: r.v for r in embed.hash_rows(rows, "doc_id", "text", 16).collect()}
    want = {r.doc_id: r.v for r in rows.select("doc_id", embed.hash_embedder(16)("text").alias("v")).collect()}
    assert got.keys() == want.keys() and all(np.array_equal(got[i], want[i]) for i in got)
