"""The two services end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek import engine
from sparkseek.functions import config
from sparkseek.operators import curate, evaluate, hybrid
from sparkseek.sources import files, generate, store


def test_retrieval_end_to_end(spark, tmp_path):
    docs, items = generate.corpus(spark, 40)
    (tmp_path / "in").mkdir()
    for r in docs.collect():
        (tmp_path / "in" / r.doc_id).write_text(r.text)
    root = str(tmp_path / "index")
    cfg = config.RetrievalConfig(chunk_size=200, chunk_overlap=20, min_chunk_chars=5, dim=256)
    engine.Retrieval.build(spark, str(tmp_path / "in"), root, cfg)
    loaded = engine.Retrieval.load(spark, root, reranker="lexical")
    assert loaded.cfg == cfg
    report = {r["mode"]: r for r in loaded.evaluate(items.limit(45)).collect()}
    assert set(report) == {"dense", "sparse", "hybrid", "hybrid+rerank"}
    assert report["hybrid"]["hit"] >= 0.95 and report["hybrid"]["p_at_1"] >= 0.8
    asked = loaded.questions([items.first().question])
    hits = loaded.retrieve(asked, 3)
    assert hits.filter("rank = 1").first().doc_id == items.first().relevant_doc_ids[0]
    assert "text" not in hybrid.wire_form(hits, False).columns
    assert "[1]" in loaded.answer(asked).first().answer
    assert "source: brief_" in loaded.prompts(asked).first().prompt
    assert loaded.retrieve(asked, mode="none").count() == 0
    with pytest.raises(ValueError):
        loaded.questions([""])
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no text"):
        (tmp_path / "empty" / "a.md").write_text("  ")
        engine.Retrieval.build(spark, str(tmp_path / "empty"), str(tmp_path / "i2"))


@pytest.mark.parametrize("backend", ["flat", "ivfpq"])
def test_vector_service(spark, tmp_path, backend):
    rows = generate.vectors(spark, 1200, 32, 12).persist()
    asked = generate.noisy_queries(rows, 100).persist()
    index = engine.Vectors.build(rows, str(tmp_path / backend), config.IndexConfig(dim=32, shards=3, nlist=8, pq_m=8, pq_bits=4), backend)
    index = engine.Vectors.load(spark, index.root)
    truth = engine.knn.exact_topk(rows, asked, 5).persist()
    assert evaluate.ann_recall(index.search(asked, 5, nprobe=8, rerank_factor=20), truth, 5).first()[0] >= (1.0 if backend == "flat" else 0.9)
    q = asked.orderBy("qid").first()
    index.upsert(spark.createDataFrame([(5000, [float(x) for x in q.q], 1)], "id long, v array<double>, seq int"))
    assert index.search(asked.filter(F.col("qid") == q.qid), 1).first().id == 5000
    with pytest.raises(ValueError):
        index.upsert(spark.createDataFrame([(7, [0.0] * 32, 1)], "id long, v array<double>, seq int"))
    with pytest.raises(ValueError, match="components"):
        index.search(spark.createDataFrame([(0, [1.0])], "qid long, q array<double>"))
    notes = spark.createDataFrame([(5000, "new"), (-1, "none")], "id long, note string")
    assert {(r.id == 5000, r.note) for r in index.search(asked.filter(F.col("qid") == q.qid), 2, metadata=notes).collect()} == {(True, "new"), (False, None)}
    part = engine.Vectors.build(rows, str(tmp_path / "part"), config.IndexConfig(dim=32, shards=3, nlist=8, pq_m=8, pq_bits=4), backend, [0, 2])
    assert {r.id % 3 for r in part.search(asked, 5, nprobe=8, rerank_factor=20).collect()} == {0, 2} and part.manifest["shard_sizes"] == [400] * 3
    assert {(r.shard_id, r.n) for r in index.stats().collect()} == {(0, 400), (1, 400), (2, 400), (-1, 1)}


def test_generated_rows_and_files(spark, tmp_path):
    rows = generate.multilingual(spark, 80)
    assert rows.count() == 480 and rows.filter("lang = 'eng'").first().response.startswith("The sum")
    assert generate.vectors(spark, 5, 8).collect() == generate.vectors(spark, 5, 8).collect()
    got = curate.prepare(rows.withColumn("i", F.concat("lang", "instruction")), ["en", "hin", "spa", "fra", "deu", "tel"], 300, 0.5, 5, 400, 0.1, 5, "i").groupBy("lang_code").count().collect()
    assert max(r["count"] for r in got) - min(r["count"] for r in got) <= 1
    assert store.write_jsonl(rows, str(tmp_path / "rows")) == 480
    store.write_report(rows.groupBy("lang").count(), str(tmp_path / "report"))
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "a.pdf").write_bytes(b"no pdf")
    assert [(r.text, r.corrupt) for r in files.read_documents(spark, str(tmp_path / "pdf")).collect()] == [("", True)]
    (tmp_path / "m").mkdir()
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "m" / "a.npy", x[:3])
    np.save(tmp_path / "m" / "b.npy", np.asfortranarray(x[3:]))
    assert [list(r.v) for r in files.read_matrix(spark, str(tmp_path / "m")).orderBy("id").collect()] == x.tolist()


def test_chunk_store_cuts_texts_once(spark, sf, monkeypatch):
    """the checks and the two writes read the numbered chunks, they do not cut the texts again."""
    from sparkseek.plans import stores

    seen = []
    write = stores.store.write_chunks
    monkeypatch.setattr(stores.store, "write_chunks", lambda chunks, root: (seen.append(chunks._jdf.queryExecution().optimizedPlan().toString()), write(chunks, root)))
    assert stores.chunk_store(spark, sf).count() > 0
    assert len(seen) == 2 and not any("Generate" in plan or "Join" in plan for plan in seen)
