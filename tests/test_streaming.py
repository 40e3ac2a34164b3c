"""Streaming sinks and state on small file streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.sources import store
from sparkseek.streaming import live


def test_upsert_stream(spark, tmp_path):
    root, src = str(tmp_path / "index"), tmp_path / "in"
    store.write_vectors(spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(np.eye(4))], "id long, v array<double>"), root, 2, "b")
    schema = "id long, v array<double>, seq int"
    spark.createDataFrame([(10, [1.0] * 4, 1), (10, [2.0] * 4, 2)], schema).write.parquet(str(src))
    live.upsert_stream(spark.readStream.schema(schema).parquet(str(src)), root, str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.id, r.v[0]) for r in store.read_delta(spark, root, "b").collect()] == [(10, 2.0)]
    bad = tmp_path / "bad"
    spark.createDataFrame([(1, [1.0] * 4, 1)], schema).write.parquet(str(bad))
    with pytest.raises(Exception, match="built index"):
        live.upsert_stream(spark.readStream.schema(schema).parquet(str(bad)), root, str(tmp_path / "cp2")).awaitTermination(120)


def test_metadata_stream(spark, tmp_path):
    schema = "id long, seq int, payload string"
    src, out = tmp_path / "in", tmp_path / "out"
    for rows in ([(1, 1, "a"), (1, 2, "b")], [(1, 3, "c"), (2, 1, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        live.metadata_stream(spark.readStream.schema(schema).parquet(str(src)), str(out), "id", ["seq"], str(tmp_path / "cp")).awaitTermination(120)
    assert {r.id: r.payload for r in spark.read.parquet(str(out / "v1")).collect()} == {1: "c", 2: "d"}


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("Hello there.\n\nAnother paragraph.")
    live.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 20, 0).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["Another paragraph.", "Hello there."]


def test_rolling_and_last_n(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    q = live.rolling_latency(stream, window="1 day").writeStream.format("memory").queryName("rolling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rolling").agg(F.sum("n")).first()[0] == events.count()
    q = live.last_n_latency(stream, 50).writeStream.format("memory").queryName("lastn").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.key: r for r in spark.table("lastn").collect()}
    newest = {k: events.filter(F.col("event_type") == k).orderBy(F.col("ts").desc()).limit(50).toPandas()["value"] for k in got}
    for k, v in newest.items():
        assert got[k].n == len(v) and got[k].p50 == pytest.approx(v.quantile(0.5), abs=0.5)


def test_answer_events(spark):
    hits = spark.createDataFrame([(1, 1, 7), (1, 2, 5)], "qid long, rank long, id long")
    answers = spark.createDataFrame([(1, "two words")], "qid long, answer string")
    got = live.answer_events(hits, answers).orderBy("seq").collect()
    assert [r.event for r in got] == ["sources", "token", "token", "done"]
