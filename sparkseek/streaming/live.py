"""Structured Streaming: live upserts, metadata, ingest, rolling latency."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkseek.operators import knn
from sparkseek.sources import files, store


def upsert_stream(stream: DataFrame, root: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream of ``(id, v, seq)`` to the delta of the current build; ids of the build itself fail the batch."""
    manifest = store.read_manifest(stream.sparkSession, root)

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append_delta(knn.require_upserts(batch, manifest["n_vectors"]), root, manifest["build_id"])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def metadata_stream(stream: DataFrame, path: str, id: str, order: list[str], checkpoint: str):
    """Keep the latest metadata row of each id under ``path``: each batch writes a new version folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch
        if batch_id:
            rows = rows.unionByName(spark.read.parquet(f"{path}/v{batch_id - 1}"))
        store.latest_metadata(rows, id, order).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(spark: SparkSession, root: str, out: str, checkpoint: str, size: int = 800, overlap: int = 100):
    """New document files below ``root`` as chunks appended to ``out``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)

    def write(batch: DataFrame, batch_id: int) -> None:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                suffixes = b["path"].str.lower().str.extract(r"(\.[^./]+)$")[0]
                yield pd.DataFrame({"doc_id": b["path"], "text": [files.parse(s, bytes(c))[0] for s, c in zip(suffixes, b["content"], strict=True)]})

        known = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*files.SUFFIXES)
        docs = batch.filter(known).select("path", "content").mapInPandas(run, "doc_id string, text string")
        files.chunk_documents(docs, size, overlap).write.mode("append").parquet(out)

    files.ship(spark)
    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rolling_latency(events: DataFrame, ts: str = "ts", value: str = "value", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and approximate percentiles a window of event time, late rows bounded by a watermark."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    p = lambda q: F.percentile_approx(value, F.lit(q), F.lit(10_000)).alias(f"p{round(q * 100)}")
    return rows.groupBy(F.window(ts, window)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), p(0.5), p(0.95), p(0.99))


def last_n_latency(events: DataFrame, n: int = 10_000, by: str = "event_type", value: str = "value") -> DataFrame:
    """Percentiles over the newest ``n`` values of each key, kept in state as a bounded ring."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ring = list(zip(*state.get, strict=True)) if state.exists else []
        for b in batches:  # rows that arrive late find their place by time
            ring = sorted([*ring, *zip(b["ts"].astype("int64"), b["v"], strict=True)])[-n:]
        state.update(([int(t) for t, _ in ring], [float(v) for _, v in ring]))
        s = pd.Series([v for _, v in ring])
        yield pd.DataFrame({"key": [key[0]], "n": [len(ring)], "p50": [s.quantile(0.5)], "p95": [s.quantile(0.95)], "p99": [s.quantile(0.99)]})

    rows = events.select(F.col(by).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col(value).cast("double").alias("v"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, n long, p50 double, p95 double, p99 double", "at array<long>, ring array<double>", "update", GroupStateTimeout.NoTimeout)


def answer_events(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """Events of a streamed answer in order: the sources, each word, the end."""
    sources = hits.groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rank", "id")))).alias("data")).select("qid", F.lit(0).alias("seq"), F.lit("sources").alias("event"), "data")
    words = answers.select("qid", F.posexplode(F.split("answer", " ")).alias("p", "data")).select("qid", (F.col("p") + 1).alias("seq"), F.lit("token").alias("event"), "data")
    done = answers.select("qid", (F.size(F.split("answer", " ")) + 1).alias("seq"), F.lit("done").alias("event"), F.lit("").alias("data"))
    return sources.unionByName(words).unionByName(done)
