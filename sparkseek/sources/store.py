"""Index folders as Parquet: chunks, postings, vectors by shard, metadata, delta, manifests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseek.functions import vectors as V
from sparkseek.operators import bm25

VERSION = 1


def write_chunks(chunks: DataFrame, root: str) -> None:
    """Chunk store of an index (K1, K2); a repeated chunk_id is an error."""
    twice = chunks.groupBy("chunk_id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"chunk_id {twice[0][0]} occurs twice")
    chunks.write.mode("overwrite").parquet(f"{root}/chunks")


def write_postings(chunks: DataFrame, root: str) -> None:
    """Weighted postings sorted by term inside range partitions, so a term's rows are pruned by file statistics (K3)."""
    counted, stats = bm25.indexed(chunks, "chunk_id", "text")  # the range exchange carries counts, which pack better than weights
    posted = bm25.weights(counted.repartitionByRange("term", "id"), stats).select("term", "id", "tf", "weight")
    posted.sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{root}/postings")
    stats.write.mode("overwrite").parquet(f"{root}/stats")


def search_postings(spark: SparkSession, root: str, questions: DataFrame, k: int) -> DataFrame:
    """BM25 over stored weights: one broadcast join with the query terms, one aggregation, one top-k."""
    from sparkseek.functions import text as T

    asked = questions.select("qid", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term"))
    posted = spark.read.parquet(f"{root}/postings").join(bm25._small(asked), "term")
    return bm25.top_k(posted.groupBy("qid", "id").agg(F.round(F.sum("weight"), 9).alias("score")), k)


def write_vectors(vectors: DataFrame, root: str, shards: int, build_id: str, only: list[int] | None = None) -> None:
    """Vectors by shard, sorted by id (K6). Ids must be unique (P12). The build id names the delta that belongs to it.

    ``only``: the shards that this node holds; the manifest still counts those of all nodes.
    """
    twice = vectors.groupBy("id").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"id {twice[0][0]} occurs twice")
    rows = vectors.withColumn("shard_id", V.shard_of(F.col("id"), shards))
    rows = rows.filter(F.col("shard_id").isin(only)) if only is not None else rows
    rows.repartition("shard_id").sortWithinPartitions("shard_id", "id").write.mode("overwrite").partitionBy("shard_id").parquet(f"{root}/vectors")
    n = vectors.count()
    sizes = [len(range(s, n, shards)) for s in range(shards)]
    write_manifest(vectors.sparkSession, root, {"version": VERSION, "build_id": build_id, "n_vectors": n, "shards": shards, "shard_sizes": sizes, "only_shards": only})


def write_manifest(spark: SparkSession, root: str, values: dict) -> None:
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/manifest")


def read_manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/manifest").first()[0])


def read_vectors(spark: SparkSession, root: str, shards: list[int] | None = None) -> DataFrame:
    """Stored vectors; a subset of shards is a partition filter."""
    rows = spark.read.parquet(f"{root}/vectors")
    return rows.filter(F.col("shard_id").isin(shards)) if shards is not None else rows


def append_delta(new: DataFrame, root: str, build_id: str) -> None:
    """Upserts go to an append-only table of the build they belong to (K10, X3); ``seq`` orders them."""
    new.select("id", "v", "seq").write.mode("append").parquet(f"{root}/delta/{build_id}")


def read_delta(spark: SparkSession, root: str, build_id: str) -> DataFrame:
    """Latest row of each id."""
    rows = spark.read.parquet(f"{root}/delta/{build_id}")
    return rows.groupBy("id").agg(F.max_by("v", "seq").alias("v"))


def get_many(chunks: DataFrame, ids: DataFrame, id: str = "chunk_id") -> DataFrame:
    """Rows of the wanted ids; ids that are not there are absent (S14). The id list is broadcast if it is small."""
    return chunks.join(bm25._small(ids.select(id).distinct()), id)


def latest_metadata(rows: DataFrame, id: str, order: list[str]) -> DataFrame:
    """Last write of each id (K9, X4): one pre-aggregated maximum, no window over an id's history."""
    last = rows.groupBy(id).agg(F.max(F.struct(*order, *[c for c in rows.columns if c not in (id, *order)])).alias("_m"))
    return last.select(id, "_m.*")


def attach_metadata(hits: DataFrame, metadata: DataFrame, id: str = "id") -> DataFrame:
    """Hits with their payload, null where there is none; sentinel ids below zero get none."""
    return hits.join(metadata.filter(F.col(id) >= 0), id, "left")


def index_stats(vectors: DataFrame, delta: DataFrame, shards: int) -> DataFrame:
    """Vectors by shard and in the delta."""
    sizes = vectors.groupBy(V.shard_of(F.col("id"), shards).cast("long").alias("shard_id")).agg(F.count("*").alias("n"))
    return sizes.withColumn("kind", F.lit("shard")).unionByName(delta.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("shard_id"), "n", F.lit("delta").alias("kind")))


def cached_truth(spark: SparkSession, path: str, make, dataset: str, queries: str, k: int) -> DataFrame:
    """Exact neighbours, kept under the names of the data and query sets and ``k``."""
    at = f"{path}/{dataset}-{queries}-{k}"
    try:
        return spark.read.parquet(at)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(at)
    return spark.read.parquet(at)


def write_jsonl(rows: DataFrame, path: str) -> int:
    """JSON lines in UTF-8; the number of rows written (K7)."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path).count()


def write_report(rows: DataFrame, path: str) -> None:
    """A small table, such as statistics or an eval report, as one JSON file."""
    rows.coalesce(1).write.mode("overwrite").json(path)
