"""The engine's two services as classes: document retrieval and vector search. Batches of questions in, DataFrames out."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions import config
from sparkseek.functions.embed import hash_embedder
from sparkseek.operators import bm25, evaluate, hybrid, ivfpq, knn
from sparkseek.sources import files, store

Embedder = Callable[[Column], Column]


def make_embedder(kind: str, dim: int, model: tuple[Embedder, Embedder] | None = None) -> tuple[Embedder, Embedder]:
    """(document, query) embedders: ``hash``, or ``model`` with the pair that ``embed.model_embedder`` returns."""
    if kind == "hash":
        return hash_embedder(dim), hash_embedder(dim)
    if kind == "model" and model:
        return model
    raise ValueError(f"unknown embedder {kind!r}")


def make_reranker(kind: str | None) -> Callable[[Column, Column], Column] | None:
    """``lexical``, or none: retrieval then keeps the fused order."""
    if kind in (None, "none"):
        return None
    if kind == "lexical":
        return hybrid.lexical_reranker
    raise ValueError(f"unknown reranker {kind!r}")


@dataclass
class Retrieval:
    """An index folder of chunks, weighted postings and chunk vectors."""

    spark: SparkSession
    root: str
    cfg: config.RetrievalConfig
    embedder: tuple[Embedder, Embedder]
    reranker: Callable[[Column, Column], Column] | None = None

    @classmethod
    def build(cls, spark: SparkSession, data_dir: str, root: str, cfg: config.RetrievalConfig | None = None, embedder: str = "hash", model=None) -> Retrieval:
        """Parse, chunk, number, index. An empty corpus is an error. Everything under ``root`` is replaced."""
        cfg = cfg or config.RetrievalConfig()
        docs = files.read_documents(spark, data_dir)
        chunks = files.number_chunks(files.chunk_documents(docs, cfg.chunk_size, cfg.chunk_overlap, cfg.min_chunk_chars))
        chunks.write.mode("overwrite").parquet(f"{root}/staged")
        chunks = spark.read.parquet(f"{root}/staged")
        n = chunks.count()
        if not n:
            raise ValueError(f"no text below {data_dir}")
        store.write_chunks(chunks, root)
        store.write_postings(chunks, root)
        embed = make_embedder(embedder, cfg.dim, model)
        chunks.select("chunk_id", embed[0](F.col("text")).alias("v")).write.mode("overwrite").parquet(f"{root}/dense")
        store.write_manifest(spark, root, {"version": store.VERSION, "n_chunks": n, "n_docs": chunks.select("doc_id").distinct().count(), "embedder": embedder, "config": asdict(cfg)})
        return cls(spark, root, cfg, embed)

    @classmethod
    def load(cls, spark: SparkSession, root: str, model=None, reranker: str | None = None) -> Retrieval:
        """Open an index; settings and embedder are those it was built with."""
        manifest = store.read_manifest(spark, root)
        cfg = config.RetrievalConfig(**manifest["config"])
        return cls(spark, root, cfg, make_embedder(manifest["embedder"], cfg.dim, model), make_reranker(reranker))

    def questions(self, texts: list[str]) -> DataFrame:
        config.check_request(batch=texts)
        for t in texts:
            config.check_request(question=t)
        return self.spark.createDataFrame(list(enumerate(texts)), "qid long, question string")

    def retrieve(self, questions: DataFrame, final_k: int | None = None, mode: str = "hybrid", rerank: bool | None = None) -> DataFrame:
        """Hits (qid, id, doc_id, source, position, text, score, dense_rank, sparse_rank, rank). ``final_k`` 0 or None is the default.

        ``rerank`` None means: if there is a reranker. An unknown mode has no hits.
        """
        k = final_k or self.cfg.final_k
        config.check_request(top_k=k)
        none = questions.select("qid", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("rank")).limit(0)
        dense = sparse = none
        if mode in ("hybrid", "dense"):
            vectors = self.spark.read.parquet(f"{self.root}/dense").select(F.col("chunk_id").alias("id"), "v")
            dense = knn.exact_topk(vectors, questions.select("qid", self.embedder[1](F.col("question")).alias("q")), self.cfg.dense_k)
        if mode in ("hybrid", "sparse"):
            sparse = store.search_postings(self.spark, self.root, questions, self.cfg.sparse_k)
        use = self.reranker if rerank in (None, True) else None
        cut = hybrid.candidate_cut(hybrid.fuse(dense, sparse, self.cfg.rrf_k), k, self.cfg.rerank_top_n if use else None)
        chunks = self.spark.read.parquet(f"{self.root}/chunks").withColumnRenamed("chunk_id", "id")
        return hybrid.order_hits(chunks.join(bm25._small(cut), "id"), questions, k, use)

    def answer(self, questions: DataFrame, final_k: int | None = None) -> DataFrame:
        """(qid, answer): the nearest sentences of the hits with citations."""
        return hybrid.extractive_answer(self.retrieve(questions, final_k), questions, self.cfg.max_sentences)

    def prompts(self, questions: DataFrame, final_k: int | None = None) -> DataFrame:
        """(qid, prompt) for a language model outside the engine."""
        return hybrid.build_prompt(self.retrieve(questions, final_k), questions, self.cfg.max_context_chars, "source")

    def evaluate(self, items: DataFrame, ks: tuple[int, ...] = evaluate.KS) -> DataFrame:
        """Report table of an eval set (question, relevant_doc_ids) in every mode, and with re-ranking where there is a reranker."""
        items = items.withColumn("qid", F.xxhash64("question"))
        questions, relevant = items.select("qid", "question"), items.select("qid", F.col("relevant_doc_ids").alias("relevant_ids"))
        runs = [("dense", "dense", False), ("sparse", "sparse", False), ("hybrid", "hybrid", False)] + [("hybrid+rerank", "hybrid", True)] * (self.reranker is not None)
        out = None
        for name, mode, rerank in runs:
            hits = self.retrieve(questions, max(ks), mode, rerank).select("qid", F.col("doc_id").alias("id"), "rank")
            one = evaluate.mean_metrics(evaluate.retrieval_metrics(hits, relevant, ks)).withColumn("mode", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return evaluate.report_table(out, ks)


@dataclass
class Vectors:
    """A sharded vector index with a delta of upserts."""

    spark: SparkSession
    root: str
    cfg: config.IndexConfig
    manifest: dict

    @classmethod
    def build(cls, vectors: DataFrame, root: str, cfg: config.IndexConfig, backend: str = "flat", only_shards: list[int] | None = None) -> Vectors:
        """``vectors(id, v)`` under ``root``; ``ivfpq`` also trains cells and codes on a bounded sample.

        ``only_shards``: the shards of this node, of those that ``cfg.shards`` makes of the whole set.
        """
        spark, m = vectors.sparkSession, config_m(cfg)
        store.write_vectors(vectors, root, cfg.shards, uuid.uuid4().hex, only_shards)
        manifest = store.read_manifest(spark, root) | {"backend": backend, "config": asdict(cfg)}
        if backend == "ivfpq":
            from sparkseek.functions.vectors import resolve_nlist

            rows = store.read_vectors(spark, root)
            n = rows.count()
            cells = ivfpq.train_coarse(rows, resolve_nlist(n, min(n, 100_000), cfg.nlist))
            cells.write.mode("overwrite").parquet(f"{root}/cells")
            ivfpq.train_codebooks(rows, m, cfg.pq_bits).write.mode("overwrite").parquet(f"{root}/books")
            cells, books = spark.read.parquet(f"{root}/cells"), spark.read.parquet(f"{root}/books")
            index = ivfpq.pq_encode(ivfpq.assign_cells(rows, cells), books, m, cfg.dim)
            index.select("id", "v", "codes", "cell_id").repartition("cell_id").write.mode("overwrite").partitionBy("cell_id").parquet(f"{root}/codes")
        elif backend != "flat":
            raise ValueError(f"unknown backend {backend!r}")
        store.write_manifest(spark, root, manifest)
        return cls(spark, root, cfg, manifest)

    @classmethod
    def load(cls, spark: SparkSession, root: str) -> Vectors:
        manifest = store.read_manifest(spark, root)
        return cls(spark, root, config.IndexConfig(**manifest["config"]), manifest)

    def delta(self) -> DataFrame:
        """Latest upserts of this build; empty if there are none."""
        path = f"{self.root}/delta/{self.manifest['build_id']}"
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], "id long, v array<double>")
        return store.read_delta(self.spark, self.root, self.manifest["build_id"]).select("id", F.col("v").cast("array<double>").alias("v"))

    def search(self, queries: DataFrame, k: int = 10, nprobe: int | None = None, rerank_factor: int | None = None, shards: list[int] | None = None, metadata: DataFrame | None = None) -> DataFrame:
        """``queries(qid, q)`` -> (qid, id, score, rank). The delta is always searched exactly and merged in.

        With ``metadata(id, ...)``, one row an id, its columns follow; null for hits that have none.
        """
        hits = self._search(queries, k, nprobe, rerank_factor, shards)
        return hits if metadata is None else store.attach_metadata(hits, metadata)

    def _search(self, queries: DataFrame, k: int, nprobe: int | None, rerank_factor: int | None, shards: list[int] | None) -> DataFrame:
        nprobe, rerank = self.cfg.search_defaults(nprobe, rerank_factor)
        config.check_request(k=k, nprobe=nprobe, rerank_factor=rerank)
        bad = queries.filter(F.size("q") != self.cfg.dim).limit(1).collect()
        if bad:
            raise ValueError(f"a query has {len(bad[0]['q'])} components, the index {self.cfg.dim}")
        if self.manifest["backend"] == "flat":
            rows = store.read_vectors(self.spark, self.root, shards).select("id", F.col("v").cast("array<double>").alias("v"))
            return knn.exact_topk(rows.unionByName(self.delta()), queries, k)
        cells, books = self.spark.read.parquet(f"{self.root}/cells"), self.spark.read.parquet(f"{self.root}/books")
        index = self.spark.read.parquet(f"{self.root}/codes").withColumn("cell_id", F.col("cell_id").cast("long"))
        if shards is not None:
            index = index.filter(F.pmod("id", F.lit(self.cfg.shards)).isin(shards))
        found = ivfpq.search(index, ivfpq.probe_cells(queries, cells, nprobe, "qid", "q"), queries, books, config_m(self.cfg), self.cfg.dim, k, rerank)
        return knn.merge(found.select("qid", "id", "score").unionByName(knn.exact_topk(self.delta(), queries, k).select("qid", "id", "score")), k)

    def upsert(self, new: DataFrame) -> None:
        """Append ``new(id, v, seq)`` to the delta; ids of the built index are rejected."""
        store.append_delta(knn.require_upserts(new, self.manifest["n_vectors"]), self.root, self.manifest["build_id"])

    def stats(self) -> DataFrame:
        return store.index_stats(store.read_vectors(self.spark, self.root), self.delta(), self.cfg.shards)


def config_m(cfg: config.IndexConfig) -> int:
    from sparkseek.functions.vectors import resolve_pq_m

    return resolve_pq_m(cfg.dim, cfg.pq_m)
