"""Queries over documents: tokens, BM25, chunks, fusion, answers, retrieval metrics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions import text as T
from sparkseek.functions.embed import hash_embedder, hash_rows
from sparkseek.operators import bm25, evaluate, hybrid, knn, matches
from sparkseek.plans import _sql as S
from sparkseek.session import spread, written
from sparkseek.sources import files, store

CHUNK, OVERLAP, MIN_CHARS = 800, 120, 200


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def long(c: str):
    return F.col(c).cast("long").alias(c)


def tokenize_terms(spark, d):
    t = docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


def term_frequency(spark, d):
    return bm25.postings(docs(spark, d), "doc_id", "text").select(F.col("id").alias("doc_id"), "term", "tf")


def document_frequency(spark, d):
    return bm25.document_frequency(bm25.postings(docs(spark, d), "doc_id", "text"))


def corpus_stats(spark, d):
    return bm25.corpus_stats(docs(spark, d), "doc_id", "text").select("n", F.round("avg_len", 6).alias("avg_len"))


def bm25_weights(spark, d):
    w = bm25.weights(*bm25.indexed(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text"))
    return w.select(F.col("id").alias("doc_id"), "term", "tf", "df", F.round("weight", 6).alias("weight"))


def bm25_search_topk(spark, d):
    hits = bm25.search(docs(spark, d), questions(spark, d), 10)
    return hits.select("qid", "rank", "id", F.round("score", 6).alias("score"))


def stopword_filter_counts(spark, d):
    t = docs(spark, d).select("lang", F.size(T.tokens(F.col("text"), False)).alias("a"), F.size(T.tokens(F.col("text"))).alias("b"))
    return t.groupBy("lang").agg(F.sum("a").alias("all_tokens"), F.sum("b").alias("kept_tokens"))


def bigram_counts(spark, d):
    g = docs(spark, d).select(T.tokens(F.col("text"), False).alias("t")).select(F.explode_outer(T.bigrams(F.col("t"))).alias("gram")).filter("gram is not null")
    return g.groupBy("gram").agg(F.count("*").alias("n"))


def sentence_split(spark, d):
    s = docs(spark, d).select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"), F.md5(F.array_join("s", "|")).alias("digest"))


def _chunks(spark, d):
    return files.chunk_documents(docs(spark, d), CHUNK, OVERLAP)


def chunk_split(spark, d):
    return _chunks(spark, d).select("doc_id", long("position"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def chunk_min_filter_positions(spark, d):
    c = files.chunk_documents(docs(spark, d), CHUNK, OVERLAP, MIN_CHARS)
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("position").cast("long").alias("last_position"), F.min(F.length("text")).cast("long").alias("shortest"))


def chunk_store_counts(spark, d):
    return _chunks(spark, d).agg(F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"))


def chunk_lookup(spark, d):
    numbered = files.number_chunks(_chunks(spark, d))
    wanted = spark.read.parquet(f"{d}/benchmark.parquet").select((F.col("item_id") * 7).alias("chunk_id")).union(spark.range(1).select(F.lit(-1).cast("long")))
    return store.get_many(numbered, wanted).select("chunk_id", "doc_id", long("position"), F.md5("text").alias("digest"))


def _found(rows: DataFrame, q: DataFrame) -> matches.Matches:
    """Query terms of each document, for both rankers; texts are tokenised once."""
    return matches.matched(rows, q, "doc_id", "text")


def lexical_ranker(d: DataFrame, q: DataFrame, k: int, found: matches.Matches | None = None) -> DataFrame:
    """Cosine of token sets as the dense ranker of queries that SQL has to state.

    The overlap is counted over shared terms, so no pair of a question and a document without one is made.
    """
    return bm25.top_k((found or _found(d, q)).cosine(k), k)


def _fused(spark, d):
    q, rows = questions(spark, d), docs(spark, d)
    found = _found(rows, q)
    return hybrid.fuse(lexical_ranker(rows, q, 50, found), bm25.search(rows, q, 50, found=found))


def rrf_fusion(spark, d):
    return _fused(spark, d).select("qid", "id", long("dense_rank"), long("sparse_rank"), F.round("score", 9).alias("score"), "fused_rank")


def candidate_cut(spark, d):
    return hybrid.candidate_cut(_fused(spark, d), 5, 30).select("qid", "id", "fused_rank")


def _hits(spark, d, k=5, rerank=None):
    rows, q = docs(spark, d), questions(spark, d)
    found = _found(rows, q)
    return hybrid.retrieve(rows, q, k, "hybrid", 50, partial(lexical_ranker, found=found), rerank, 30, found=found)


def rerank_lexical(spark, d):
    return _hits(spark, d, 5, hybrid.lexical_reranker).select("qid", "rank", "id", F.round("rerank_score", 6).alias("rerank_score"))


def hybrid_retrieve(spark, d):
    """Hash embeddings as the dense ranker: not expressible in SQL (no CRC there); tested against NumPy."""
    embed = hash_embedder(384)

    def dense(rows, q, k):
        return knn.exact_topk(hash_rows(rows, "doc_id", "text", 384), q.select("qid", embed(F.col("question")).alias("q")), k)

    return hybrid.retrieve(docs(spark, d), questions(spark, d), 5, "hybrid", 50, dense).select("qid", "rank", "id", F.bround("score", 5).alias("score"), "dense_rank", "sparse_rank")


def hash_embed(spark, d):
    v = docs(spark, d).select("doc_id", hash_embedder(384)(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").cast("long").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"))


def context_budget(spark, d):
    return hybrid.context_budget(_hits(spark, d), 6000).select("qid", "rank", "id", F.col("used").cast("long").alias("used"))


def prompt_blocks(spark, d):
    p = hybrid.build_prompt(_hits(spark, d), questions(spark, d), 6000)
    return p.select("qid", F.length("prompt").cast("long").alias("chars"), F.md5("prompt").alias("digest"))


def extractive_answer(spark, d):
    return hybrid.extractive_answer(_hits(spark, d), questions(spark, d))


def _relevant(spark, d):
    """Documents that contain a question's passage verbatim; questions without one are left out.

    Candidates share the passage's rarest-looking token: its longest, so the containment test runs on matches only.
    """
    q = questions(spark, d).withColumn("key", F.array_max(F.transform(T.tokens(F.col("question")), lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))).t)
    rows = docs(spark, d).select("doc_id", "text", F.explode_outer(F.array_distinct(T.tokens(F.col("text")))).alias("key"))
    pairs = rows.join(bm25._small(q), "key").filter(F.contains("text", "question"))
    return pairs.groupBy("qid").agg(F.sort_array(F.collect_set("doc_id")).alias("relevant_ids"))


def retrieval_metrics(spark, d):
    rel = _relevant(spark, d)
    m = evaluate.retrieval_metrics(bm25.search(docs(spark, d), questions(spark, d), 10), rel)
    return m.select("qid", *[F.round(F.coalesce(F.col(c), F.lit(0)).cast("double"), 6).alias(c) for c in m.columns if c != "qid"])


def mode_comparison(spark, d):
    q, rows = questions(spark, d), docs(spark, d)
    found = _found(rows, q)
    rel, sparse, dense = written(_relevant(spark, d)), written(bm25.search(rows, q, 50, found=found)), written(lexical_ranker(rows, q, 50, found))
    none = sparse.select("qid", "id", "rank").limit(0)
    modes = {"dense": hybrid.fuse(dense, none), "hybrid": hybrid.fuse(dense, sparse), "sparse": hybrid.fuse(none, sparse)}
    out = None
    for name, fused in modes.items():
        per = evaluate.retrieval_metrics(fused.select("qid", "id", F.col("fused_rank").alias("rank")).filter("rank <= 10"), rel)
        one = evaluate.mean_metrics(per).withColumn("mode", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return evaluate.report_table(out)


_CHUNKS = rf"""p AS (SELECT doc_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents WHERE text IS NOT NULL),
    pieces AS (SELECT doc_id, CASE WHEN length(t) <= {CHUNK} THEN [t] ELSE flatten(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)),
        lambda x: CASE WHEN length(x) <= {CHUNK} THEN [x] ELSE list_transform(range(0, CAST(ceil(length(x) / {CHUNK}.0) AS BIGINT)), lambda i: substr(x, i * {CHUNK} + 1, {CHUNK})) END)) END AS ps FROM p WHERE t <> ''),
    folded AS (SELECT doc_id, list_reduce(list_transform(ps, lambda x: {{'out': []::VARCHAR[], 'buf': x}}), lambda a, x:
        CASE WHEN a.buf = '' THEN {{'out': a.out, 'buf': x.buf}} WHEN length(a.buf) + 1 + length(x.buf) <= {CHUNK} THEN {{'out': a.out, 'buf': a.buf || ' ' || x.buf}}
        WHEN length(a.buf) <= {OVERLAP} THEN {{'out': list_append(a.out, a.buf), 'buf': x.buf}}
        WHEN substr(right(a.buf, {OVERLAP}), strpos(right(a.buf, {OVERLAP}), ' ') + 1) = '' THEN {{'out': list_append(a.out, a.buf), 'buf': x.buf}}
        ELSE {{'out': list_append(a.out, a.buf), 'buf': substr(right(a.buf, {OVERLAP}), strpos(right(a.buf, {OVERLAP}), ' ') + 1) || ' ' || x.buf}} END) AS f FROM pieces),
    cs AS (SELECT doc_id, CASE WHEN f.buf = '' THEN f.out ELSE list_append(f.out, f.buf) END AS c FROM folded),
    ch AS (SELECT doc_id, unnest(c) AS text, unnest(range(0, len(c))) AS position FROM cs)"""
_HITS = f"{S.FUSED}, ht AS (SELECT fr.qid, fr.id, fr.fused_rank AS rank, dd.text FROM fr JOIN documents dd ON fr.id = dd.doc_id WHERE fr.fused_rank <= 5)"
_BLOCKS = f"""{_HITS}, bl AS (SELECT *, '[' || rank || '] (source: ' || id || ')' || chr(10) || text AS block FROM ht),
    us AS (SELECT *, CAST(sum(length(block)) OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS used FROM bl), kp AS (SELECT * FROM us WHERE rank = 1 OR used <= 6000)"""
_REL = "rel AS (SELECT item_id AS qid, list(DISTINCT doc_id) AS ids FROM benchmark b JOIN documents dd ON contains(dd.text, b.text) GROUP BY item_id)"


def _metrics(hits: str) -> str:
    cols = "".join(
        f", coalesce(sum(CASE WHEN ok AND rank <= {k} THEN 1 ELSE 0 END) / {k}.0::DOUBLE, 0) AS p_at_{k}, coalesce(max(CASE WHEN ok AND rank <= {k} THEN 1 ELSE 0 END), 0)::DOUBLE AS hit_at_{k}, count(DISTINCT CASE WHEN ok AND rank <= {k} THEN id END) / any_value(len(ids))::DOUBLE AS recall_at_{k}"
        for k in evaluate.KS
    )
    return f"SELECT qid{cols}, coalesce(1.0::DOUBLE / min(CASE WHEN ok AND rank <= 10 THEN rank END), 0) AS rr FROM (SELECT rel.qid, h.id, h.rank, ids, coalesce(list_contains(ids, h.id), false) AS ok FROM rel LEFT JOIN {hits} h ON rel.qid = h.qid) GROUP BY qid"


def _mode(name: str, hits: str) -> str:
    names = ", ".join(f"round(avg(p_at_{k}), 6) AS p_at_{k}" for k in evaluate.KS)
    return f"SELECT '{name}' AS mode, {names}, round(avg(hit_at_10), 6) AS hit, round(avg(rr), 6) AS mrr FROM ({_metrics(hits)})"


_METRIC_NAMES = [f"{m}_at_{k}" for k in evaluate.KS for m in ("p", "hit", "recall")] + ["rr"]

QUERIES = {
    "tokenize_terms": (tokenize_terms, f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {S.toks('text')} AS t FROM documents)"),
    "term_frequency": (term_frequency, f"WITH {S.POSTINGS} SELECT id AS doc_id, term, tf FROM po"),
    "document_frequency": (document_frequency, f"WITH {S.POSTINGS} SELECT term, df FROM df"),
    "corpus_stats": (corpus_stats, f"WITH {S.POSTINGS} SELECT n, round(al, 6) AS avg_len FROM st"),
    "bm25_weights": (bm25_weights, f"WITH {S.POSTINGS} SELECT id AS doc_id, term, tf, df, round(weight, 6) AS weight FROM w"),
    "bm25_search_topk": (bm25_search_topk, f"WITH {S.BM25} SELECT qid, rank, id, round(score, 6) AS score FROM bm WHERE rank <= 10"),
    "stopword_filter_counts": (stopword_filter_counts, f"SELECT lang, CAST(sum(len({S.all_toks('text')})) AS BIGINT) AS all_tokens, CAST(sum(len({S.toks('text')})) AS BIGINT) AS kept_tokens FROM documents GROUP BY lang"),
    "bigram_counts": (bigram_counts, f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS gram FROM (SELECT {S.all_toks('text')} AS t FROM documents)) GROUP BY gram"),
    "sentence_split": (sentence_split, f"SELECT doc_id, len(s) AS n_sentences, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS chars, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {S.sents('text')} AS s FROM documents)"),
    "chunk_split": (chunk_split, f"WITH {_CHUNKS} SELECT doc_id, position, length(text) AS chars, md5(text) AS digest FROM ch"),
    "chunk_min_filter_positions": (chunk_min_filter_positions, f"WITH {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, count(*) - 1 AS last_position, min(length(text)) AS shortest FROM ch WHERE length(text) >= {MIN_CHARS} GROUP BY doc_id"),
    "chunk_store_counts": (chunk_store_counts, f"WITH {_CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM ch"),
    "chunk_lookup": (chunk_lookup, f"WITH {_CHUNKS} SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id, position) - 1 AS chunk_id, doc_id, position, md5(text) AS digest FROM ch) WHERE chunk_id IN (SELECT item_id * 7 FROM benchmark)"),
    "rrf_fusion": (rrf_fusion, f"WITH {S.FUSED} SELECT qid, id, dense_rank, sparse_rank, round(score, 9) AS score, fused_rank FROM fr"),
    "candidate_cut": (candidate_cut, f"WITH {S.FUSED} SELECT qid, id, fused_rank FROM fr WHERE fused_rank <= 30"),
    "rerank_lexical": (rerank_lexical, f"""WITH {S.FUSED}, rr AS (SELECT fr.qid, fr.id, fused_rank, coalesce(CASE WHEN len(qt) > 0 AND len(s) > 0 THEN round(len(list_intersect(qt, s)) / (sqrt(len(qt)::DOUBLE) * sqrt(len(s)::DOUBLE)), 9) END, 0.0) AS sc
        FROM fr JOIN q USING (qid) JOIN dset ON dset.id = fr.id WHERE fused_rank <= 30) SELECT qid, rank, id, round(sc, 6) AS rerank_score FROM {S.top("rr", 5, "qid", "sc DESC, fused_rank")}"""),
    "hybrid_retrieve": (hybrid_retrieve, None),
    "hash_embed": (hash_embed, f"SELECT doc_id, CAST(384 AS BIGINT) AS dim, CASE WHEN len({S.all_toks('text')}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS norm2 FROM documents"),
    "context_budget": (context_budget, f"WITH {_BLOCKS} SELECT qid, rank, id, used FROM kp"),
    "prompt_blocks": (prompt_blocks, f"""WITH {_BLOCKS} SELECT qid, length(p) AS chars, md5(p) AS digest FROM (SELECT q.qid, 'Context:' || chr(10) || coalesce(b, '') || chr(10) || chr(10) || 'Question: ' || question AS p
        FROM q LEFT JOIN (SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS b FROM kp GROUP BY qid) USING (qid))"""),
    "extractive_answer": (extractive_answer, f"""WITH {_HITS}, se AS (SELECT qid, rank, unnest(x) AS sent, unnest(range(0, len(x))) AS pos FROM (SELECT qid, rank, {S.sents("text")} AS x FROM ht)),
        sc AS (SELECT se.*, qt, list_distinct({S.toks("sent")}) AS s FROM se JOIN q USING (qid)),
        sr AS (SELECT *, round(len(list_intersect(qt, s)) / (sqrt(len(qt)::DOUBLE) * sqrt(len(s)::DOUBLE)), 9) AS score FROM sc WHERE len(qt) > 0 AND len(s) > 0),
        bs3 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, pos) AS r FROM sr WHERE score > 0 QUALIFY r <= 3)
        SELECT q.qid, coalesce(a, '{hybrid.NO_ANSWER}') AS answer FROM q LEFT JOIN (SELECT qid, string_agg(trim(sent) || ' [' || rank || ']', ' ' ORDER BY r) AS a FROM bs3 GROUP BY qid) USING (qid)"""),
    "retrieval_metrics": (retrieval_metrics, f"WITH {S.BM25}, {_REL}, mm AS ({_metrics('(SELECT * FROM bm WHERE rank <= 10)')}) SELECT qid, {', '.join(f'round({c}, 6) AS {c}' for c in _METRIC_NAMES)} FROM mm"),
    "mode_comparison": (mode_comparison, f"WITH {S.FUSED}, {_REL}, h1 AS (SELECT qid, id, fused_rank AS rank FROM fr WHERE fused_rank <= 10), h2 AS (SELECT qid, id, rank FROM lx WHERE rank <= 10), h3 AS (SELECT qid, id, rank FROM bm WHERE rank <= 10) {_mode('hybrid', 'h1')} UNION ALL {_mode('dense', 'h2')} UNION ALL {_mode('sparse', 'h3')}"),
}
