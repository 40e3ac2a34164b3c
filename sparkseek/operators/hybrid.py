"""Rank fusion, retrieval, re-ranking, prompts and extractive answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.functions import text as T
from sparkseek.operators.bm25 import _small, search

RRF_K = 60
#: Rows up to which a side is broadcast.
SMALL_ROWS = 100_000
NO_ANSWER = "I could not find an answer in the provided documents."


def fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ``(qid, id, rank)`` lists.

    Ties keep dense rank, then sparse rank; so the order is total (W6). One list may be empty: single-mode retrieval
    has the same scores.
    """
    d = dense.select("qid", "id", F.col("rank").alias("dense_rank"))
    s = sparse.select("qid", "id", F.col("rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    both = d.join(s, ["qid", "id"], "full_outer").withColumn("score", part("dense_rank") + part("sparse_rank"))
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last())
    return both.withColumn("fused_rank", F.row_number().over(order).cast("long"))


def candidate_cut(fused: DataFrame, final_k: int, rerank_top_n: int | None = None) -> DataFrame:
    """The candidates worth fetching: ``final_k``, or more if a reranker follows."""
    return fused.filter(F.col("fused_rank") <= (max(rerank_top_n, final_k) if rerank_top_n else final_k))


def retrieve(
    docs: DataFrame, questions: DataFrame, final_k: int = 5, mode: str = "hybrid", candidates: int = 50,
    dense: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None,
    rerank: Callable[[Column, Column], Column] | None = None, rerank_top_n: int = 30, id: str = "doc_id", text: str = "text", found=None,
) -> DataFrame:
    """Hits (qid, id, text, score, ranks, rank) of each question.

    ``dense`` returns (qid, id, rank) for (docs, questions, k). Texts are joined after the cut (late materialisation).
    An unknown mode gives no hits, as does ``dense`` mode without a dense ranker (P8). ``found``: see :func:`bm25.search`.
    """
    none = questions.select("qid", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("rank")).limit(0)
    left = dense(docs, questions, candidates) if dense and mode in ("hybrid", "dense") else none
    right = search(docs, questions, candidates, id, text, found) if mode in ("hybrid", "sparse") else none
    cut = candidate_cut(fuse(left, right), final_k, rerank_top_n if rerank else None)
    # the cut's size is known from the questions: counting it would run the whole retrieval first
    few = questions.count() * max(rerank_top_n if rerank else 0, final_k) <= SMALL_ROWS
    return order_hits(docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(cut) if few else cut, "id"), questions, final_k, rerank)


def order_hits(hits: DataFrame, questions: DataFrame, final_k: int, rerank: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Final ``rank`` of fetched candidates: by the reranker's score if there is one, then by the fused rank."""
    order = [F.col("fused_rank")]
    if rerank:
        hits = hits.join(_small(questions), "qid").withColumn("rerank_score", rerank(F.col("question"), F.col("text"))).drop("question")
        order = [F.col("rerank_score").desc(), F.col("fused_rank")]
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= final_k)


def wire_form(hits: DataFrame, include_text: bool = True) -> DataFrame:
    """Hits as they leave the engine: scores to five digits, half to even."""
    scores = {c: F.bround(F.col(c), 5) for c in ("score", "rerank_score") if c in hits.columns}
    out = hits.withColumns(scores)
    return out if include_text else out.drop("text")


def lexical_reranker(question: Column, passage: Column) -> Column:
    """Stand-in for a cross-encoder where no model is at hand: cosine of the token sets."""
    q, p = F.array_distinct(T.tokens(question)), F.array_distinct(T.tokens(passage))
    return F.when((F.size(q) > 0) & (F.size(p) > 0), F.round(T.lexical_cosine(q, p), 9)).otherwise(0.0)


def context_budget(hits: DataFrame, max_chars: int, label: str = "id") -> DataFrame:
    """Prompt blocks in rank order while their running length fits; the first always stays."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (source: "), F.col(label).cast("string"), F.lit(")\n"), F.col("text"))
    running = F.sum(F.length("block").cast("long")).over(Window.partitionBy("qid").orderBy("rank"))
    return hits.withColumn("block", block).withColumn("used", running).filter((F.col("rank") == 1) | (F.col("used") <= max_chars))


def build_prompt(hits: DataFrame, questions: DataFrame, max_chars: int, label: str = "id") -> DataFrame:
    kept = context_budget(hits, max_chars, label).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    context = F.coalesce(F.array_join(F.transform("b", lambda x: x.block), "\n\n"), F.lit(""))
    return questions.join(kept, "qid", "left").select("qid", F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), F.col("question")).alias("prompt"))


def extractive_answer(hits: DataFrame, questions: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` sentences nearest to the question with their passage numbers, joined."""
    sents = hits.select("qid", "rank", F.posexplode_outer(T.sentences(F.col("text"))).alias("pos", "sent"))
    asked = questions.select("qid", F.array_distinct(T.tokens(F.col("question"))).alias("q"))
    scored = sents.join(_small(asked), "qid").withColumn("s", F.array_distinct(T.tokens(F.col("sent")))).filter((F.size("q") > 0) & (F.size("s") > 0))
    scored = scored.withColumn("score", F.round(T.lexical_cosine(F.col("q"), F.col("s")), 9)).filter("score > 0")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank", "pos")
    best = scored.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)
    said = F.concat(T.strip(F.col("sent")), F.lit(" ["), F.col("rank").cast("string"), F.lit("]"))
    joined = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", said.alias("a")))).alias("x"))
    return questions.select("qid").join(joined, "qid", "left").select("qid", F.coalesce(F.array_join(F.transform("x", lambda y: y.a), " "), F.lit(NO_ANSWER)).alias("answer"))
