"""BM25 index and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.functions import text as T
from sparkseek.session import written

K1, B = 1.5, 0.75
#: Starts the term of a document's own row of :func:`_joined_search` and :func:`indexed`; no token has this character.
_OWN = "#"
#: Bytes of texts whose terms one task counts, and the most tasks. Terms whose frequencies are broadcast, at most.
TASK_BYTES, MOST_TASKS, COMMON_TERMS = 8 << 20, 2048, 500_000


def terms(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, len, toks): tokens without stop words and their number (A2)."""
    return docs.select(F.col(id).alias("id"), T.tokens(F.col(text)).alias("toks")).withColumn("len", F.size("toks").cast("long"))


def corpus_stats(docs: DataFrame, id: str, text: str) -> DataFrame:
    """One row (n, avg_len): all documents count, also those without a token; 1.0 for none (A4)."""
    return terms(docs, id, text).agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avg_len"))


def postings(docs: DataFrame, id: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(id, term, tf, len) (A1). With ``only(term)``, a small query vocabulary, other terms go before any shuffle.

    ``explode_outer``: a plain explode makes the optimizer filter on the array's size first, which computes it twice.
    """
    rows = terms(docs, id, text).select("id", "len", F.explode_outer("toks").alias("term")).filter("term is not null")
    if only is not None:
        rows = rows.join(_small(only), "term", "left_semi")
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def indexed(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings (id, term, tf, len, df) of a whole table and its statistics, texts tokenised once.

    Texts move once, by id; a document's terms are then counted where it lies. The counts are written, with a row of each
    document's own, from which the statistics come. Frequencies of terms that are common, so few, are broadcast: only
    postings of rare terms move.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // TASK_BYTES
    held = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).repartition(max(cores, min(parts, MOST_TASKS)), "id")
    rows = terms(held, "id", "text").select("id", "len", F.explode_outer(F.array_append("toks", F.lit(_OWN))).alias("term"))
    counted = written(rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"), F.sum("len").alias("total")))
    posted, stats = counted.filter(F.col("term") != _OWN).drop("total"), _stats(counted.filter(F.col("term") == _OWN))
    df = written(document_frequency(posted))
    common = F.broadcast(df.filter(F.col("df") >= posted.count() / COMMON_TERMS))  # no more terms than that have so many
    near = posted.join(common, "term")
    far = posted.join(common, "term", "left_anti").join(df.join(common, "term", "left_anti"), "term")
    return near.unionByName(far), stats


def _stats(own: DataFrame) -> DataFrame:
    return own.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.coalesce(F.sum("total") / F.sum("tf"), F.lit(1.0)).alias("avg_len"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def weights(posted: DataFrame, stats: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Postings with df, counted unless known, idf and weight (V13). ``stats`` is one row."""
    known = posted if "df" in posted.columns else posted.join(document_frequency(posted), "term")
    rows = known.crossJoin(F.broadcast(stats))
    idf = F.log(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("len") / F.col("avg_len")))
    return rows.withColumn("idf", idf).withColumn("weight", F.col("idf") * part)


def top_k(scored: DataFrame, k: int, by: str = "qid", score: str = "score", id: str = "id") -> DataFrame:
    """Best ``k`` rows of each query with their rank: score descending, then id (W1-W3). Pruned before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(id))
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def search(docs: DataFrame, questions: DataFrame, k: int, id: str = "doc_id", text: str = "text", found=None) -> DataFrame:
    """``questions(qid, question)`` -> (qid, id, score, rank): the best ``k`` documents with a matching term.

    Each distinct query term counts once (U4). Texts are read and tokenised once, or not at all with ``found``, the
    :func:`matches.matched` of these tables; no pair of a question and a document leaves a task unless it may be among the best.
    """
    from sparkseek.operators import matches

    if found is None and not matches.fits(docs, questions, id):
        return _joined_search(docs, questions, k, id, text)
    return top_k((found or matches.matched(docs, questions, id, text)).bm25(k, K1, B), k)


def _joined_search(docs: DataFrame, questions: DataFrame, k: int, id: str, text: str) -> DataFrame:
    """The same for ids of any type, by joins.

    Every document leaves one row with its length, from which the statistics come, and a row for each query term in it. That
    table is written, then read twice.
    """
    asked = questions.select("qid", F.explode(F.array_distinct(T.tokens(F.col("question")))).alias("term"))
    known = _small(asked.select("term").distinct().withColumn("_asked", F.lit(True)))
    own = F.concat(F.lit(_OWN), F.pmod(F.xxhash64("id"), F.lit(1024)).cast("string"))  # many keys, should the join shuffle
    rows = terms(docs, id, text).select("id", "len", F.explode_outer(F.array_append("toks", own)).alias("term"))
    is_own = F.col("term").startswith(_OWN)
    rows = rows.join(known, "term", "left").filter(F.col("_asked") | is_own)
    counted = written(rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"), F.sum("len").alias("total")))
    stats = counted.filter(is_own).agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.coalesce(F.sum("total") / F.sum("tf"), F.lit(1.0)).alias("avg_len"))
    weighted = weights(counted.filter(~is_own).drop("total"), stats)
    scored = weighted.select("id", "term", "weight").join(_small(asked), "term").groupBy("qid", "id").agg(F.round(F.sum("weight"), 9).alias("score"))
    return top_k(scored, k)


def _small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
