"""Retrieval metrics, recall of approximate search, latency and perplexity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.operators.ranks import value_ranks

KS = (1, 3, 5, 10)


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row a question: precision, hit, recall at each k and reciprocal rank.

    ``hits(qid, id, rank)``; ``relevant(qid, relevant_ids)`` with no empty list. A question without hits scores zero.
    """
    rows = relevant.join(hits.select("qid", "id", "rank"), "qid", "left").withColumn("rel", F.coalesce(F.array_contains("relevant_ids", F.col("id")), F.lit(False)))
    aggs = []
    for k in ks:
        inside = F.col("rel") & (F.col("rank") <= k)
        aggs += [(F.sum(inside.cast("int")) / k).alias(f"p_at_{k}"), F.max(inside.cast("int")).cast("long").alias(f"hit_at_{k}"), (F.count_distinct(F.when(inside, F.col("id"))) / F.first(F.size("relevant_ids"))).alias(f"recall_at_{k}")]
    first = F.min(F.when(F.col("rel") & (F.col("rank") <= max(ks)), F.col("rank")))
    return rows.groupBy("qid").agg(*aggs, F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"))


def mean_metrics(per_question: DataFrame, by: list[str] | None = None) -> DataFrame:
    names = [c for c in per_question.columns if c not in ("qid", *(by or []))]
    return per_question.groupBy(*(by or [])).agg(F.count("*").alias("n_questions"), *[F.round(F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double")), 6).alias("mrr" if c == "rr" else c) for c in names])


def ann_recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of the true best ``k`` that was found, over all queries."""
    both = truth.filter(F.col("rank") <= k).select("qid", "id").join(found.filter(F.col("rank") <= k).select("qid", "id").distinct(), ["qid", "id"], "left_semi")
    n = truth.agg((F.count_distinct("qid") * k).alias("n"))
    return both.agg(F.count("*").alias("hits")).join(F.broadcast(n)).select(F.round(F.col("hits") / F.col("n"), 6).alias("recall"))


def _at(place: Column) -> Column:
    """The value at a place from 1 on, out of :func:`value_ranks`."""
    return F.max(F.when((F.col("first") <= place) & (place <= F.col("last")), F.col("v")))


def percentiles(rows: DataFrame, value: str, by: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation (A13), null for a group without a value; places come from ranges of values."""
    aggs = []
    for p in at:
        place = (F.col("n") - 1) * F.lit(p) + 1
        share = F.max(place - F.floor(place))
        low, high = _at(F.floor(place)), _at(F.ceil(place))
        aggs.append(F.round(low + F.when(share > 0, (high - low) * share).otherwise(0.0), 6).alias(f"p{round(p * 100)}"))
    return value_ranks(rows, by, value).groupBy(*by).agg(*aggs)


def nearest_rank(rows: DataFrame, value: str, by: list[str], q: float = 0.95) -> DataFrame:
    """Median and the value at index ``min(n - 1, int(q * n))`` of the sorted values (A14); groups without a value have no row."""
    n = F.col("n")
    middle = (_at(F.floor((n + 1) / 2)) + _at(F.ceil((n + 1) / 2))) / 2
    index = F.least(n - 1, F.floor(n * q)) + 1
    return value_ranks(rows, by, value).filter("n > 0").groupBy(*by).agg(F.round(middle, 6).alias("median"), F.round(_at(index), 6).alias("p95"))


def load_test(requests: DataFrame, threads: str = "threads", started: str = "started", ms: str = "ms") -> DataFrame:
    """Requests, queries a second over the span from the first start to the last end, and latencies of each number of threads.

    ``started`` is in milliseconds; rows without a latency failed and count as errors only.
    """
    ok = F.col(ms).isNotNull()
    span = F.max(F.when(ok, F.col(started) + F.col(ms))) - F.min(F.when(ok, F.col(started)))
    done = requests.groupBy(threads).agg(F.count(F.when(ok, 1)).alias("n"), F.count(F.when(~ok, 1)).alias("errors"), F.round(F.count(F.when(ok, 1)) * 1000.0 / span, 6).alias("qps"))
    spread = percentiles(requests, ms, [threads]).withColumnRenamed(threads, "_threads")
    return done.join(spread, F.col(threads).eqNullSafe(F.col("_threads"))).drop("_threads")


def last_n(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The newest ``n`` rows (W18): a top-n, pruned in every partition."""
    return rows.orderBy(*order).limit(n)


def latency_reduction(rows: DataFrame, base: str, opt: str, by: str = "lang", kind: str = "kind", value: str = "ms") -> DataFrame:
    """1 - opt / base of each group's means, and the unweighted mean over groups."""
    mean = lambda k: F.avg(F.when(F.col(kind) == k, F.col(value)))
    per = rows.filter(F.col(kind).isin(base, opt)).groupBy(by).agg(mean(base).alias("base"), mean(opt).alias("opt"))
    return per.filter("base is not null and opt is not null").withColumn("reduction", 1 - F.col("opt") / F.col("base"))


def perplexity(rows: DataFrame, by: str = "lang_code") -> DataFrame:
    """Token-weighted loss and exp(min(loss, 50)) of each group."""
    loss = F.sum("loss_sum") / F.sum("tokens")
    return rows.groupBy(by).agg(F.sum("tokens").cast("long").alias("tokens"), F.round(loss, 6).alias("loss"), F.round(F.exp(F.least(loss, F.lit(50.0))), 6).alias("ppl"))


def operating_point(points: DataFrame, target_ms: float) -> DataFrame:
    """Highest recall among the points within the latency budget, first of the sweep on ties."""
    return points.filter(F.col("p99") <= target_ms).orderBy(F.col("recall").desc(), "sweep_pos").limit(1)


def report_table(per_mode: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Mode comparison as printed: P@k of every k, hit@5 (of the largest k where 5 is none), MRR."""
    hit = 5 if 5 in ks else max(ks)
    return per_mode.select("mode", *[f"p_at_{k}" for k in ks], F.col(f"hit_at_{hit}").alias("hit"), "mrr")
