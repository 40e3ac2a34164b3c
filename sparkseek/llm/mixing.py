"""Mix sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a seeded hash and get a virtual finish time: the tokens of their source up to
and including them, over the source's target. Copies of all sources are range-sorted by finish time and the mix is the
longest prefix within the budget. A source may repeat (``max_repeats`` epochs, one full pass after the other).

Both orders are global range sorts with per-range prefix sums, so a source with a third of all rows spreads over as
many tasks as it needs. Targets come from a water-filling loop over the table of sources; only sums reach the driver.

Defined cases: null text has size 0; a document of size 0 takes 0 words; null is a source of its own, ranked last;
repeated rows are documents of their own (equal rows are interchangeable); an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseek.llm._common import cut, drop, prefix_sum, word_count

WEIGHTS = (5, 2, 1)
SEED = "mix-1"


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """``sources(source, source_size)`` -> plus ``rank``, ``start`` (words of the sources before it) and ``target``.

    Sources by code point, null last, take the weights in turn. They share ``share`` times all words; a target stops
    at ``max_repeats`` times its source's size and the excess is shared again by weight until none is above.
    """
    n = sources.count()
    order = [F.col("source").asc_nulls_last()]
    ranked = prefix_sum(sources.withColumn("_one", F.lit(1).cast("long")), order, "_one", "rank", n)
    ranked = prefix_sum(ranked.drop("_one"), order, "source_size", "_end", n).withColumn("start", F.col("_end") - F.col("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_repeats)))
    total, w = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    b, w, full = budget, w or 0.0, -1
    while w:
        over = F.col("cap") * F.lit(float(w)) <= F.col("weight") * F.lit(float(b))
        caps, ws, k = ranked.agg(F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if k == full or not ws:
            break
        b, w, full = budget - (caps or 0.0), ws, k
    w = w or 1.0
    return ranked.withColumn("target", F.least("cap", F.col("weight") * F.lit(float(b)) / F.lit(float(w))))


def mix(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple = WEIGHTS, share: float = 1.5, max_repeats: int = 2, seed: str = SEED) -> DataFrame:
    """Every row of ``docs`` as ``keep`` plus size, source_size, target and taken (the words that the mix takes of it)."""
    base = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_h"))
    base = cut(base)
    rows = base.count()
    sources = source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats)
    line = prefix_sum(base, [F.col("source").asc_nulls_last(), F.col("_h"), F.col("size"), *[F.col(f"_k{i}") for i in range(len(keep))]], "size", "_cum", rows)
    sources = sources.select("source", "source_size", "rank", "start", "target").withColumnRenamed("source", "_s")
    line = line.join(sources, F.col("source").eqNullSafe(F.col("_s"))).withColumn("_cum", F.col("_cum") - F.col("start"))
    line = cut(line.drop("_s", "start"))
    drop(base)
    finish = lambda e: (F.col("_cum") + F.lit(e) * F.col("source_size")).cast("double") / F.col("target")
    copies = F.explode(F.array(*[F.struct(finish(e).alias("f"), F.col("rank").alias("r"), F.lit(e).alias("e"), F.col("_cum").alias("c"), F.col("size").alias("size")) for e in range(max_repeats)]))
    events = line.filter("size > 0 and target > 0").select(copies.alias("x")).select("x.*")
    order = [F.col(c) for c in ("f", "r", "e", "c")]
    total = line.agg(F.sum("size")).first()[0] or 0
    queue = prefix_sum(events, order, "size", "_upto", rows * max_repeats)
    last = queue.filter(F.col("_upto") <= F.lit(float(share * total))).agg(F.max(F.struct(*order)).alias("m")).first()["m"]
    taken = F.lit(0).cast("long")
    if last is not None:
        end = F.struct(F.lit(last["f"]).alias("f"), F.lit(last["r"]).alias("r"), F.lit(last["e"]).alias("e"), F.lit(last["c"]).alias("c"))
        for e in range(max_repeats):
            at = F.struct(finish(e).alias("f"), F.col("rank").alias("r"), F.lit(e).alias("e"), F.col("_cum").alias("c"))
            taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & (at <= end), F.col("size")).otherwise(0)
    return line.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))
