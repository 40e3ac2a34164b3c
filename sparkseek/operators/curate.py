"""Instruction-data curation: mapping, cleaning, deduplication, balancing, sampling, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.functions import text as T


def map_columns(raw: DataFrame, lang: str, instruction: str, response: str) -> DataFrame:
    """Logical columns from physical ones; null texts are empty, a null language is the word none."""
    return raw.select(
        "*", T.normalize_lang(F.coalesce(F.col(lang), F.lit("None"))).alias("lang_code"),
        F.coalesce(F.col(instruction), F.lit("")).alias("instr"), F.coalesce(F.col(response), F.lit("")).alias("resp"),
    )


def length_band(text: Column, low: int, high: int) -> Column:
    return F.length(text).between(low, high)


def keep_languages(rows: DataFrame, wanted: list[str], col: str = "lang_code") -> DataFrame:
    """Rows of the wanted languages (codes or names); a pushed-down filter before any cleaning."""
    spark = rows.sparkSession
    codes = [r[0] for r in spark.createDataFrame([(w,) for w in wanted], "w string").select(T.normalize_lang(F.col("w"))).collect()]
    return rows.filter(F.col(col).isin(codes))


def content_key(*cols: Column) -> Column:
    """md5 over the columns with NUL between them."""
    return F.md5(F.concat_ws("\u0000", *cols))


def dedupe_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row of each content key by ``order``.

    The winner comes from a pre-aggregated minimum, so a key with very many copies never meets in one task.
    """
    keyed = rows.withColumn("_key", content_key(*[F.col(k) for k in keys]))
    first = keyed.groupBy("_key").agg(F.min(order).alias(order))
    return keyed.join(first, ["_key", order], "left_semi").drop("_key")


def language_counts(rows: DataFrame, wanted: list[str], col: str = "lang_code") -> DataFrame:
    """Count of each wanted language, zero where it has no rows."""
    base = rows.sparkSession.createDataFrame([(w,) for w in wanted], f"{col} string")
    return base.join(F.broadcast(rows.groupBy(col).agg(F.count("*").alias("n"))), col, "left").select(col, F.coalesce("n", F.lit(0)).alias("n"))


def missing_languages(rows: DataFrame, wanted: list[str], col: str = "lang_code") -> DataFrame:
    return language_counts(rows, wanted, col).filter("n = 0").select(col)


def allocate(counts: DataFrame, budget: int, alpha: float, col: str = "lang_code") -> DataFrame:
    """``counts(lang, n)`` -> plus ``alloc``: water-filling of the budget by n ** alpha, capped by n.

    Languages in order of n ** (1 - alpha) are granted in full while their share covers them; the others take the floor
    of their shares and the largest remainders one more, ties by name. The table has one row a language.
    """
    order = Window.orderBy(F.round(F.pow(F.col("n").cast("double"), 1 - alpha), 9), col)
    rows = counts.filter("n > 0").withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("w_rest", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("total", F.least(F.lit(budget), F.sum("n").over(Window.partitionBy())))
    rows = rows.withColumn("full", (F.col("total") - F.col("before")) * F.col("w") / F.col("w_rest") >= F.col("n") - 1e-9)
    rows = rows.withColumn("full", F.min(F.col("full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    every = Window.partitionBy()
    rows = rows.withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("n"))).over(every), F.lit(0)))
    rows = rows.withColumn("share", F.round(F.col("left") * F.col("w") / F.sum(F.when(~F.col("full"), F.col("w"))).over(every), 9))
    rows = rows.withColumn("base", F.when(F.col("full"), F.col("n")).otherwise(F.floor("share")))
    spare = F.col("left") - F.coalesce(F.sum(F.when(~F.col("full"), F.floor("share"))).over(every), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("full").orderBy((F.col("share") - F.floor("share")).desc(), col))
    rows = rows.withColumn("spare", spare).withColumn("r", rank)
    alloc = F.col("base") + F.when(~F.col("full") & (F.col("r") <= F.col("spare")), 1).otherwise(0)
    given = rows.select(col, alloc.cast("long").alias("alloc"))
    return counts.join(given, col, "left").select(col, "n", F.coalesce("alloc", F.lit(0)).alias("alloc"))


def hash_order(seed: int, key: Column) -> Column:
    """Seeded, engine-independent shuffle key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_rank(rows: DataFrame, key: str, seed: int, col: str = "lang_code") -> DataFrame:
    """``pos``, the row number of each group in the seeded order, and ``size``, the rows of the group.

    The first digits of the hash deal every group into 4096 buckets of like size. Rows are numbered inside a bucket and
    start after the group's buckets before it, so a group with a third of all rows spreads over many tasks.
    """
    keyed = rows.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = keyed.groupBy(F.col(col).alias("_g"), F.col("_b").alias("_c")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_g", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy("_g")).alias("size"))
    inside = F.row_number().over(Window.partitionBy(col, "_b").orderBy("_h", key))
    ranked = keyed.withColumn("_r", inside).join(starts, F.col(col).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c")))
    return ranked.withColumn("pos", F.col("_start") + F.col("_r")).drop("_h", "_b", "_g", "_c", "_start", "_r")


def balanced_sample(rows: DataFrame, alloc: DataFrame, key: str, seed: int = 0, col: str = "lang_code") -> DataFrame:
    """The ``alloc`` rows of each language that come first in the seeded order."""
    wanted = F.broadcast(alloc.select(col, "alloc"))  # a row a language
    return hash_rank(rows, key, seed, col).join(wanted, col).filter(F.col("pos") <= F.col("alloc")).drop("size")


def stratified_split(rows: DataFrame, fraction: float, most: int, key: str, seed: int = 0, col: str = "lang_code") -> DataFrame:
    """``split``: train or val. A language gives min(most, max(1, round half even of n * fraction)) to val, none if it has one row."""
    n = F.col("size")
    n_val = F.when(n < 2, 0).otherwise(F.least(F.lit(most), F.greatest(F.lit(1), F.bround(n * F.lit(float(fraction))).cast("long"))))
    return hash_rank(rows, key, seed, col).withColumn("split", F.when(F.col("pos") <= n_val, "val").otherwise("train")).select(*rows.columns, "split")


def split_stats(split: DataFrame, raw: DataFrame, col: str = "lang_code") -> DataFrame:
    """Per language: raw_clean, selected, train, val."""
    chosen = split.groupBy(col).agg(F.count("*").alias("selected"), F.sum((F.col("split") == "train").cast("long")).alias("train"), F.sum((F.col("split") == "val").cast("long")).alias("val"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return raw.groupBy(col).agg(F.count("*").alias("raw_clean")).join(chosen, col, "left").select(col, "raw_clean", zero("selected"), zero("train"), zero("val"))


def instruction_pairs(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn right after them."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    nxt = conversations.withColumns({"next_role": F.lead("role").over(order), "response": F.lead("text").over(order)})
    return nxt.filter("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("instruction"), "response")


def prepare(raw: DataFrame, wanted: list[str], budget: int, alpha: float, low: int, high: int, fraction: float, most: int, order: str, seed: int = 0) -> DataFrame:
    """Curation end to end: map, filter by language, normalise, length band, dedupe, balance, sample, split."""
    rows = keep_languages(map_columns(raw, "lang", "instruction", "response"), wanted)
    rows = rows.withColumns({"instr": T.nfc(F.col("instr")), "resp": T.nfc(F.col("resp"))}).filter(length_band(F.col("instr"), low, high) & length_band(F.col("resp"), low, high))
    rows = dedupe_first(rows, ["lang_code", "instr", "resp"], order)
    alloc = allocate(rows.groupBy("lang_code").agg(F.count("*").alias("n")), budget, alpha)
    return stratified_split(balanced_sample(rows, alloc, order, seed), fraction, most, order, seed)
