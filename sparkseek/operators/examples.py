"""Tokenised training examples: rendering, masking, bucketing, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.operators.ranks import range_rank

IGNORE = -100


def render_prompt(instruction: Column, system: str | None = None, template: str = "<u>{}<a>") -> Column:
    """Prompt text by a template with one place; a system turn goes before it (F16)."""
    head, tail = template.split("{}")
    return F.concat(F.lit((system or "") + head), instruction, F.lit(tail))


def char_ids(text: Column) -> Column:
    """Code point modulo 250, plus one: a stand-in tokenizer with native code only."""
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: (F.pmod(F.ascii(c), F.lit(250)) + 1).cast("int"))


def build_examples(rows: DataFrame, prompt_ids: Column, response_ids: Column, eos: int, max_len: int) -> DataFrame:
    """``input_ids``, ``labels`` (prompt masked), ``attention_mask``, all cut at ``max_len``."""
    rows = rows.withColumns({"_p": prompt_ids, "_r": F.concat(response_ids, F.array(F.lit(eos)))})
    rows = rows.withColumn("input_ids", F.slice(F.concat("_p", "_r"), 1, max_len))
    labels = F.slice(F.concat(F.transform("_p", lambda _: F.lit(IGNORE)), F.col("_r")), 1, max_len)
    return rows.withColumns({"labels": labels, "attention_mask": F.transform("input_ids", lambda _: F.lit(1))}).drop("_p", "_r")


def supervised(examples: DataFrame) -> DataFrame:
    """Examples with at least one unmasked label."""
    return examples.filter(F.exists("labels", lambda x: x != IGNORE))


def length_buckets(examples: DataFrame, batch: int, by: list[str], key: str) -> DataFrame:
    """``bucket``: batches of rows of like length within each group, longest rows last (W15). ``key`` is unique."""
    ranked = range_rank(examples.select(*by, key, F.size("input_ids").alias("_size")), by, ["_size", key], "_rank")
    return examples.join(ranked.select(key, F.floor((F.col("_rank") - 1) / batch).cast("long").alias("bucket")), key)


def pad_batches(bucketed: DataFrame, by: list[str], pad_id: int) -> DataFrame:
    """Rows right-padded to the longest of their batch."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(*by, "bucket"))
    fill = lambda c, x: F.concat(c, F.array_repeat(F.lit(x), F.col("_n") - F.size(c)))
    rows = bucketed.withColumn("_n", longest)
    return rows.withColumns({"input_ids": fill("input_ids", pad_id), "labels": fill("labels", IGNORE), "attention_mask": fill("attention_mask", 0)}).drop("_n")
