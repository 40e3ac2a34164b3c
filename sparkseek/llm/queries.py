"""Queries of the training-data operators, by name, and DuckDB SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import caps, language_id, lm_scoring, mixing, oracles, packing, quality, reply_trees, secrets, simhash, url_filter
from sparkseek.session import spread

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
CONTROL = "<|im_end|><|im_start|>assistant ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows  # a table of one file is one task otherwise


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, keep=["page_id"])


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    out = reply_trees.format_trees(reply_trees.as_tree(rows.union(extra)))
    turns, loss = reply_trees.read_back(F.col("formatted")), reply_trees.loss_text(F.col("formatted"), F.col("loss_spans"))
    out = out.select("conv_id", turns.alias("_t"), loss.alias("_l"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("_t", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("_t").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("_l").cast("long").alias("loss_chars"), F.sha2("_l", 256).alias("loss_sha256"), "formatted_chars")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.fold(F.col("doc_id"), 7) == 2
    out = lm_scoring.score(docs.withColumn("held_out", held), ~F.col("held_out"), ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), ["doc_id"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.fold(F.col("doc_id"), 3) == 1
    model = language_id.train(docs.filter(~held))
    return language_id.predict(docs, ["doc_id"], model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.find_secrets(docs, ["doc_id"], secrets.train(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", *quality.STATS, "base_failed", "kept")


def op10_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters, "op2_chat_formatting": op2_chat_formatting, "op3_mixing": op3_mixing, "op4_simhash": op4_simhash, "op5_lm_scoring": op5_lm_scoring, "op6_packing": op6_packing,
        "op7_language_id": op7_language_id, "op8_secrets": op8_secrets, "op9_quality": op9_quality, "op10_spherical_caps": op10_spherical_caps,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": oracles.url_filters(), "op2_chat_formatting": oracles.chat_formatting(), "op3_mixing": oracles.mixing(), "op10_spherical_caps": oracles.spherical_caps()}
