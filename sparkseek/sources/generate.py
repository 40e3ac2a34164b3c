"""Deterministic synthetic inputs for trials: a corpus with an eval set, vectors, noisy queries, question-answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TEAMS = ("harbour", "meadow", "granite", "lantern", "orchard")
_TOPICS = ("billing", "search", "storage", "routing", "alerts")
_QUESTIONS = {"deu": "Was ist {} plus {}?", "eng": "What is {} plus {}?", "fra": "Combien font {} plus {} ?", "hin": "{} और {} का योग क्या है?", "spa": "¿Cuánto es {} más {}?", "tel": "{} మరియు {} మొత్తం ఎంత?"}
_ANSWERS = {"deu": "Die Summe ist {}.", "eng": "The sum is {}.", "fra": "La somme est {}.", "hin": "योग {} है।", "spa": "La suma es {}.", "tel": "మొత్తం {}."}


def _pick(values: tuple[str, ...], seed: int, *keys: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(len(values))).cast("int"))


def corpus(spark: SparkSession, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents(doc_id, text), eval set(question, relevant_doc_ids)): three questions a document, each with its code name (G1)."""
    code = F.concat(F.lit("PRJ"), F.lpad(F.conv(F.col("id").cast("string"), 10, 36), 5, "0"))
    team, topic = _pick(_TEAMS, seed, F.col("id"), F.lit("team")), _pick(_TOPICS, seed, F.col("id"), F.lit("topic"))
    days = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(90)) + 10
    rows = spark.range(n).select(F.concat(F.lit("brief_"), F.col("id"), F.lit(".md")).alias("doc_id"), code.alias("code"), team.alias("team"), topic.alias("topic"), days.alias("days"))
    text = F.format_string("Project %s is about %s.\n\nThe %s team owns project %s.\n\nProject %s will take %d days.", "code", "topic", "team", "code", "code", "days")
    asked = F.explode(F.array(*[F.format_string(q, "code") for q in ("What is project %s about?", "Which team owns project %s?", "How long will project %s take?")]))
    return rows.select("doc_id", text.alias("text")), rows.select("doc_id", asked.alias("question")).select("question", F.array("doc_id").alias("relevant_doc_ids"))


def _gauss(seed: int, *keys: Column) -> Column:
    """Standard normal number from a hash of the keys (Box-Muller)."""
    unit = lambda s: (F.pmod(F.xxhash64(F.lit(s), *keys), F.lit(2**31)) + 1) / float(2**31 + 1)
    return F.sqrt(-2 * F.log(unit(seed))) * F.cos(2 * F.pi() * unit(seed + 1))


def vectors(spark: SparkSession, n: int, dim: int = 64, clusters: int = 64, noise: float = 0.6, seed: int = 0) -> DataFrame:
    """``(id, v)``: a Gaussian mixture, unit length."""
    axis = F.sequence(F.lit(0), F.lit(dim - 1))
    cell = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(clusters))
    raw = spark.range(n).withColumn("c", cell).select("id", F.transform(axis, lambda i: _gauss(seed + 2, F.col("c"), i) + noise * _gauss(seed + 4, F.col("id"), i)).alias("r"))
    return _unit(raw)


def noisy_queries(rows: DataFrame, every: int, noise: float = 0.3, seed: int = 1) -> DataFrame:
    """``(qid, q)``: each ``every``-th vector with noise, unit length."""
    moved = rows.filter(F.col("id") % every == 0).select("id", F.transform("v", lambda x, i: x.cast("double") + noise * _gauss(seed, F.col("id"), i) / F.sqrt(F.size("v"))).alias("r"))
    return _unit(moved).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def _unit(rows: DataFrame) -> DataFrame:
    n = F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("n", n).select("id", F.transform("r", lambda x: (x / F.col("n")).cast("float")).alias("v"))


def multilingual(spark: SparkSession, n_per_language: int = 60) -> DataFrame:
    """``(lang, instruction, response)`` rows in six languages."""
    out = None
    for lang in sorted(_QUESTIONS):
        a, b = F.col("id") % 37, F.col("id") + 3
        q, r = _QUESTIONS[lang].split("{}"), _ANSWERS[lang].split("{}")
        asked = F.concat(F.lit(q[0]), a.cast("string"), F.lit(q[1]), b.cast("string"), F.lit(q[2]))
        one = spark.range(n_per_language).select(F.lit(lang).alias("lang"), asked.alias("instruction"), F.concat(F.lit(r[0]), (a + b).cast("string"), F.lit(r[1])).alias("response"))
        out = one if out is None else out.unionByName(one)
    return out
