"""Corpus pipeline: the stages a raw document table goes through before training.

1. language ID: documents without a letter or without a likely language go; ``lang`` becomes the predicted one;
2. SimHash near-dedup: of each group of near-duplicates (five-word Jaccard similarity of 0.8 or more, linked through
   others too) the document with the smallest id stays;
3. secret scans: each secret in a text becomes ``<SECRET>``, and ``n_chars`` follows; no document goes;
4. mixing: each document stays as often as the mix of its source takes it (not at all, once or twice);
5. packing: documents become pieces in sequences of at most 1024 tokens.

Each stage works on all that the one before kept, learns from its own input and is written as Parquet in between. All but
the last return the columns of their input. Rows are told apart by their place in the files, so null or repeated ids are
safe. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import language_id, mixing, near_copies, packing, secrets
from sparkseek.llm._common import cut, drop

#: Posterior below which a document has no likely language.
LEAST_SCORE = 0.5
REDACTED = "<SECRET>"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that no other row has, and the key's name.

    A table that was read from files has one for nothing: the file and the row's place in it, the same however the scan
    is split. Any other table is numbered and written.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    if "_metadata" not in docs.columns:
        try:
            return docs.withColumn(name, F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index"))), name
        except AnalysisException:
            pass
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as one struct beside its text, so that no column's name meets one that an operator adds."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a likely language, ``lang`` set to it.

    Null text and text without a letter go, as does a posterior under ``LEAST_SCORE``. Where no row has a label nothing is
    learned and every document goes. Equal scores take the smallest language name; equal rows get equal verdicts.
    """
    judged = language_id.predict(_whole(docs), ["row"], language_id.train(docs))
    kept = judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(F.col("row").withField("lang", F.col("lang_pred")).alias("row")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, null ids last; equal ids go by the text of their place in the files.

    Texts without a word count as copies of each other, null or empty; long texts are compared whole. Equal rows are
    one group, so one of them stays.
    """
    rows, key = _numbered(docs)
    slim = rows.select("doc_id", "text", F.col(key).alias("_row"))
    found = slim.select("_row", "doc_id").join(near_copies.near_copies(slim, "_row"), "_row")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")).alias("m"))
    return rows.join(first.select(F.col("m._row").alias(key)), key, "left_semi").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret in its text replaced by ``REDACTED`` and ``n_chars`` the new length.

    A row without a secret stays as it is, null text and its ``n_chars`` included. Equal rows change alike.
    """
    found = secrets.find_secrets(_whole(docs), ["row"], secrets.train(docs), redact=REDACTED)
    changed = F.col("row").withField("text", F.col("redacted")).withField("n_chars", F.length("redacted").cast("long"))
    return found.select(F.when(F.col("spans") != "", changed).otherwise(F.col("row")).alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A document without a word has size zero and is not taken; a null source is a source of its own, last in order.
    Ties are broken by the row's place in the files, so equal rows are dealt with one by one and reruns agree.
    """
    rows, key = _numbered(docs)
    taken = mixing.mix(rows.select("doc_id", "text", "source", F.col(key).alias("_row")), ["_row"])
    copies = taken.filter("taken > 0").select(F.col("_row").alias(key), F.explode(F.sequence(F.lit(1), F.expr("cast(taken div size as int)"))).alias("_copy"))
    return rows.join(copies.drop("_copy"), key).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, each with its sequence and place there: the columns of ``packing.pack``.

    Null text is empty and packs as its end token alone; a document over 1024 tokens becomes several pieces, and a
    document that the mix repeats is packed as often.
    """
    return packing.pack(docs, ["doc_id"])


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Language models, fingerprints and a tokenizer have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        kept = cut(stage(spark, docs, sf_dir))
        drop(docs)  # what the next stage reads is written; the input table itself is not a cut
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
