"""Queries over documents, conversations and events: curation, examples, reports, metadata, latency."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkseek.functions import text as T
from sparkseek.operators import curate, evaluate, examples
from sparkseek.plans import _sql as S
from sparkseek.session import spread, written
from sparkseek.sources import files, store

WANTED = ["eng", "fra", "deu", "spa", "tel"]
BUDGET, ALPHA, FRACTION, MOST, SEED = 500, 0.5, 0.1, 30, 7
LOW, HIGH = 8, 6000
EOS, MAX_LEN, BATCH, PAD = 0, 1024, 8, 0
LAST = 5000


def _docs(spark, d):
    return spread(spark.read.parquet(f"{d}/documents.parquet")).withColumn("lang_code", T.normalize_lang(F.col("lang")))


def _clean(spark, d):
    """Documents in the length band, first of each content by id."""
    rows = _docs(spark, d).withColumn("text", T.strip(F.col("text"))).filter(curate.length_band(F.col("text"), LOW, HIGH))
    return curate.dedupe_first(rows.select("doc_id", "lang_code", "text"), ["lang_code", "text"], "doc_id").select("doc_id", "lang_code")


def normalize_lang(spark, d):
    return _docs(spark, d).select("doc_id", "lang_code", T.normalize_lang(F.concat(F.lit(" "), F.upper("lang"), F.lit(" "))).alias("from_upper"))


def clean_length_band(spark, d):
    rows = _docs(spark, d).withColumn("text", T.nfc(F.col("text"))).filter(curate.length_band(F.col("text"), LOW, HIGH))
    return rows.groupBy("lang_code").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


def dedupe_exact(spark, d):
    return _clean(spark, d)


def language_counts(spark, d):
    return curate.language_counts(_clean(spark, d), WANTED)


def missing_languages(spark, d):
    return curate.missing_languages(_clean(spark, d), WANTED)


def _alloc(spark, d):
    return curate.allocate(curate.language_counts(_clean(spark, d), WANTED), BUDGET, ALPHA)


def language_allocation(spark, d):
    return _alloc(spark, d)


def _sample(spark, d):
    return curate.balanced_sample(_clean(spark, d), _alloc(spark, d), "doc_id", SEED).select("doc_id", "lang_code")


def balanced_sample(spark, d):
    return _sample(spark, d)


def stratified_split(spark, d):
    return curate.stratified_split(_sample(spark, d), FRACTION, MOST, "doc_id", SEED)


def split_stats(spark, d):
    return curate.split_stats(stratified_split(spark, d), _clean(spark, d))


def global_shuffle(spark, d):
    """Seeded order of the training rows, as a rank."""
    rows = stratified_split(spark, d).filter("split = 'train'")
    return curate.hash_rank(rows, "doc_id", SEED + 1).select("doc_id", "pos")


def _pairs(spark, d):
    return curate.instruction_pairs(spark.read.parquet(f"{d}/conversations.parquet"))


def instruction_pairs(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.md5("instruction").alias("instruction"), F.md5("response").alias("response"))


def first_n_per_language(spark, d):
    r = _docs(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("lang_code").orderBy("doc_id")).cast("long"))
    return r.filter("pos <= 16").select("lang_code", "pos", "doc_id")


def _examples(spark, d):
    p = _pairs(spark, d).withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    return examples.build_examples(p, examples.char_ids(examples.render_prompt(F.col("instruction"))), examples.char_ids(F.col("response")), EOS, MAX_LEN)


def _digest(df, *keys):
    joined = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",")).alias(c)
    return df.select(*keys, F.size("input_ids").cast("long").alias("n"), joined("input_ids"), joined("labels"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("attended"))


def masked_examples(spark, d):
    return _digest(examples.supervised(_examples(spark, d)), "key")


def _bucketed(spark, d):
    rows = examples.supervised(_examples(spark, d)).withColumn("part", F.pmod("conv_id", F.lit(5)))
    return examples.length_buckets(rows, BATCH, ["part"], "key")


def length_buckets(spark, d):
    return _bucketed(spark, d).select("key", "part", "bucket", F.size("input_ids").cast("long").alias("n"))


def padded_batches(spark, d):
    return _digest(examples.pad_batches(_bucketed(spark, d), ["part"], PAD), "key", "part", "bucket")


def perplexity_by_lang(spark, d):
    """Loss of each labelled row stands in a formula: a model's output is a table of (loss_sum, tokens) to this engine."""
    rows = _docs(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    rows = rows.select("lang_code", (F.col("n_chars") % 97 + 1).alias("tokens"), ((F.col("n_chars") % 97 + 1) * (1.5 + F.col("quality") * 0.5 + F.col("toxic"))).alias("loss_sum"))
    return evaluate.perplexity(rows)


def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def latency_percentiles(spark, d):
    return evaluate.percentiles(_events(spark, d), "value", ["event_type"])


def latency_nearest_rank(spark, d):
    return evaluate.nearest_rank(_events(spark, d), "value", ["event_type"])


def latency_last_n(spark, d):
    newest = evaluate.last_n(_events(spark, d), LAST, [F.col("ts").desc(), F.col("event_id").desc()])
    return evaluate.percentiles(newest.withColumn("all", F.lit("all")), "value", ["all"])


def latency_reduction(spark, d):
    rows = _events(spark, d).select((F.col("user_id") % 10).alias("lang"), F.when(F.col("event_id") % 2 == 0, "base").otherwise("opt").alias("kind"), "value")
    per = written(evaluate.latency_reduction(rows, "base", "opt", value="value"))
    mean = per.agg(F.round(F.avg("reduction"), 6).alias("reduction")).select(F.lit(-1).cast("long").alias("lang"), "reduction")
    return per.select("lang", F.round("reduction", 6).alias("reduction")).unionByName(mean)


def throughput(spark, d):
    """Rows a second of each event type over its span."""
    e = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    seconds = F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))
    return e.select("event_type", F.round(F.col("n") * 1e6 / seconds, 6).alias("qps"))


def metadata_latest_wins(spark, d):
    rows = _events(spark, d).select("user_id", "ts", "event_id", "event_type", "props")
    return store.latest_metadata(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "props")


def metadata_lookup(spark, d):
    """Payloads of every user; a sentinel id and an id without metadata for each of them get none."""
    meta = metadata_latest_wins(spark, d).select(F.col("user_id").alias("id"), F.col("props").alias("payload"))
    hits = meta.select(F.explode(F.array(F.col("id"), -F.col("id") - 1, F.col("id") + 1_000_000)).alias("id")).select("id", (F.col("id") % 7).alias("rank"))
    return store.attach_metadata(hits, meta)


def html_to_text(spark, d):
    files.ship(spark)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(files.html_text)

    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", text(F.col("html")).alias("t"))
    return pages.select("page_id", F.length("t").cast("long").alias("chars"), F.md5("t").alias("digest"))


_LANG = f"l AS (SELECT doc_id, {S.lang('lang')} AS lang_code, text, n_chars FROM documents)"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CLEAN = f"""{_LANG}, c AS (SELECT min(doc_id) AS doc_id, lang_code FROM (SELECT doc_id, lang_code, trim(text, {_WS}) AS text FROM l) WHERE length(text) BETWEEN {LOW} AND {HIGH} GROUP BY lang_code, text),
    wl(lang_code) AS (VALUES {", ".join(f"('{w}')" for w in WANTED)}), lc AS (SELECT wl.lang_code, count(c.doc_id) AS n FROM wl LEFT JOIN c USING (lang_code) GROUP BY ALL)"""
_ALLOC = f"""{_CLEAN}, a1 AS (SELECT *, n::DOUBLE ** {ALPHA} AS w, round(n::DOUBLE ** {1 - ALPHA}, 9) AS o, least({BUDGET}, sum(n) OVER ()) AS total FROM lc WHERE n > 0),
    a2 AS (SELECT *, coalesce(sum(n) OVER (ORDER BY o, lang_code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(w) OVER (ORDER BY o, lang_code ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr FROM a1),
    a3 AS (SELECT *, min(CASE WHEN (total - bf) * w / wr >= n - 1e-9 THEN 1 ELSE 0 END) OVER (ORDER BY o, lang_code ROWS UNBOUNDED PRECEDING) = 1 AS fl FROM a2),
    a4 AS (SELECT *, total - coalesce(sum(n) FILTER (fl) OVER (), 0) AS lf, sum(w) FILTER (NOT fl) OVER () AS ws FROM a3),
    a5 AS (SELECT *, round(lf * w / ws, 9) AS sh FROM a4),
    a6 AS (SELECT *, lf - coalesce(sum(floor(sh)) FILTER (NOT fl) OVER (), 0) AS sp, row_number() OVER (PARTITION BY fl ORDER BY sh - floor(sh) DESC, lang_code) AS rk FROM a5),
    al AS (SELECT lc.lang_code, lc.n, CAST(coalesce(CASE WHEN fl THEN a6.n ELSE floor(sh) + CASE WHEN rk <= sp THEN 1 ELSE 0 END END, 0) AS BIGINT) AS alloc FROM lc LEFT JOIN a6 USING (lang_code))"""
_SAMPLE = f"""{_ALLOC}, sa AS (SELECT doc_id, lang_code FROM (SELECT c.*, alloc, row_number() OVER (PARTITION BY lang_code ORDER BY md5('{SEED}:' || doc_id), doc_id) AS pos FROM c JOIN al USING (lang_code)) WHERE pos <= alloc)"""
_SPLIT = f"""{_SAMPLE}, sc AS (SELECT *, count(*) OVER (PARTITION BY lang_code) AS n, row_number() OVER (PARTITION BY lang_code ORDER BY md5('{SEED}:' || doc_id), doc_id) AS r FROM sa),
    sp2 AS (SELECT doc_id, lang_code, CASE WHEN r <= CASE WHEN n < 2 THEN 0 ELSE least({MOST}, greatest(1, round_even(n * {FRACTION}::DOUBLE, 0))) END THEN 'val' ELSE 'train' END AS split FROM sc)"""
_PAIRS = "ip AS (SELECT conv_id, turn, text AS instruction, nt AS response FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"
_IDS = "list_transform(regexp_extract_all({}, '(?s).'), lambda c: unicode(c) % 250 + 1)"
_EX = f"""{_PAIRS}, ex0 AS (SELECT conv_id, conv_id * 1000 + turn AS key, {_IDS.format("'<u>' || instruction || '<a>'")} AS p, list_append({_IDS.format("response")}, {EOS}) AS r FROM ip),
    ex AS (SELECT conv_id, key, list_slice(list_concat(p, r), 1, {MAX_LEN}) AS input_ids, list_slice(list_concat(list_transform(p, lambda x: -100), r), 1, {MAX_LEN}) AS labels FROM ex0),
    es AS (SELECT * FROM ex WHERE len(list_filter(labels, lambda x: x <> -100)) > 0),
    bu AS (SELECT *, conv_id % 5 AS part, (row_number() OVER (PARTITION BY conv_id % 5 ORDER BY len(input_ids), key) - 1) // {BATCH} AS bucket FROM es)"""


def _join(c: str) -> str:
    return f"md5(array_to_string({c}, ','))"


_MD5S = f"{_join('input_ids')} AS input_ids, {_join('labels')} AS labels"

QUERIES = {
    "normalize_lang": (normalize_lang, f"WITH {_LANG} SELECT doc_id, lang_code, lang_code AS from_upper FROM l"),
    "clean_length_band": (clean_length_band, f"WITH {_LANG}, t AS (SELECT lang_code, nfc_normalize(trim(text, {_WS})) AS text FROM l) SELECT lang_code, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM t WHERE length(text) BETWEEN {LOW} AND {HIGH} GROUP BY lang_code"),
    "dedupe_exact": (dedupe_exact, f"WITH {_CLEAN} SELECT doc_id, lang_code FROM c"),
    "language_counts": (language_counts, f"WITH {_CLEAN} SELECT lang_code, n FROM lc"),
    "missing_languages": (missing_languages, f"WITH {_CLEAN} SELECT lang_code FROM lc WHERE n = 0"),
    "language_allocation": (language_allocation, f"WITH {_ALLOC} SELECT * FROM al"),
    "balanced_sample": (balanced_sample, f"WITH {_SAMPLE} SELECT doc_id, lang_code FROM sa"),
    "stratified_split": (stratified_split, f"WITH {_SPLIT} SELECT doc_id, lang_code, split FROM sp2"),
    "split_stats": (split_stats, f"WITH {_SPLIT}, g AS (SELECT lang_code, count(*) AS selected, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val FROM sp2 GROUP BY lang_code) SELECT c.lang_code, c.n AS raw_clean, coalesce(selected, 0) AS selected, coalesce(train, 0) AS train, coalesce(val, 0) AS val FROM (SELECT lang_code, count(*) AS n FROM c GROUP BY ALL) c LEFT JOIN g USING (lang_code)"),
    "global_shuffle": (global_shuffle, f"WITH {_SPLIT} SELECT doc_id, row_number() OVER (PARTITION BY lang_code ORDER BY md5('{SEED + 1}:' || doc_id), doc_id) AS pos FROM sp2 WHERE split = 'train'"),
    "instruction_pairs": (instruction_pairs, f"WITH {_PAIRS} SELECT conv_id, turn, md5(instruction) AS instruction, md5(response) AS response FROM ip"),
    "first_n_per_language": (first_n_per_language, f"WITH {_LANG} SELECT lang_code, row_number() OVER (PARTITION BY lang_code ORDER BY doc_id) AS pos, doc_id FROM l QUALIFY pos <= 16"),
    "masked_examples": (masked_examples, f"WITH {_EX} SELECT key, len(input_ids) AS n, {_MD5S}, len(input_ids) AS attended FROM es"),
    "length_buckets": (length_buckets, f"WITH {_EX} SELECT key, part, bucket, len(input_ids) AS n FROM bu"),
    "padded_batches": (padded_batches, f"""WITH {_EX}, pd AS (SELECT *, max(len(input_ids)) OVER (PARTITION BY part, bucket) AS mx FROM bu),
        pq AS (SELECT key, part, bucket, mx, len(input_ids) AS attended, list_concat(input_ids, list_transform(range(0, mx - len(input_ids)), lambda x: {PAD})) AS input_ids, list_concat(labels, list_transform(range(0, mx - len(labels)), lambda x: -100)) AS labels FROM pd)
        SELECT key, part, bucket, mx AS n, {_MD5S}, attended FROM pq"""),
    "perplexity_by_lang": (perplexity_by_lang, f"WITH {_LANG}, r AS (SELECT lang_code, n_chars % 97 + 1 AS tokens, (n_chars % 97 + 1) * (1.5::DOUBLE + quality * 0.5::DOUBLE + toxic) AS ls FROM l JOIN labels USING (doc_id)) SELECT lang_code, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(ls) / sum(tokens), 6) AS loss, round(exp(least(sum(ls) / sum(tokens), 50.0::DOUBLE)), 6) AS ppl FROM r GROUP BY lang_code"),
    "latency_percentiles": (latency_percentiles, "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type"),
    "latency_nearest_rank": (latency_nearest_rank, "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(list_sort(list(value))[least(count(*) - 1, CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT)) + 1], 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type"),
    "latency_last_n": (latency_last_n, f"SELECT 'all' AS \"all\", round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM (SELECT value FROM events ORDER BY ts DESC, event_id DESC LIMIT {LAST})"),
    "latency_reduction": (latency_reduction, "WITH p AS (SELECT user_id % 10 AS lang, 1 - avg(value) FILTER (event_id % 2 <> 0) / avg(value) FILTER (event_id % 2 = 0) AS r FROM events GROUP BY 1) SELECT lang, round(r, 6) AS reduction FROM p WHERE r IS NOT NULL UNION ALL SELECT -1, round(avg(r), 6) FROM p"),
    "throughput": (throughput, "SELECT event_type, round(count(*) * 1e6 / (epoch_us(max(ts)) - epoch_us(min(ts))), 6) AS qps FROM events GROUP BY event_type"),
    "metadata_latest_wins": (metadata_latest_wins, "SELECT user_id, event_id, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "metadata_lookup": (metadata_lookup, "WITH m AS (SELECT user_id, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT id, CAST(id % 7 AS BIGINT) AS rank, m.props AS payload FROM (SELECT unnest([user_id, -user_id - 1, user_id + 1000000]) AS id FROM m) h LEFT JOIN m ON m.user_id = id"),
    "html_to_text": (html_to_text, None),
}
