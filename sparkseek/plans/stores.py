"""Queries through sources, sinks, streams, settings and generators: whole tables written to the shared folder and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from sparkseek.functions import config
from sparkseek.functions import text as T
from sparkseek.functions import vectors as V
from sparkseek.operators import curate, evaluate, hybrid, knn
from sparkseek.plans import _sql as S
from sparkseek.plans import retrieval, vector
from sparkseek.session import scratch, ship, spread, written
from sparkseek.sources import files, generate, store
from sparkseek.streaming import live

SHARDS, THREADS, LAST = 4, 4, 100


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def text_files(spark, d):
    """Every benchmark passage as a file of its own, found and read back."""
    root = scratch(spark)
    _table(spark, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(root)
    read = files.read_documents(spark, root)
    return read.select(F.regexp_extract("doc_id", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "suffix", F.md5(T.strip(F.col("text"))).alias("digest"), "corrupt")


def docx_parse(spark, d):
    """Every text as the paragraphs of a word file, parsed; and the same file cut short, which must not fail."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                data = io.BytesIO()
                body = "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in t.split("\n"))
                with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
                whole, half = files.parse(".docx", data.getvalue()), files.parse(".docx", data.getvalue()[: data.tell() // 2])
                rows.append((i, whole[0], whole[1], half[0] == "" and half[1]))
            yield pd.DataFrame(rows, columns=["doc_id", "text", "corrupt", "half_is_marked"])

    docs = _table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x09\x0B-\x1F]", " ").alias("text"))
    out = docs.mapInPandas(run, "doc_id long, text string, corrupt boolean, half_is_marked boolean")
    return out.select("doc_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"), "corrupt", "half_is_marked")


def _jsonl(spark, d):
    root = scratch(spark)
    rows = _table(spark, d, "documents").select("doc_id", "lang", "source", "text")
    return root, store.write_jsonl(rows, root)


def jsonl_round_trip(spark, d):
    """Documents as JSON lines and back under other names."""
    rows = files.read_jsonl(spark, _jsonl(spark, d)[0], {"id": "doc_id", "language": "lang", "body": "text", "absent": "no_such_field"})
    return rows.select(F.col("id").cast("long").alias("id"), "language", F.md5("body").alias("digest"), "absent")


def named_sources(spark, d):
    """The same rows through each kind of source (S8), and the number that the writer reports."""
    root, n = _jsonl(spark, d)
    at = scratch(spark)
    _table(spark, d, "documents").write.parquet(at)
    parts = [files.read_source(spark, kind, path, {"id": "doc_id"}).select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id")) for kind, path in (("jsonl", root), ("parquet", at), ("json", root))]
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.lit(n).cast("long").alias("written"))


def mapped_columns(spark, d):
    """Logical columns with their defaults."""
    raw = _table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("la"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("q"), F.col("text").alias("a"))
    return curate.map_columns(raw, "la", "q", "a").select("doc_id", "lang_code", "instr", F.md5("resp").alias("resp"))


def language_filter(spark, d):
    rows = _table(spark, d, "documents").withColumn("lang_code", T.normalize_lang(F.col("lang")))
    return curate.keep_languages(rows, ["German", "fr"]).select("doc_id", "lang_code")


def metadata_lines(spark, d):
    """Events as JSON lines of metadata; the payload is what is beside the id."""
    root = scratch(spark)
    _table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type", F.col("user_id").cast("string").alias("user_id")).write.json(root)
    rows = files.read_metadata(spark, root)
    return rows.select("id", F.get_json_object("payload", "$.event_type").alias("event_type"), F.get_json_object("payload", "$.user_id").cast("long").alias("user_id"), F.get_json_object("payload", "$.id").alias("own_id"))


def eval_set(spark, d):
    root = scratch(spark)
    q = _table(spark, d, "benchmark")
    q.select(F.col("text").alias("question"), F.array(F.col("item_id").cast("string"), F.lit("x")).alias("relevant_doc_ids")).write.json(root)
    return files.read_eval_set(spark, root).select(F.get("relevant_doc_ids", F.lit(0)).cast("long").alias("item_id"), F.md5("question").alias("question"), F.size("relevant_doc_ids").cast("long").alias("n"))


def chunk_store(spark, d):
    """Chunks of every document, stored twice (the second replaces the first) and read back."""
    root = scratch(spark)
    cut = written(files.chunk_documents(spread(_table(spark, d, "documents")), retrieval.CHUNK, retrieval.OVERLAP))  # every text is cut once
    chunks = written(files.number_chunks(cut))
    store.write_chunks(chunks.filter("position = 0"), root)
    store.write_chunks(chunks, root)
    return spark.read.parquet(f"{root}/chunks").select("chunk_id", "doc_id", F.col("position").cast("long").alias("position"), F.md5("text").alias("digest"))


def postings_store(spark, d):
    """BM25 over stored weights, documents as chunks."""
    root = scratch(spark)
    store.write_postings(_table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), root)
    return store.search_postings(spark, root, retrieval.questions(spark, d), 10).select("qid", "rank", "id", F.round("score", 6).alias("score"))


def vector_store(spark, d):
    """Vectors by shard, read back whole, with the sizes of the manifest."""
    root = scratch(spark)
    store.write_vectors(vector.vectors(spark, d).select("id", "v"), root, SHARDS, "b1")
    sizes = store.read_manifest(spark, root)["shard_sizes"]
    listed = spark.createDataFrame(list(enumerate(sizes)), "shard_id long, listed long")
    read = store.read_vectors(spark, root).groupBy(F.col("shard_id").cast("long").alias("shard_id")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.round(F.sum(F.get("v", F.lit(0)).cast("double")), 4).alias("first"))
    return read.join(listed, "shard_id")


def shard_subset(spark, d):
    root = scratch(spark)
    store.write_vectors(vector.vectors(spark, d).select("id", "v"), root, SHARDS, "b1")
    return store.read_vectors(spark, root, [1, 3]).select("id", F.col("shard_id").cast("long").alias("shard_id"))


def delta_store(spark, d):
    """Every vector upserted three times in two calls; the last one counts, and another build's delta is not seen."""
    root, rows = scratch(spark), vector.vectors(spark, d).select((F.col("id") + 1_000_000).alias("id"), "v")
    turned = rows.select("id", F.transform("v", lambda x: -x).alias("v"))
    store.append_delta(rows.withColumn("seq", F.lit(1)).unionByName(turned.withColumn("seq", F.lit(3))), root, "b1")
    store.append_delta(rows.withColumn("seq", F.lit(2)), root, "b1")
    store.append_delta(rows.withColumn("seq", F.lit(9)), root, "b2")
    return store.read_delta(spark, root, "b1").select("id", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first"))


def upsert_live(spark, d):
    """A stream of upserts into a stored index, searched with the build."""
    root, src = scratch(spark), scratch(spark)
    rows = vector.vectors(spark, d).select("id", F.col("v").cast("array<double>").alias("v"))
    store.write_vectors(rows, root, SHARDS, "b1")
    rows.select((F.col("id") + 1_000_000).alias("id"), F.transform("v", lambda x: -x).alias("v"), F.lit(1).alias("seq")).write.parquet(src)
    stream = spark.readStream.schema("id long, v array<double>, seq int").parquet(src)
    live.upsert_stream(stream, root, scratch(spark)).awaitTermination()
    both = store.read_vectors(spark, root).select("id", "v").unionByName(store.read_delta(spark, root, "b1").select("id", "v"))
    return both.groupBy((F.col("id") >= 1_000_000).alias("upserted")).agg(F.count("*").alias("n"), F.round(F.sum(F.get("v", F.lit(0))), 4).alias("first"))


def metadata_live(spark, d):
    """Latest metadata of each user from a stream."""
    src, out = scratch(spark), scratch(spark)
    rows = _table(spark, d, "events").select(F.col("user_id").alias("id"), "event_id", "event_type")
    rows.coalesce(1).write.parquet(src)
    live.metadata_stream(spark.readStream.schema(rows.schema).parquet(src), out, "id", ["event_id"], scratch(spark)).awaitTermination()
    return spark.read.parquet(f"{out}/v0").select("id", "event_id", "event_type")


def ingest_live(spark, d):
    """Chunks of every benchmark passage from a stream of files."""
    root, out = scratch(spark), scratch(spark)
    _table(spark, d, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(root)
    live.ingest_stream(spark, root, out, scratch(spark), 100_000, 0).awaitTermination()
    return spark.read.parquet(out).select(F.regexp_extract("doc_id", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.col("position").cast("long").alias("position"), F.md5("text").alias("digest"))


def latency_windows(spark, d):
    """Count and mean of every hour of events, as the stream computes them."""
    w = live.rolling_latency(_table(spark, d, "events"))
    return w.select(F.unix_seconds("window.start").alias("start"), "n", F.round("mean", 6).alias("mean"))


def latency_ring(spark, d):
    """Percentiles over the newest values of each type, kept in a stream's state."""
    src, out = scratch(spark), scratch(spark)
    rows = _table(spark, d, "events").select("event_type", "ts", "value")
    rows.coalesce(1).write.parquet(src)
    found = live.last_n_latency(spark.readStream.schema(rows.schema).parquet(src), LAST)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)

    found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(F.col("key").alias("event_type"), "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def answer_stream(spark, d):
    """Events of a streamed answer: here each question's text in place of an answer, and its own id as the only source."""
    q = retrieval.questions(spark, d)
    hits = q.select("qid", F.lit(1).cast("long").alias("rank"), F.col("qid").alias("id"))
    events = live.answer_events(hits, q.select("qid", F.col("question").alias("answer")))
    return events.select("qid", F.col("seq").cast("long").alias("seq"), "event", "data")


def truth_cache(spark, d):
    """Exact neighbours computed once, then read: the second call's maker fails if it is called."""
    root = scratch(spark)

    def fail():
        raise AssertionError("the cache was not used")

    store.cached_truth(spark, root, lambda: knn.exact_topk(vector.rows_of(spark, d), vector.queries(spark, d), 10), "e", "q", 10)
    return store.cached_truth(spark, root, fail, "e", "q", 10).select("qid", "rank", "id", F.round("score", 6).alias("score"))


def report_file(spark, d):
    """Counts a language as a report file and back."""
    root = scratch(spark)
    store.write_report(_table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")), root)
    return spark.read.schema("lang string, n long").json(root)


def retrieval_modes(spark, d):
    """Hits of each mode; an unknown mode, and dense without a ranker, have none; without text on the wire."""
    docs, q, out = _table(spark, d, "documents"), retrieval.questions(spark, d), None
    for mode in ("sparse", "dense", "neither"):
        hits = hybrid.wire_form(hybrid.retrieve(docs, q, 5, mode), include_text=False)
        assert "text" not in hits.columns
        one = hits.select(F.lit(mode).alias("mode"), "qid", "rank", "id")
        out = one if out is None else out.unionByName(one)
    return out


_REQUESTS = [("top_k", 0), ("top_k", 1), ("top_k", 20), ("top_k", 21), ("nprobe", 4096), ("nprobe", 4097), ("rerank_factor", 0), ("rerank_factor", 65), ("k", 1000), ("k", 1001), ("batch", 256), ("batch", 257)]


def request_limits(spark, d):
    """Verdicts of the request checks on both sides of each limit, and of one of vector and text."""

    def passes(check, *args, **values):
        try:
            check(*args, **values)
        except ValueError:
            return False
        return True

    rows = [(name, value, passes(config.check_request, **{name: value})) for name, value in _REQUESTS]
    rows += [("question", n, passes(config.check_request, question="x" * n)) for n in (0, 1, 2000, 2001)]
    rows += [(f"vector{v is not None}text{t is not None}", len(v or []), passes(config.check_query, v, t, 3)) for v in (None, [1.0] * 3, [1.0] * 2) for t in (None, "t")]
    return spark.createDataFrame(rows, "name string, value long, ok boolean")


def settings(spark, d):
    """Layers and overrides of a configuration, and search defaults."""
    c = config.merge_config({"a": {"x": 1, "y": "2"}, "b": "true"}, {"a": {"x": "3.5"}}, overrides=("a.z=7", "c.d.e=word"))
    rows = [("a.x", str(c["a"]["x"])), ("a.y", str(c["a"]["y"])), ("a.z", str(c["a"]["z"])), ("b", str(c["b"])), ("c.d.e", c["c"]["d"]["e"])]
    rows += [(f"search{p}{r}", "/".join(map(str, config.IndexConfig().search_defaults(p, r)))) for p, r in ((None, None), (0, 0), (7, 2))]
    return spark.createDataFrame(rows, "name string, value string")


def index_sizes(spark, d):
    """Cells and sub-spaces that the engine chooses, over a range of sizes (V5, V6)."""
    rows = [(n, t, V.resolve_nlist(n, t)) for n in (1, 100, 2_000, 20_000, 1_000_000, 50_000_000) for t in (38, 2_000, 100_000, 4_000_000)]
    return spark.createDataFrame(rows, "n long, train long, nlist long").withColumn("pq_m", F.lit(V.resolve_pq_m(384)).cast("long"))


def load_test(spark, d):
    """Latency and throughput of requests by number of threads, over a table of timings."""
    e = _table(spark, d, "events")
    rows = e.select((F.col("user_id") % THREADS).alias("threads"), F.col("event_id").cast("double").alias("started"), F.when(F.col("event_id") % 11 != 0, F.col("value").cast("double")).alias("ms"))
    return evaluate.load_test(rows)


def generated_questions(spark, d):
    """Sizes of a generated corpus: three questions a document, each with its only relevant one (G1)."""
    docs, asked = generate.corpus(spark, 500)
    n = asked.groupBy(F.get("relevant_doc_ids", F.lit(0)).alias("doc_id")).agg(F.count_distinct("question").alias("questions"))
    return docs.join(n, "doc_id").select("doc_id", "questions", F.contains("text", F.lit("Project PRJ")).alias("named"))


def generated_vectors(spark, d):
    """Norms of generated vectors and of noisy queries made from them."""
    v = generate.vectors(spark, 400, 32)
    norm = lambda c: F.round(V.norm(F.col(c)), 5)
    q = generate.noisy_queries(v, 50).select(F.col("qid").alias("id"), norm("q").alias("query_norm"))
    return v.select("id", F.size("v").cast("long").alias("dim"), norm("v").alias("norm")).join(q, "id", "left")


def generated_rows(spark, d):
    """Sums in six languages: the answer holds the sum."""
    rows = generate.multilingual(spark, 60)
    return rows.select("lang", F.regexp_extract("response", r"(\d+)", 1).cast("long").alias("total")).groupBy("lang").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


def trained_recall(spark, d):
    """Whether search of a trained index, k-means cells and codebooks, finds at least 0.9 of the true neighbours."""
    found, truth = vector.ivfpq_trained_topk(spark, d), knn.exact_topk(vector.rows_of(spark, d), vector.queries(spark, d), vector.K)
    return evaluate.ann_recall(found, truth, vector.K).select((F.col("recall") >= 0.9).alias("enough"))


_REQUEST_SQL = ", ".join(f"('{n}', {v}, {low} <= {v} AND {v} <= {high})" for n, v in _REQUESTS for low, high in [{"top_k": (1, 20), "k": (1, 1000), "nprobe": (1, 4096), "rerank_factor": (0, 64), "batch": (1, 256)}[n]])
_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_P = lambda q: f"round(quantile_cont(ms, {q}), 6) AS p{round(q * 100)}"

QUERIES = {
    "text_files": (text_files, f"SELECT item_id, '.txt' AS suffix, md5(trim(text, {_WS})) AS digest, false AS corrupt FROM benchmark"),
    "docx_parse": (docx_parse, r"SELECT doc_id, length(t) AS chars, md5(t) AS digest, false AS corrupt, true AS half_is_marked FROM (SELECT doc_id, replace(regexp_replace(coalesce(text, ''), '[\x00-\x09\x0B-\x1F]', ' ', 'g'), chr(10), chr(10) || chr(10)) AS t FROM documents)"),
    "jsonl_round_trip": (jsonl_round_trip, "SELECT doc_id AS id, lang AS language, md5(text) AS digest, CAST(NULL AS VARCHAR) AS absent FROM documents"),
    "named_sources": (named_sources, "SELECT kind, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, count(*) AS written FROM documents, (VALUES ('jsonl'), ('parquet'), ('json')) k(kind) GROUP BY kind"),
    "mapped_columns": (mapped_columns, f"SELECT doc_id, {S.lang('la')} AS lang_code, instr, resp FROM (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN coalesce(lang, 'None') ELSE 'None' END AS la, CASE WHEN doc_id % 5 <> 0 THEN coalesce(source, '') ELSE '' END AS instr, md5(coalesce(text, '')) AS resp FROM documents)"),
    "language_filter": (language_filter, f"SELECT * FROM (SELECT doc_id, {S.lang('lang')} AS lang_code FROM documents) WHERE lang_code IN ('deu', 'fra')"),
    "metadata_lines": (metadata_lines, "SELECT event_id AS id, event_type, user_id, CAST(NULL AS VARCHAR) AS own_id FROM events"),
    "eval_set": (eval_set, "SELECT item_id, md5(text) AS question, CAST(2 AS BIGINT) AS n FROM benchmark"),
    "chunk_store": (chunk_store, f"WITH {retrieval._CHUNKS} SELECT row_number() OVER (ORDER BY doc_id, position) - 1 AS chunk_id, doc_id, position, md5(text) AS digest FROM ch"),
    "postings_store": (postings_store, f"WITH {S.BM25} SELECT qid, rank, id, round(score, 6) AS score FROM bm WHERE rank <= 10"),
    "vector_store": (vector_store, f"SELECT vec_id % {SHARDS} AS shard_id, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS first, count(*) AS listed FROM embeddings GROUP BY 1"),
    "shard_subset": (shard_subset, f"SELECT vec_id AS id, vec_id % {SHARDS} AS shard_id FROM embeddings WHERE vec_id % {SHARDS} IN (1, 3)"),
    "delta_store": (delta_store, "SELECT vec_id + 1000000 AS id, round(-CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings"),
    "upsert_live": (upsert_live, "SELECT upserted, count(*) AS n, round(sum(CASE WHEN upserted THEN -x ELSE x END), 4) AS first FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x FROM embeddings), (VALUES (true), (false)) u(upserted) GROUP BY upserted"),
    "metadata_live": (metadata_live, "SELECT user_id AS id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"),
    "ingest_live": (ingest_live, rf"SELECT item_id, CAST(0 AS BIGINT) AS position, md5(trim(regexp_replace(text, '[ \t]+', ' ', 'g'), {_WS})) AS digest FROM benchmark"),
    "latency_windows": (latency_windows, "SELECT CAST(floor(epoch(CAST(ts AS TIMESTAMP)) / 3600) * 3600 AS BIGINT) AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
    "latency_ring": (latency_ring, f"SELECT event_type, count(*) AS n, {_P(0.5)}, {_P(0.95)}, {_P(0.99)} FROM (SELECT event_type, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, value DESC) AS r FROM events) WHERE r <= {LAST} GROUP BY event_type"),
    "answer_stream": (answer_stream, """WITH w AS (SELECT item_id AS qid, string_split(text, ' ') AS x FROM benchmark)
        SELECT qid, CAST(0 AS BIGINT) AS seq, 'sources' AS event, '[{"rank":1,"id":' || qid || '}]' AS data FROM w
        UNION ALL SELECT qid, CAST(p AS BIGINT), 'token', d FROM (SELECT qid, unnest(x) AS d, unnest(range(1, len(x) + 1)) AS p FROM w)
        UNION ALL SELECT qid, len(x) + 1, 'done', '' FROM w"""),
    "truth_cache": (truth_cache, f"WITH {S.VECTORS} SELECT qid, rank, id, round(score, 6) AS score FROM {S.top('s', 10)}"),
    "report_file": (report_file, "SELECT lang, count(*) AS n FROM documents GROUP BY lang"),
    "retrieval_modes": (retrieval_modes, f"WITH {S.BM25} SELECT 'sparse' AS mode, qid, rank, id FROM bm WHERE rank <= 5"),
    "request_limits": (request_limits, f"SELECT name, CAST(value AS BIGINT) AS value, ok FROM (VALUES {_REQUEST_SQL}, ('question', 0, false), ('question', 1, true), ('question', 2000, true), ('question', 2001, false), ('vectorFalsetextFalse', 0, false), ('vectorFalsetextTrue', 0, true), ('vectorTruetextFalse', 3, true), ('vectorTruetextTrue', 3, false), ('vectorTruetextFalse', 2, false), ('vectorTruetextTrue', 2, false)) r(name, value, ok)"),
    "settings": (settings, "SELECT * FROM (VALUES ('a.x', '3.5'), ('a.y', '2'), ('a.z', '7'), ('b', 'True'), ('c.d.e', 'word'), ('searchNoneNone', '24/4'), ('search00', '24/0'), ('search72', '7/2')) r(name, value)"),
    "index_sizes": (index_sizes, "SELECT n, train, CAST(greatest(1, least(pow(2, greatest(4, round_even(log2(greatest(2.0, 4 * sqrt(n))), 0))), train // 39)) AS BIGINT) AS nlist, CAST(48 AS BIGINT) AS pq_m FROM (SELECT CAST(a AS BIGINT) AS n, CAST(b AS BIGINT) AS train FROM (VALUES (1), (100), (2000), (20000), (1000000), (50000000)) x(a), (VALUES (38), (2000), (100000), (4000000)) y(b))"),
    "load_test": (load_test, f"SELECT threads, count(ms) AS n, count(*) - count(ms) AS errors, round(count(ms) * 1000.0::DOUBLE / (max(started + ms) - min(started) FILTER (ms IS NOT NULL)), 6) AS qps, {_P(0.5)}, {_P(0.95)}, {_P(0.99)} FROM (SELECT user_id % {THREADS} AS threads, CAST(event_id AS DOUBLE) AS started, CASE WHEN event_id % 11 <> 0 THEN CAST(value AS DOUBLE) END AS ms FROM events) GROUP BY threads"),
    "generated_questions": (generated_questions, "SELECT 'brief_' || range || '.md' AS doc_id, CAST(3 AS BIGINT) AS questions, true AS named FROM range(500)"),
    "generated_vectors": (generated_vectors, "SELECT range AS id, CAST(32 AS BIGINT) AS dim, 1.0::DOUBLE AS norm, CASE WHEN range % 50 = 0 THEN 1.0::DOUBLE END AS query_norm FROM range(400)"),
    "generated_rows": (generated_rows, "SELECT lang, CAST(60 AS BIGINT) AS n, CAST(sum(i % 37 + i + 3) AS BIGINT) AS total FROM (VALUES ('deu'), ('eng'), ('fra'), ('hin'), ('spa'), ('tel')) l(lang), range(60) r(i) GROUP BY lang"),
    "trained_recall": (trained_recall, "SELECT true AS enough"),
}
