"""Queries over embeddings: exact search, shards, deltas, IVF-PQ, recall."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkseek.functions import config
from sparkseek.functions import vectors as V
from sparkseek.operators import evaluate, ivfpq, knn
from sparkseek.plans import _sql as S
from sparkseek.session import spread, written
from sparkseek.sources import store

K, SHARDS, EVERY, PQ_M, DIM = 10, 4, 50, 8, 64
LEAST = 0.3
NPROBE, RERANK = 24, 16


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def rows_of(spark, d):
    """Vectors for a search: dealt over all cores where the table has few files."""
    return spread(vectors(spark, d))


def queries(spark, d):
    return vectors(spark, d).filter(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), F.col("v").alias("q"))


def _hits(df):
    return df.select("qid", "rank", "id", F.round("score", 6).alias("score"))


def vector_normalize(spark, d):
    n = vectors(spark, d).select("id", V.normalize(F.col("v")).alias("v"))
    return n.select("id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("v")), 6).alias("norm"))


def exact_knn_topk(spark, d):
    return _hits(knn.exact_topk(rows_of(spark, d), queries(spark, d), K))


def knn_padded(spark, d):
    """Hits from a score on only, padded to K ranks a query."""
    q = queries(spark, d)
    near = knn.exact_topk(rows_of(spark, d), q, K).filter(F.col("score") >= LEAST)
    return knn.pad(near, q, K).select("qid", "rank", "id", F.when(F.col("id") < 0, None).otherwise(F.round("score", 6)).alias("score"))


def shard_sizes(spark, d):
    return vectors(spark, d).groupBy(V.shard_of(F.col("id"), SHARDS).cast("long").alias("shard_id")).agg(F.count("*").alias("n"))


def sharded_topk_merge(spark, d):
    return _hits(knn.merge(knn.sharded_topk(rows_of(spark, d), queries(spark, d), K, SHARDS), K))


def two_node_merge(spark, d):
    v, q = rows_of(spark, d), queries(spark, d)
    halves = [knn.merge(knn.sharded_topk(v, q, K, SHARDS, only), K) for only in ([0, 1], [2, 3])]
    return _hits(knn.merge(halves[0].unionByName(halves[1]), K))


def gateway_degraded_merge(spark, d):
    hits = knn.sharded_topk(rows_of(spark, d), queries(spark, d), K, SHARDS).withColumnRenamed("shard_id", "node")
    status = spark.range(SHARDS).select(F.col("id").alias("node"), (F.col("id") != 2).alias("ok"))
    m = knn.merge_nodes(hits, status, K)
    return m.select("qid", F.col("merged_rank").alias("rank"), "id", "score", "nodes_ok", "nodes_total", "degraded")


def _delta(spark, d):
    """Upserts beyond the built index: all rows come again with their vector turned round, twice, the later as is."""
    n = 1_000_000
    rows = vectors(spark, d).withColumn("id", F.col("id") + n)
    first = rows.select("id", F.transform("v", lambda x: -x).alias("v"), F.lit(1).alias("seq"))
    return knn.upsert_delta(rows.limit(0), first.unionByName(rows.select("id", "v", F.lit(2).alias("seq"))))


def delta_search(spark, d):
    both = rows_of(spark, d).select("id", "v").unionByName(_delta(spark, d))
    return _hits(knn.exact_topk(both, queries(spark, d), K))


def delta_upsert_replace(spark, d):
    """All rows are in the delta; vectors come again turned round, under the same id for even labels, else under a new one."""
    rows = vectors(spark, d)
    id = F.when(F.col("label") % 2 == 0, F.col("id")).otherwise(F.col("id") + 1_000_000)
    new = rows.select(id.alias("id"), F.reverse("v").alias("v"), F.lit(1).alias("seq"))
    return knn.upsert_delta(rows.select("id", "v"), new).select("id", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first"))


def upsert_id_check(spark, d):
    new = vectors(spark, d).select((F.col("id") * 2).alias("id"))
    return knn.checked_upserts(new, 400).select("id", "ok")


def _centroids(spark, d):
    """One centroid a label, the mean of its unit vectors by position: deterministic, so SQL can state it."""
    parts = vectors(spark, d).select("label", F.posexplode(V.normalize(F.col("v"))).alias("p", "x")).groupBy("label", "p").agg(F.round(F.avg("x"), 9).alias("x"))
    c = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda y: y.x).alias("c"))
    return written(c.select(F.col("label").cast("long").alias("cell_id"), "c"))


def coarse_assign(spark, d):
    return ivfpq.assign_cells(rows_of(spark, d), _centroids(spark, d)).select("id", "cell_id")


def _cells(spark, d, nprobe):
    """Vectors with their cell, and the cells that each query probes; both written, since counts and searches read them."""
    cells = _centroids(spark, d)
    rows = written(ivfpq.assign_cells(rows_of(spark, d), cells).select("cell_id", "id", "v"))
    return rows, written(ivfpq.probe_cells(queries(spark, d), cells, nprobe, "qid", "q"))


def _probed(spark, d, nprobe):
    rows, probes = _cells(spark, d, nprobe)
    return ivfpq.cell_search(rows, probes, queries(spark, d), K)


def ivf_probe_topk(spark, d):
    return _hits(knn.merge(_probed(spark, d, 3), K))


def _books(spark, d):
    """Codewords: the sub-vectors of every label's mean over the whole table, numbered in order of labels."""
    code = F.row_number().over(Window.orderBy("cell_id")).cast("long") - 1  # one row a label
    rows = _centroids(spark, d).select(code.alias("code"), "c")
    width = DIM // PQ_M
    return rows.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PQ_M - 1).cast("long"))).alias("sub"), "code", "c").select("sub", "code", F.slice("c", (F.col("sub") * width + 1).cast("int"), F.lit(width)).alias("w"))


def pq_encode(spark, d):
    return ivfpq.pq_encode(rows_of(spark, d), _books(spark, d), PQ_M, DIM).select("id", F.array_join(F.col("codes").cast("array<string>"), ",").alias("codes"))


def _pq(spark, d):
    cells = _centroids(spark, d)
    index = ivfpq.pq_encode(ivfpq.assign_cells(rows_of(spark, d), cells), _books(spark, d), PQ_M, DIM)
    return index, ivfpq.probe_cells(queries(spark, d), cells, 3, "qid", "q")


def pq_adc_scan(spark, d):
    index, probes = _pq(spark, d)
    scan = ivfpq.adc_scan(index, probes, queries(spark, d), _books(spark, d), PQ_M, DIM)
    return scan.select("qid", "id", F.round("d", 6).alias("d"))


def ivfpq_rerank(spark, d):
    index, probes = _pq(spark, d)
    return _hits(ivfpq.search(index, probes, queries(spark, d), _books(spark, d), PQ_M, DIM, K, 4))


def ann_recall_at_k(spark, d):
    return evaluate.ann_recall(knn.merge(_probed(spark, d, 3), K), knn.exact_topk(rows_of(spark, d), queries(spark, d), K), K)


def nprobe_sweep(spark, d):
    """Recall and rows scanned for each number of probed cells: one scan, a cut on the cell's rank for each.

    The scan leaves the best of each query and cell; how many rows it saw follows from the sizes of the cells.
    """
    truth = written(knn.exact_topk(rows_of(spark, d), queries(spark, d), K).select("qid", "id"))
    held, probes = _cells(spark, d, 8)
    scored = written(ivfpq.cell_search(held, probes, queries(spark, d), K))
    sweep = spark.createDataFrame([(1,), (2,), (4,), (8,)], "nprobe long")
    sizes = held.groupBy("cell_id").agg(F.count("*").alias("n"))
    asked = probes.groupBy("cell_id", "cell_rank").agg(F.count("*").alias("asked")).join(sizes, "cell_id")
    cost = asked.join(F.broadcast(sweep), F.col("cell_rank") <= F.col("nprobe")).groupBy("nprobe").agg(F.sum(F.col("asked") * F.col("n")).alias("scanned"))
    rows = scored.join(F.broadcast(sweep), F.col("cell_rank") <= F.col("nprobe"))
    found = knn.top_k(rows.withColumn("qid", F.struct("nprobe", "qid")), K).select("qid.nprobe", "qid.qid", "id")
    hits = found.join(truth, ["qid", "id"]).groupBy("nprobe").agg(F.count("*").alias("hits"))
    n = truth.select("qid").distinct().agg((F.count("*") * K).alias("n"))
    return cost.join(hits, "nprobe").crossJoin(F.broadcast(n)).select("nprobe", "scanned", F.round(F.col("hits") / F.col("n"), 6).alias("recall"))


def operating_point(spark, d):
    """Best recall within a cost budget; the cost stands for a latency, so that the result does not depend on a clock."""
    points = nprobe_sweep(spark, d).select("nprobe", "recall", F.col("scanned").alias("p99"), F.col("nprobe").alias("sweep_pos"))
    n = queries(spark, d).count() * vectors(spark, d).count()
    return evaluate.operating_point(points, 0.5 * n).select("nprobe", "recall")


def ivfpq_sweep(spark, d):
    cells = _centroids(spark, d)
    index = ivfpq.pq_encode(ivfpq.assign_cells(rows_of(spark, d), cells), _books(spark, d), PQ_M, DIM)
    truth = knn.exact_topk(rows_of(spark, d), queries(spark, d), K)
    return ivfpq.sweep(index, cells, queries(spark, d), _books(spark, d), truth, PQ_M, DIM, K, [1, 3], [0, 4])


def _trained(spark, d):
    """Cells and codebooks by k-means with the engine's settings, and the codes of all vectors."""
    rows, cfg = rows_of(spark, d), config.IndexConfig(dim=DIM)
    n = rows.count()
    cells = written(ivfpq.train_coarse(rows, V.resolve_nlist(n, min(n, 100_000), cfg.nlist)))
    m = V.resolve_pq_m(cfg.dim, cfg.pq_m)
    books = written(ivfpq.train_codebooks(rows, m, cfg.pq_bits))
    return cells, books, written(ivfpq.pq_encode(ivfpq.assign_cells(rows, cells), books, m, DIM)), m


def ivfpq_trained_topk(spark, d, nprobe=NPROBE, rerank=RERANK):
    """Search of the trained index; k-means has no SQL, so the tests hold it against brute force.

    ``nprobe`` and ``rerank`` are what the search begins with: both are raised until a sample of the queries has its recall.
    """
    cells, books, index, m = _trained(spark, d)
    q, units = queries(spark, d), ivfpq.in_units(index)
    nprobe, rerank = ivfpq.tuned(units, q, cells, books, m, K, nprobe, rerank)
    return _hits(ivfpq.unit_search(units, q, cells, books, m, K, nprobe, rerank))


def index_stats(spark, d):
    return store.index_stats(vectors(spark, d), _delta(spark, d), SHARDS)


_CENT = f"""{S.VECTORS}, cp AS (SELECT label, p, round(avg(x), 9) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(0, len(v))) AS p FROM v) GROUP BY label, p),
    ce AS (SELECT CAST(label AS BIGINT) AS cell_id, list(x ORDER BY p) AS c FROM cp GROUP BY label),
    cd AS (SELECT id, cell_id, round(list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))), 9) AS dd FROM v, ce),
    ca AS (SELECT id, cell_id FROM cd QUALIFY row_number() OVER (PARTITION BY id ORDER BY dd, cell_id) = 1),
    pr AS (SELECT id AS qid, cell_id, row_number() OVER (PARTITION BY id ORDER BY dd, cell_id) AS cell_rank FROM cd WHERE id % {EVERY} = 0),
    px AS (SELECT s.qid, s.id, cell_rank, score FROM s JOIN ca USING (id) JOIN pr ON pr.qid = s.qid AND pr.cell_id = ca.cell_id)"""
_W = DIM // PQ_M
_PQ = f"""{_CENT}, bk AS (SELECT sub, code, list_slice(c, sub * {_W} + 1, sub * {_W} + {_W}) AS w FROM (SELECT row_number() OVER (ORDER BY cell_id) - 1 AS code, c FROM ce), range(0, {PQ_M}) r(sub)),
    sv AS (SELECT id, sub, list_slice(v, sub * {_W} + 1, sub * {_W} + {_W}) AS x FROM v, range(0, {PQ_M}) r(sub)),
    sd AS (SELECT id, sub, code, round(list_sum(list_transform(range(1, {_W + 1}), lambda i: (x[i] - w[i]) * (x[i] - w[i]))), 9) AS dd, list_sum(list_transform(range(1, {_W + 1}), lambda i: (x[i] - w[i]) * (x[i] - w[i]))) AS raw FROM sv JOIN bk USING (sub)),
    co AS (SELECT id, sub, code FROM sd QUALIFY row_number() OVER (PARTITION BY id, sub ORDER BY dd, code) = 1),
    ad AS (SELECT px.qid, px.id, round(sum(sd.raw), 9) AS d FROM px JOIN co ON co.id = px.id JOIN sd ON sd.id = px.qid AND sd.sub = co.sub AND sd.code = co.code WHERE cell_rank <= 3 GROUP BY px.qid, px.id)"""
_SH = f"{S.VECTORS}, sh AS (SELECT *, id % {SHARDS} AS shard_id, row_number() OVER (PARTITION BY qid, id % {SHARDS} ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= {K})"
_DELTA = "SELECT vec_id + 1000000 AS id, CAST(embedding AS DOUBLE[]) AS r FROM embeddings"
_TOP = "SELECT qid, rank, id, round(score, 6) AS score FROM "
_GRID = f"""{_PQ}, tr AS (SELECT qid, id FROM {S.top("s", K)}), gr AS (SELECT * FROM (VALUES (0), (4)) a(rerank), (VALUES (1), (3)) b(nprobe)),
    sc AS (SELECT rerank, nprobe, ad.qid, ad.id, d FROM ad JOIN px USING (qid, id) JOIN gr ON cell_rank <= nprobe),
    ct AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY rerank, nprobe, qid ORDER BY d, id) <= greatest(1, rerank) * {K}),
    fi AS (SELECT rerank, nprobe, ct.qid, ct.id FROM ct JOIN s USING (qid, id) QUALIFY row_number() OVER (PARTITION BY rerank, nprobe, ct.qid ORDER BY CASE WHEN rerank > 0 THEN score ELSE -d END DESC, ct.id) <= {K}),
    rc AS (SELECT rerank, nprobe, count(*) AS hits FROM fi JOIN tr USING (qid, id) GROUP BY ALL)"""
_SWEEP = f"""{_CENT}, tr AS (SELECT qid, id FROM {S.top("s", K)}), sw(nprobe) AS (VALUES (1), (2), (4), (8)),
    pp AS (SELECT nprobe, px.* FROM px JOIN sw ON cell_rank <= nprobe), fo AS (SELECT nprobe, qid, id FROM {S.top("pp", K, "nprobe, qid")}),
    sp AS (SELECT CAST(nprobe AS BIGINT) AS nprobe, (SELECT count(*) FROM pp p2 WHERE p2.nprobe = fo.nprobe) AS scanned, round(count(*) / (SELECT count(DISTINCT qid) * {K} FROM s)::DOUBLE, 6) AS recall FROM fo JOIN tr USING (qid, id) GROUP BY nprobe)"""

QUERIES = {
    "vector_normalize": (vector_normalize, f"WITH {S.VECTORS} SELECT id, round(v[1], 6) AS first, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM v"),
    "exact_knn_topk": (exact_knn_topk, f"WITH {S.VECTORS} {_TOP}{S.top('s', K)}"),
    "knn_padded": (knn_padded, f"WITH {S.VECTORS}, t AS (SELECT * FROM {S.top('s', K)} WHERE score >= {LEAST}) SELECT qv.qid, r AS rank, coalesce(t.id, -1) AS id, round(t.score, 6) AS score FROM qv CROSS JOIN range(1, {K + 1}) g(r) LEFT JOIN t ON t.qid = qv.qid AND t.rank = r"),
    "shard_sizes": (shard_sizes, f"SELECT vec_id % {SHARDS} AS shard_id, count(*) AS n FROM embeddings GROUP BY ALL"),
    "sharded_topk_merge": (sharded_topk_merge, f"WITH {_SH} {_TOP}{S.top('(SELECT qid, id, score FROM sh)', K)}"),
    "two_node_merge": (two_node_merge, f"WITH {S.VECTORS} {_TOP}{S.top('s', K)}"),
    "gateway_degraded_merge": (gateway_degraded_merge, f"WITH {_SH}, nd AS (SELECT qid, id, shard_id AS node, rank AS nr, round_even(score, 5) AS score FROM sh WHERE shard_id <> 2) SELECT qid, rank, id, score, CAST(3 AS BIGINT) AS nodes_ok, CAST(4 AS BIGINT) AS nodes_total, true AS degraded FROM {S.top('nd', K, 'qid', 'score DESC, node, nr')}"),
    "delta_search": (delta_search, f"WITH {S.VECTORS}, dl AS ({_DELTA}), al AS (SELECT id, v FROM v UNION ALL SELECT id, list_transform(r, lambda x: x / sqrt(list_inner_product(r, r))) FROM dl), s2 AS (SELECT qid, id, round(list_inner_product(q, v), 9) AS score FROM qv, al) {_TOP}{S.top('s2', K)}"),
    "delta_upsert_replace": (delta_upsert_replace, "SELECT vec_id AS id, round(CAST(CASE WHEN label % 2 = 0 THEN embedding[len(embedding)] ELSE embedding[1] END AS DOUBLE), 6) AS first FROM embeddings UNION ALL SELECT vec_id + 1000000, round(CAST(embedding[len(embedding)] AS DOUBLE), 6) FROM embeddings WHERE label % 2 <> 0"),
    "upsert_id_check": (upsert_id_check, "SELECT vec_id * 2 AS id, vec_id * 2 >= 400 AS ok FROM embeddings"),
    "coarse_assign": (coarse_assign, f"WITH {_CENT} SELECT id, cell_id FROM ca"),
    "ivf_probe_topk": (ivf_probe_topk, f"WITH {_CENT} {_TOP}{S.top('(SELECT * FROM px WHERE cell_rank <= 3)', K)}"),
    "pq_encode": (pq_encode, f"WITH {_PQ} SELECT id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY sub) AS codes FROM co GROUP BY id"),
    "pq_adc_scan": (pq_adc_scan, f"WITH {_PQ} SELECT qid, id, round(d, 6) AS d FROM ad"),
    "ivfpq_rerank": (ivfpq_rerank, f"WITH {_PQ}, c4 AS (SELECT qid, id FROM {S.top('(SELECT qid, id, 1.0 - d / 2.0 AS score FROM ad)', 4 * K)}), r4 AS (SELECT s.* FROM s JOIN c4 USING (qid, id)) {_TOP}{S.top('r4', K)}"),
    "ann_recall_at_k": (ann_recall_at_k, f"WITH {_CENT}, tr AS (SELECT qid, id FROM {S.top('s', K)}), fo AS (SELECT qid, id FROM {S.top('(SELECT * FROM px WHERE cell_rank <= 3)', K)}) SELECT round(count(*) / (SELECT count(DISTINCT qid) * {K} FROM tr)::DOUBLE, 6) AS recall FROM tr JOIN fo USING (qid, id)"),
    "nprobe_sweep": (nprobe_sweep, f"WITH {_SWEEP} SELECT * FROM sp"),
    "operating_point": (operating_point, f"WITH {_SWEEP} SELECT nprobe, recall FROM sp WHERE scanned <= 0.5 * (SELECT count(*) FROM s) ORDER BY recall DESC, nprobe LIMIT 1"),
    "ivfpq_sweep": (ivfpq_sweep, f"WITH {_GRID} SELECT CAST(g.rerank AS BIGINT) AS rerank, CAST(g.nprobe AS BIGINT) AS nprobe, count(*) AS scanned, round(coalesce(any_value(rc.hits), 0) / (SELECT count(DISTINCT qid) * {K} FROM tr)::DOUBLE, 6) AS recall FROM sc g LEFT JOIN rc ON rc.rerank = g.rerank AND rc.nprobe = g.nprobe GROUP BY g.rerank, g.nprobe"),
    "ivfpq_trained_topk": (ivfpq_trained_topk, None),
    "index_stats": (index_stats, f"SELECT vec_id % {SHARDS} AS shard_id, count(*) AS n, 'shard' AS kind FROM embeddings GROUP BY ALL UNION ALL SELECT -1, count(*), 'delta' FROM embeddings"),
}
