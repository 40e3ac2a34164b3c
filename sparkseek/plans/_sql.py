"""Pieces of DuckDB SQL that several queries share."""

from sparkseek.functions.text import LANGUAGES, STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))


def toks(col: str) -> str:
    return rf"list_filter(regexp_extract_all(lower(coalesce({col}, '')), '[\p{{L}}\p{{N}}_]+'), lambda t: t NOT IN ({STOPS}))"


def all_toks(col: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({col}, '')), '[\p{{L}}\p{{N}}_]+')"


def sents(col: str) -> str:
    return rf"string_split_regex(regexp_replace({col}, '([.!?])\s+', '\1' || chr(30), 'g'), '\x1e|\n+')"


def lang(col: str) -> str:
    pairs = "".join(f" WHEN '{short}' THEN '{code}' WHEN '{name}' THEN '{code}'" for code, short, name in LANGUAGES)
    return f"CASE trim(lower({col})){pairs} ELSE trim(lower({col})) END"


POSTINGS = f"""d AS (SELECT doc_id AS id, text, {toks("text")} AS tk FROM documents),
    st AS (SELECT count(*) AS n, avg(len(tk)) AS al FROM d),
    po AS (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT id, len(tk) AS dl, unnest(tk) AS term FROM d) GROUP BY id, term),
    df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
    w AS (SELECT id, term, tf, df, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))) AS weight
        FROM po JOIN df USING (term), st)"""
QUESTIONS = f"q AS (SELECT item_id AS qid, text AS question, list_distinct({toks('text')}) AS qt FROM benchmark)"
BM25 = f"""{POSTINGS}, {QUESTIONS},
    bs AS (SELECT qid, id, round(sum(weight), 9) AS score FROM (SELECT qid, unnest(qt) AS term FROM q) JOIN w USING (term) GROUP BY qid, id),
    bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bs) WHERE rank <= 50)"""
#: A second ranker that SQL can state: cosine of the token sets.
LEXICAL = f"""dset AS (SELECT doc_id AS id, list_distinct({toks("text")}) AS s FROM documents),
    ls AS (SELECT qid, id, round(len(list_intersect(qt, s)) / (sqrt(len(qt)::DOUBLE) * sqrt(len(s)::DOUBLE)), 9) AS score FROM q, dset WHERE len(qt) > 0 AND len(s) > 0),
    lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM ls WHERE score > 0) WHERE rank <= 50)"""
FUSED = f"""{BM25}, {LEXICAL},
    fu AS (SELECT qid, id, lx.rank AS dense_rank, bm.rank AS sparse_rank, coalesce(1.0::DOUBLE / (60 + lx.rank), 0) + coalesce(1.0::DOUBLE / (60 + bm.rank), 0) AS score
        FROM lx FULL JOIN bm USING (qid, id)),
    fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS fused_rank FROM fu)"""
VECTORS = """e0 AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS r FROM embeddings),
    e1 AS (SELECT *, sqrt(list_inner_product(r, r)) AS nn FROM e0),
    v AS (SELECT id, label, list_transform(r, lambda x: x / CASE WHEN nn = 0 THEN 1 ELSE nn END) AS v FROM e1),
    qv AS (SELECT id AS qid, v AS q FROM v WHERE id % 50 = 0),
    s AS (SELECT qid, id, round(list_inner_product(q, v), 9) AS score FROM qv, v)"""


def top(source: str, k: int, by: str = "qid", order: str = "score DESC, id") -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rank FROM {source} QUALIFY rank <= {k})"
