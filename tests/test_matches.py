"""rankings by terms against the joins that they replace; texts are tokenised once for both."""

import pytest

from sparkseek.functions import text as T
from sparkseek.operators import bm25, matches, tiles
from sparkseek.plans import retrieval

DOCS = [(1, "red red fox"), (2, "the fox owl dog red"), (3, None), (4, ""), (5, "the of"), (6, "Blue fox blue"), (7, "dog"), (2, "fox fox red cat"), (9, "red fox"), (8, "red fox")]
ASKED = [(1, "fox"), (2, "red blue red"), (3, ""), (4, None), (5, "absent"), (6, "the dog"), (7, "Fox RED cat")]


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ASKED, "qid long, question string")


def rows(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("cells,slice_,block", [(1 << 20, 1024, 16_384), (7, 3, 2)])
def test_as_joins(tables, monkeypatch, cells, slice_, block):
    monkeypatch.setattr(matches, "CELLS", cells)
    monkeypatch.setattr(tiles, "ROWS", slice_)
    monkeypatch.setattr(matches.knn, "QUERY_BLOCK", block)
    docs, asked = tables
    assert rows(bm25.search(docs, asked, 3)) == rows(bm25._joined_search(docs, asked, 3, "doc_id", "text"))


def test_cosine_of_token_sets(tables):
    docs, asked = tables
    once = docs.filter("doc_id != 2")
    sets = {r.doc_id: set(r.t) for r in once.select("doc_id", T.tokens("text").alias("t")).collect()}
    want = []
    for q, text in ASKED:
        t = {w for w in (text or "").lower().split() if w != "the"}
        scored = sorted((-round(len(t & s) / (len(t) ** 0.5 * len(s) ** 0.5), 9), i) for i, s in sets.items() if t & s)[:4]
        want += [(q, n, i, round(-s, 8)) for n, (s, i) in enumerate(scored, 1)]
    assert rows(retrieval.lexical_ranker(once, asked, 4)) == sorted(want)


def test_both_rankers_tokenise_texts_once(spark, tables):
    docs, asked = tables
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    found = retrieval._found(docs.mapInArrow(count, docs.schema), asked)
    assert retrieval.lexical_ranker(docs, asked, 3, found).count() and bm25.search(docs, asked, 3, found=found).count()
    assert seen.value == len(DOCS)


def test_no_documents(tables):
    docs, asked = tables
    assert bm25.search(docs.limit(0), asked, 3).count() == 0 and bm25.search(docs, asked.limit(0), 3).count() == 0
