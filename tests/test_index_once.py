"""an index reads and tokenises its texts once, and postings of common terms do not move to meet their frequency."""

import pytest
from pyspark.sql import functions as F

from sparkseek.operators import bm25
from sparkseek.sources import store

TEXTS = [(1, "red red fox"), (2, "the fox"), (3, None), (4, ""), (5, "the of"), (6, "Blue fox # blue"), (7, "hapax"), (2, "fox fox red")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


@pytest.mark.parametrize("common", [1, 4, 500_000])
def test_index_as_postings_and_statistics(docs, monkeypatch, common):
    monkeypatch.setattr(bm25, "COMMON_TERMS", common)
    posted, stats = bm25.indexed(docs, "doc_id", "text")
    assert stats.collect() == bm25.corpus_stats(docs, "doc_id", "text").collect()
    want = bm25.postings(docs, "doc_id", "text")
    want = want.join(bm25.document_frequency(want), "term")
    key = lambda df: sorted(map(tuple, df.select("id", "term", "tf", "df").collect()))
    assert key(posted) == key(want) and len(key(posted)) == 7


def test_texts_are_tokenised_once(spark, docs, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    store.write_postings(docs.select(F.col("doc_id").alias("chunk_id"), "text").mapInArrow(count, "chunk_id long, text string"), str(tmp_path))
    assert seen.value == len(TEXTS)


def test_no_text_at_all(docs):
    posted, stats = bm25.indexed(docs.limit(0), "doc_id", "text")
    assert posted.count() == 0 and [tuple(r) for r in stats.collect()] == [(0, 1.0)]
