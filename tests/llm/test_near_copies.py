"""Near copies of the pipeline stage against brute force over all pairs."""

import random

import corpus_pipeline
import pytest

from sparkseek.llm import near_copies


def brute(texts):
    """Least index reachable over five-word Jaccard similarity >= 0.8."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            union = len(sets[a] | sets[b])
            if 5 * len(sets[a] & sets[b]) >= 4 * union:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return root


def edited():
    """Families of one text with 0 to 9 words replaced: similarities on both sides of 0.8."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [None, "", "one two", "One  TWO", "one two three"]
    for size in (12, 60, 150, 150):
        base = [word() for _ in range(size)]
        for edits in (0, 0, 1, 2, 3, 4, 5, 7, 9):
            copy = list(base)
            for at in rng.sample(range(size), edits):
                copy[at] = word()
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("chunk", [near_copies.CHUNK, 3])
def test_near_copies_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    texts = edited()
    frame = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    got = {r["_row"]: r.component for r in near_copies.near_copies(frame, "_row").collect()}
    least = {}
    for i in range(len(texts)):
        least.setdefault(got[i], i)
    assert [least[got[i]] for i in range(len(texts))] == brute(texts)
    assert near_copies.near_copies(frame.limit(0), "_row").count() == 0


def test_stage_drops_edited_copies(spark):
    texts = edited()
    frame = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(texts)))
