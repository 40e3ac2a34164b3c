"""Recall of the trained IVF-PQ search against brute force."""

from sparkseek.plans import vector


def test_recall_of_the_trained_index(spark):
    d = "/root/testdata/sf0.1"
    pairs = lambda df: {(r.qid, r.id) for r in df.collect()}
    want, got = pairs(vector.exact_knn_topk(spark, d)), pairs(vector.ivfpq_trained_topk(spark, d))
    recall = len(want & got) / len(want)
    print("recall", recall, "without training", len(want & pairs(vector.ivfpq_rerank(spark, d))) / len(want), "cells only", len(want & pairs(vector.ivf_probe_topk(spark, d))) / len(want))
    assert recall >= 0.9
