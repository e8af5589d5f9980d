"""Limits and verdicts against plain quantiles."""

import math
from collections import defaultdict

import pytest
from tessera.llm import kneser_ney as K


def cell(perplexity):
    return math.ceil(math.log(perplexity) * K.CELLS - 1e-9)


def middle(cells):
    return sorted(cells)[math.ceil(len(cells) / 2) - 1]


def limits(cells, quantile, prior):
    """The least cell up to which a language's documents and ``prior`` documents like all languages' make up the quantile."""
    pool = [x - middle(own) for own in cells.values() for x in own]
    out = {}
    for lang, own in cells.items():
        weight = [(x, 1.0) for x in own] + [(middle(own) + x, prior / len(pool)) for x in pool if prior]
        upto, every = 0.0, sum(w for _, w in weight)
        for x, w in sorted(weight):
            upto += w
            if upto >= quantile * every - 1e-6:
                out[lang] = x
                break
    return out


def check(df, ids, trusted, quantile, prior):
    rows = K.classify(df, ids, quantile=quantile, prior=prior).collect()
    assert len(rows) == df.count()
    cells = defaultdict(list)
    for r in rows:
        if r.doc_id in trusted and r.perplexity is not None:
            cells[r.lang or ""].append(cell(r.perplexity))
    want = limits(cells, quantile, prior)
    for r in rows:
        own = want.get(r.lang or "")
        assert (r.threshold is None) == (own is None)
        if own is not None:
            assert r.threshold == pytest.approx(math.exp(own / K.CELLS))
        assert r.kept == (own is None or r.perplexity is None or cell(r.perplexity) <= own)
    return {x: len(v) for x, v in cells.items()}


def test_limits_and_verdicts(spark, documents, odd, none):
    ids = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").select("doc_id")
    trusted = {r.doc_id for r in ids.collect()}
    check(documents, ids, trusted, 0.9, 0)
    sizes = check(documents, ids, trusted, 0.937, K.PRIOR)
    assert len(sizes) > 1 and min(sizes.values()) < K.PRIOR
    check(odd, ids, trusted, 0.937, 7)
    assert all(r.kept for r in K.classify(odd, ids.where("doc_id < 0")).collect())
    assert K.classify(none, ids).count() == 0


def test_junk_is_less_likely_than_prose(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = K.classify(docs, labels.where("quality = 1").select("doc_id")).join(labels, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in found.groupBy("quality", "kept").count().collect()}
    assert n[0, False] > 0.8 * (n[0, False] + n.get((0, True), 0))
    assert n[1, True] > 0.98 * (n[1, True] + n.get((1, False), 0))
