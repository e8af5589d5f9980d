"""Which documents op4 trusts, and what it sets its limits by."""

from tessera.llm import kneser_ney as K
from tessera.llm import queries as Q
from tessera.llm import word_grams as W


def test_toxic_documents_are_not_trusted(spark, tmp_path):
    kinds = [(1, 0), (1, 1), (1, None), (0, 0), (None, 0)]
    labels = [(10 * k + i, *kind) for k, kind in enumerate(kinds) for i in range(10)]
    docs = [(d, "the cat sat on the mat", f"l{d // 10}") for d, _, _ in labels]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in Q.trusted_ids(spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()} == set(range(10))
    assert {r.lang for r in Q.op4_perplexity(spark, str(tmp_path)).collect() if r.threshold is not None} == {"l0"}


def test_one_odd_document_does_not_set_the_limit_of_a_small_language(spark):
    good = ["the cat sat on the mat", "the dog sat on the mat", "the cat ran to the mat", "the dog ran to the cat"]
    rows = [(i, good[i // 7 % 4], "en") for i in range(300)] + [(1000 + i, good[i // 7 % 4], "es") for i in range(30)]
    rows += [(2000, "zq xj vv kk pp ww", "es"), (2001, "qq jx uu hh mm ll", "es")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in K.classify(docs, docs.where("doc_id < 2001").select("doc_id")).collect()}
    assert not found[2001].kept and not found[2000].kept and sum(found[1000 + i].kept for i in range(30)) >= 27
    assert K.PRIOR * (1 - K.QUANTILE) >= 1.999


def test_unseen_words_alone_in_a_language_that_has_trusted_text(spark):
    rows = [(i, "abc abd abc", "en") for i in range(10)] + [(99, "zzzz", "en"), (100, "zzzz", "xx")]
    one = lambda r: spark.createDataFrame(r, "doc_id long, text string, lang string").coalesce(1)
    docs = one(rows[:10]).unionByName(one(rows[10:11])).unionByName(one(rows[11:]))                 # each in a group of its own
    found = {r.doc_id: r.nll for r in W.perplexities(docs, docs.where("doc_id < 10").select("doc_id"), chunk_bytes=1).collect()}
    assert found[99] > 0 and found[100] is None
