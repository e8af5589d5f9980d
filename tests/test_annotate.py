"""Prompt building blocks and annotation mechanics."""

import csv
import io

import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import annotate as A


def test_features_text_in_order(spark):
    defs = spark.createDataFrame([("tone", 1, "tone_B", "second", "0-3"), ("tone", 0, "tone_A", "first", "0-1")],
                                 "category string, pos int, feature_id string, short_description string, rating string")
    got = A.features_text(defs).first()["features_text"]
    assert got == "featureid: 'tone_A'\nfirst\n0-1\n------\nfeatureid: 'tone_B'\nsecond\n0-3\n------\n"


def test_examples_text_row_order_and_match_by_name(spark):
    comp = spark.createDataFrame([(2, 0, "tone", "c", "d"), (1, 1, "tone", "a", "b"), (1, 0, "purpose", "x", "y")],
                                 "pair_id int, pos int, category string, post1 string, post2 string")
    cats = spark.createDataFrame([("tone",)], "category string")
    got = A.examples_text(comp, cats).collect()
    assert len(got) == 1 and got[0]["examples"] == "a\n------\nb\n------\nc\n------\nd\n------\n"


def test_ranked_list_text_ties_by_name(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "category string")
    r = A.ranked_list_text(df).first()
    assert r["terms"] == "['c', 'a', 'b']" and r["n_terms"] == 3


def test_csv_text_parses_back_like_pandas(spark):
    rows = [(0, "plain", 'has "quotes"', "a, b"), (1, "multi\nline", "x", "y")]
    df = spark.createDataFrame(rows, "o int, a string, b string, c string")
    text = A.csv_text(df, ["a", "b", "c"], "o").first()["csv"]
    parsed = list(csv.reader(io.StringIO(text)))
    assert parsed == [["a", "b", "c"], ["plain", 'has "quotes"', "a, b"], ["multi\nline", "x", "y"]]


def test_work_list_is_map_side(spark):
    posts = spark.createDataFrame([("p1",), ("p2",)], "id string")
    wl = A.work_list(posts, ["tone", "purpose"])
    assert sorted(map(tuple, wl.collect())) == [("p1", 0, "tone"), ("p1", 1, "purpose"),
                                                ("p2", 0, "tone"), ("p2", 1, "purpose")]
    assert "Exchange" not in wl._jdf.queryExecution().executedPlan().toString()


def test_annotate_errors_kept_per_row_and_prefix_sent(spark):
    seen = []

    def factory():
        def call(messages):
            if "boom" in messages[0]["content"]:
                raise RuntimeError("model failed")
            return messages[-1]["content"] + "|" + messages[0]["content"]
        return call

    prompts = spark.createDataFrame([("a", "hello"), ("b", "boom")], "id string, prompt string")
    out = {r["id"]: r for r in A.annotate(prompts, factory, prefix="PFX", partitions=2).collect()}
    assert out["a"]["response"] == "PFX|hello" and out["a"]["error"] is None
    assert out["b"]["response"] is None and out["b"]["error"].startswith("RuntimeError")
    assert len(out["a"]["prompt_md5"]) == 32


def test_recorded_and_pending(spark):
    prompts = spark.createDataFrame([("a", "p1"), ("b", "p2")], "id string, prompt string")
    rec = spark.createDataFrame([("p1", "r1")], "prompt string, response string").select(
        F.md5("prompt").alias("prompt_md5"), "response")
    got = {r["id"]: r["response"] for r in A.with_recorded(prompts, rec).collect()}
    assert got == {"a": "r1", "b": None}
    assert [r["id"] for r in A.pending(prompts, rec).collect()] == ["b"]


def test_csv_roundtrip_multiline(spark, tmp_path):
    from tessera.sources.tables import read_csv, write_table
    rows = [("1", 'line one\nline "two", with comma'), ("2", "plain")]
    df = spark.createDataFrame(rows, "id string, text string")
    write_table(df, str(tmp_path / "t"), fmt="csv")
    back = read_csv(spark, str(tmp_path / "t"), "id string, text string")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_annotate_resumable_sends_each_prompt_once(spark, tmp_path):
    import uuid

    def factory():
        nonce = uuid.uuid4().hex          # a new reply text on every call

        def call(messages):
            if messages[0]["content"] == "flaky" and not (tmp_path / "ok").exists():
                raise RuntimeError("transient")
            return f"{messages[0]['content']}:{nonce}"
        return call

    prompts = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "flaky")], "id string, prompt string")
    store = str(tmp_path / "store")
    first = {r["id"]: r["response"] for r in A.annotate_resumable(prompts, factory, store).collect()}
    assert first["c"] is None and first["a"].startswith("p1:")
    (tmp_path / "ok").write_text("1")
    second = {r["id"]: r["response"] for r in A.annotate_resumable(prompts, factory, store).collect()}
    assert second["a"] == first["a"] and second["b"] == first["b"]     # reused, not re-sent
    assert second["c"].startswith("flaky:")                             # failed call retried
    assert spark.read.parquet(store).count() == 3


def test_row_cluster_means_last_key_wins_and_empty_clusters_omitted(spark):
    from tessera.streaming.scoring import row_cluster_means
    lookup = [("a", 1), ("b", 1), ("c", 2), ("a", 3)]
    replies = spark.createDataFrame([
        ("p1", '{"a": 1, "b": 2, "a": 3, "zz": 9}'),     # a -> 3 (last wins); cluster 2 has no feature present
        ("p2", '{"c": "high", "b": 1}'),                 # c present but not numeric -> mean NULL for cluster 2
        ("p3", "not json"),
    ], "id string, response string")
    got = {(r["id"], r["cluster"]): r["mean_score"] for r in row_cluster_means(replies, lookup).collect()}
    assert got == {("p1", 1): 2.5, ("p1", 3): 3.0, ("p2", 1): 1.0, ("p2", 2): None}


def test_both_endpoints_keep_every_post_and_tell_what_failed(spark):
    from tessera.streaming.scoring import both_endpoints

    def answers():
        def call(messages):
            text = messages[0]["content"]
            if "refused" in text:
                raise ValueError("no")
            return "{" if "cut" in text else ('{"brief_reasoning": "", "answer1": "Yes", "answer2": "yes", "answer3": "No", '
                                              '"answer4": "No", "answer5": "No", "frequency": 2.7}')
        return call

    def scores():
        def call(messages):
            return "none" if "unscored" in messages[0]["content"] else '{"a": 1, "b": 2, "a": 3}'
        return call

    posts = spark.createDataFrame([("1", "plain"), ("2", "refused"), ("3", "cut"), ("4", "unscored"), ("5", None)], "id string, text string")
    got = {(r.id, r.cluster): r for r in both_endpoints(posts, "q", "csv", [("a", 1), ("b", 1), ("z", 2)], answers, scores).collect()}
    assert set(got) == {("1", 1), ("2", 1), ("3", 1), ("4", None), ("5", 1)}
    one = got["1", 1]
    assert (one.answer1, one.answer2, one.freq, one.mean_score, one.error) == (True, False, 2, 2.5, None)
    assert got["2", 1].error == "questionnaire: ValueError: no" and got["2", 1].mean_score == 2.5
    assert got["3", 1].error == "questionnaire: invalid json" and got["3", 1].answer1 is False
    assert got["4", None].error == "features: invalid json" and got["4", None].answer1 is True


def test_workers_hold_bounded_batches(spark):
    """10,000 prompts in one partition came as one batch; a batch is bounded by rows, and by bytes where prompts are long."""
    from unittest import mock
    saved = {name: spark.conf.get(name) for name in A.ARROW_LIMITS}
    try:
        for name in A.ARROW_LIMITS:
            spark.conf.unset(name)
        for n, length, most in ((10_000, 10, 1000), (300, 100_000, 60)):
            rows = spark.range(n).coalesce(1).select(F.col("id").cast("string").alias("id"), F.repeat(F.lit("x"), length).alias("prompt"))
            replies = A.annotate(rows, lambda: lambda messages: "ok")
            sizes = rows.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long").collect()
            assert sum(r.n for r in sizes) == n and max(r.n for r in sizes) <= most
            assert replies.where("response = 'ok' AND error IS NULL").count() == n
    finally:
        for name, value in saved.items():
            spark.conf.set(name, value)
