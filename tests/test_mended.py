"""Cases that the fixtures do not make: repeated keys, odd numbers, missing labels, tiny p, outer spaces, broken lines."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import parsing as P
from tessera.functions.scalars import sig_round
from tessera.functions.tails import f_sf
from tessera.operators import stats as T
from tessera.sources.tables import read_csv, read_posts_jsonl, write_table


def test_last_of_a_repeated_key_wins(spark):
    df = spark.createDataFrame([('{"a":"No","b":"x","a":"Yes"}',), ('{"a":"No"}',)], "t string")
    got = df.select(*P.parse_object_fields("t", ["a", "b"])).collect()
    assert [(r.a, r.b, r.error) for r in got] == [("Yes", "x", None), ("No", None, "missing key: b")]


def test_bare_object_is_no_list(spark):
    df = spark.createDataFrame([('{"a": "1"}',), (' [{"a": "1"}]',), ('text [{"a": "2"}] end',)], "t string")
    got = [r.v for r in df.select(P.parse_list_two_stage("t", "struct<a:string>").alias("v")).collect()]
    assert got[0] is None and got[1][0].a == "1" and got[2][0].a == "2"


def test_to_double_takes_numbers_only(spark):
    texts = ["1", " 2.5 ", "-3e2", ".5", "NaN", "Infinity", "1e400", "3d", "3f", "many", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.v for r in df.select(P.to_double("t").alias("v")).collect()] == [1.0, 2.5, -300.0, 0.5] + [None] * 8


def test_missing_labels_are_left_out(spark):
    rows = [("a", i % 3 == 0) for i in range(60)] + [("b", i % 2 == 0) for i in range(45)]
    known = spark.createDataFrame(rows, "r string, c boolean")
    more = spark.createDataFrame(rows + [(None, True)] * 40 + [("a", None)] * 7, "r string, c boolean")
    assert T.chisq_independence(more, "r", "c").collect() == T.chisq_independence(known, "r", "c").collect()


def test_empty_cells_count_in_the_statistic(spark):
    rows = [("a", "x")] * 10 + [("b", "y")] * 10 + [("c", "x")] * 5 + [("c", "y")] * 5
    got = T.chisq_independence(spark.createDataFrame(rows, "r string, c string"), "r", "c").first()
    assert got.statistic == pytest.approx(20.0) and got.df == 2


def test_tiny_p_is_rounded_not_lost(spark):
    values = [1.23456e-310, 9.8765e-307, 4.4444e-100, 0.012345, 0.0, 123456.0]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(sig_round("v", 3).alias("v")).collect()]
    assert got == pytest.approx([1.23e-310, 9.88e-307, 4.44e-100, 0.0123, 0.0, 123000.0], rel=1e-9)
    assert not any(map(math.isnan, got))


def test_markers_rank_by_f_where_p_underflows(spark):
    rows = [(f"g_{i}", 1, 2.0, 1.0, 1, 10**6, 2000.0 + i, 0.5, 2000.0 + i) for i in range(40)]
    tests = spark.createDataFrame(rows, "feature string, cluster int, mean_in_cluster double, mean_out_cluster double, dfn int, dfd long, f double, ges double, f_raw double")
    got = T.marker_table(tests, 15).orderBy("rank").select("feature", "rank").collect()
    assert [tuple(r) for r in got] == [(f"g_{39 - i}", i + 1) for i in range(15)]


def test_many_posts_do_not_overflow():
    assert 0 < f_sf(3.0, 1, 3_000_000_000) < 0.1


def test_csv_keeps_spaces_empty_texts_and_nulls(spark, tmp_path):
    texts = ["  lead and trail \t", "", "   ", None, 'quote " and, comma', "line\nbreak", "\\", "NULL"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    write_table(df, f"{tmp_path}/x", fmt="csv")
    assert [r.text for r in read_csv(spark, f"{tmp_path}/x", "i int, text string").orderBy("i").collect()] == texts


def test_a_broken_line_fails_the_read(spark, tmp_path):
    (tmp_path / "posts.jsonl").write_text('{"text": "a", "label": "l"}\n{"text": "b", "la\n')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_posts_jsonl(spark, str(tmp_path / "posts.jsonl")).select(F.sum(F.length("text"))).collect()


def _counting(folder, fail_first=False):
    """A client factory that leaves one file a call; with ``fail_first`` the first call for a prompt fails."""
    def factory(model="none", max_tokens=0):
        import hashlib
        import os
        import uuid

        def call(messages):
            own = os.path.join(folder, hashlib.md5(messages[0]["content"].encode()).hexdigest())
            os.makedirs(own, exist_ok=True)
            first = not os.listdir(own)
            open(os.path.join(own, uuid.uuid4().hex), "w").close()
            if fail_first and first:
                raise RuntimeError("busy")
            return f"{model} {max_tokens} {messages[0]['content']}"
        return call
    return factory


def test_resumable_sends_each_distinct_prompt_once(spark, tmp_path):
    import os

    from tessera.operators.annotate import annotate_resumable
    prompts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c")], "id int, prompt string")
    calls, store = str(tmp_path / "calls"), str(tmp_path / "store")
    run = lambda p: {r.id: r.response for r in annotate_resumable(p, _counting(calls), store, model="m", max_tokens=9).collect()}
    want = {1: "m 9 a", 2: "m 9 a", 3: "m 9 b", 4: None, 5: "m 9 c"}
    assert run(prompts.where("id < 4")) == {k: want[k] for k in (1, 2, 3)}
    assert run(prompts) == want
    assert sorted(len(os.listdir(os.path.join(calls, d))) for d in os.listdir(calls)) == [1, 1, 1]


def test_calls_are_tried_again(spark, tmp_path):
    from tessera.operators.annotate import annotate
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id int, prompt string")
    once = annotate(prompts, _counting(str(tmp_path / "x"), True), attempts=1).collect()
    assert len(once) == 20 and all(r.response is None and r.error == "RuntimeError: busy" for r in once)
    again = annotate(prompts, _counting(str(tmp_path / "y"), True), attempts=2).collect()
    assert all(r.response == f"none 0 p{r.id}" and r.error is None for r in again)


def test_a_damaged_store_sends_nothing(spark, tmp_path):
    from tessera.operators.annotate import annotate_resumable
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "part-0.parquet").write_text("not parquet")
    prompts = spark.createDataFrame([(1, "a")], "id int, prompt string")
    with pytest.raises(Exception):
        annotate_resumable(prompts, _counting(str(tmp_path / "calls")), str(tmp_path / "store"))
    assert not (tmp_path / "calls").exists()


def test_no_text_is_shuffled_for_the_summary(spark):
    """C1 joins replies by prompt hash: neither texts nor prompts pass an exchange."""
    import re

    import __spark_entry__ as E
    plan = E.queries()["c1_questionnaire_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    below = plan[plan.index(join):]
    assert not re.search(r"Project \[[^\]]*\bprompt#", below), plan


def test_pair_texts_take_one_scan(spark):
    """P4 joins the broadcast ids of the pairs to one scan of the posts."""
    from tessera.operators.posts import fetch_pair_texts
    posts = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", None)], "id string, text string")
    pairs = spark.createDataFrame([(1, "a", "b"), (2, "c", "a"), (3, "a", "gone"), (4, "b", "b")], "pair_id int, id1 string, id2 string")
    out = fetch_pair_texts(pairs, posts)
    assert sorted(map(tuple, out.collect())) == [(1, "a", "b", "A", "B"), (2, "c", "a", None, "A"), (4, "b", "b", "B", "B")]
    files = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) as id", "text")
    plan = fetch_pair_texts(pairs, files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "SortMergeJoin" not in plan


def test_parsing_of_one_file_is_spread_over_all_cores(spark, tmp_path):
    """Replies to the posts of one file with one row group were made and parsed by one task."""
    from tessera.plans import jobs as J
    rows = [(i, f"text {i}", "en", "s", 2000) for i in range(4000)] + [(7, "again", "fr", "s", 2), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    stage = J.questionnaire(spark, str(tmp_path))
    assert stage.count() == len(rows) and stage.where("doc_id = 7").count() == 2
    assert len(stage.inputFiles()) >= spark.sparkContext.defaultParallelism
    replies = J.rating_responses(spark, str(tmp_path))
    assert replies.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
