"""Stages that outlive a session, a stream over a reply store, columns that come back."""

import json
import os
import uuid

from pyspark.sql import functions as F
from tessera.operators import summaries as G
from tessera.plans import fixtures as fx
from tessera.plans import jobs as J
from tessera.session import checkpoint_dir, fingerprint
from tessera.streaming import scoring

SF = "/root/testdata/sf0.001"


def test_later_session_goes_on_after_the_last_finished_stage(spark, monkeypatch):
    spark.conf.set(J.RESUME, "true")
    built = []
    one, two, three = (f"{n}-{uuid.uuid4().hex[:8]}" for n in ("one", "two", "three"))      # not of an earlier run of this test

    def run(*names):
        J._STAGES.clear()                                       # what a new session has
        built.clear()
        out = {}
        for n in names:
            def build(n=n):
                built.append(n)
                return spark.range(3).withColumn("stage", F.lit(n))
            out[n] = J.stage(spark, SF, n, build).count()
        return out

    try:
        assert run(one, two) == {one: 3, two: 3} and built == [one, two]
        assert run(one, two, three) == {one: 3, two: 3, three: 3} and built == [three]
        key = fingerprint(spark, [f"{SF}/{t}.parquet" for t in J.STAGE_INPUTS], two)
        os.remove(f"{checkpoint_dir(spark).replace('file://', '')}/stages/{two}-{key}/_SUCCESS")      # as if it had been torn
        assert run(one, two, three) and built == [two]
        monkeypatch.setattr(J, "STAGE_INPUTS", ("labels",))
        assert run(one) and built == [one]                  # other inputs, another table
    finally:
        spark.conf.unset(J.RESUME)
        J._STAGES.clear()


def test_other_files_and_parameters_give_other_names(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    first = fingerprint(spark, [str(tmp_path)], 1)
    assert fingerprint(spark, [str(tmp_path)], 1) == first != fingerprint(spark, [str(tmp_path)], 2)
    (tmp_path / "b").write_text("y")
    assert fingerprint(spark, [str(tmp_path)], 1) != first


def counting(path, client):
    def factory(**options):
        call = client(**options)

        def counted(messages):
            with open(path, "a") as f:
                f.write(messages[0]["content"].replace("\n", " ") + "\n")
            return call(messages)
        return counted
    return factory


def test_stream_over_a_store_sends_each_prompt_once(spark, tmp_path):
    src, sink, store, log = (str(tmp_path / n) for n in ("in", "out", "store", "calls"))
    os.makedirs(src)
    texts = ["soup", "bread", "soup", None, "stew", "bread"]
    lookup = [(n, c) for n, c, _, _ in fx.APP_FEATURES]
    clients = counting(log, fx.stub_client), counting(log, fx.stub_scoring_client(fx.app_feature_names()))

    def add(k, texts):
        with open(f"{src}/part-{k}.json", "w") as f:
            f.write("\n".join(json.dumps({"id": f"{k}_{i}", "text": t}) for i, t in enumerate(texts)))

    def go():
        stream = spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", 1).json(src)
        scoring.run_with_store(stream, store, sink, sink + "-checkpoint", "q", "f", lookup, *clients)

    add(0, texts)
    add(1, texts[:2] + ["pie"])
    go()
    sent = open(log).read().splitlines()
    assert len(sent) == len(set(sent)) == 2 * 5                   # the null text is an empty one
    add(2, ["pie", "soup", "new"])
    go()                                                        # stopped and started again: only the new text is sent
    assert len(open(log).read().splitlines()) == 2 * 6
    posts = spark.read.schema("id string, text string").json(src)
    want = scoring.both_endpoints(posts, "q", "f", lookup, fx.stub_client, fx.stub_scoring_client(fx.app_feature_names()))
    rows = lambda df: sorted(map(tuple, df.select(*want.columns).collect()), key=repr)
    assert rows(spark.read.parquet(sink).drop("batch")) == rows(want)


def test_columns_are_those_that_came_back(spark):
    long = spark.createDataFrame([("a", "tone_Help-seeking", 1.0), ("a", "odd `name`, x", 2.0), ("b", "x y", None), ("b", "tone_Help-seeking", 3.0),
                                  ("a", "tone_Help-seeking", 0.5), ("c", None, 1.0)], "id string, f string, v double")
    got = G.pivot_discovered(long, "id", "f", "v")
    assert sorted(got.columns) == ["id", "odd `name`, x", "tone_Help-seeking", "x y"]
    assert {r["id"]: (r["tone_Help-seeking"], r["odd `name`, x"], r["x y"]) for r in got.collect()} == {"a": (1.0, 2.0, None), "b": (3.0, None, None)}
    assert G.pivot_discovered(long.where("false"), "id", "f", "v").columns == ["id"]
