"""Scalar expressions and display rules (X1-X13, S5, 1.3.9, 1.3.12, 1.3.13)."""

import math

from pyspark.sql import functions as F

from tessera.functions import scalars as X
from tessera.functions.templates import render, template_parts


def test_log2_ratio_cases(spark):
    df = spark.createDataFrame([(2.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (None, 1.0)], "a double, b double")
    got = [r[0] for r in df.select(X.log2_ratio("a", "b")).collect()]
    assert got[0] == 1.0 and got[1] == math.inf and got[2] == -math.inf and math.isnan(got[3]) and got[4] is None
    clamp = [r[0] for r in df.select(X.clamp_neg_inf(X.log2_ratio("a", "b"))).collect()]
    assert clamp[2] == 0.0


def test_half_even_and_signif(spark):
    df = spark.createDataFrame([(0.125,), (0.135,), (2.769567e-176,), (1.74720483e-12,)], "x double")
    r = df.select(X.round_half_even("x", 2).alias("b"), X.sig_round("x", 3).alias("s")).collect()
    assert r[0]["b"] == 0.12 and r[1]["b"] == 0.14
    assert abs(r[2]["s"] - 2.77e-176) < 1e-185 and abs(r[3]["s"] - 1.75e-12) < 1e-20


def test_ids_text_and_canonical(spark):
    df = spark.createDataFrame([("tone", "Help-seeking"), ("emotional state", "Self acceptance")], "c string, n string")
    r = df.select(X.feature_id("c", "n").alias("fid")).select(
        "fid", X.canonical_id("fid").alias("canon"), X.before_first("fid").alias("g"),
        X.after_first("fid").alias("lbl"), X.underscores_to_spaces("fid").alias("disp")).collect()
    assert r[0]["fid"] == "tone_Help-seeking" and r[0]["canon"] == "tone_Help.seeking"
    assert r[1]["fid"] == "emotionalstate_Self_acceptance" and r[1]["lbl"] == "Self_acceptance"
    assert r[1]["g"] == "emotionalstate" and r[1]["disp"] == "emotionalstate Self acceptance"


def test_any_flag_and_row_sum(spark):
    df = spark.createDataFrame([("Yes", None, 1, 1), ("yes", "No", 1, None), (None, None, 0, 0)],
                               "a string, b string, x int, y int")
    r = df.select(X.any_equals(["a", "b"]).alias("f"), X.row_sum(["x", "y"]).alias("s")).collect()
    assert [x["f"] for x in r] == [1, 0, 0] and [x["s"] for x in r] == [2, None, 0]


def test_template_literal_text_is_not_interpreted(spark):
    df = spark.createDataFrame([("50% {x} \"q\"\nline",)], "t string")
    got = df.select(render("A {text} B {{lit}}", text="t")).first()[0]
    assert got == "A 50% {x} \"q\"\nline B {lit}"
    assert template_parts("{a}-{b}") == [("slot", "a"), ("lit", "-"), ("slot", "b")]
