"""Quality rules against a brute-force version; order of rules never changes a verdict."""

import re
from collections import Counter


from tessera.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    hit = set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def check(df):
    got = sorted((tuple(r)[:-1] for r in rules.judge(df).collect()), key=repr)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=repr)


def test_metrics_on_documents(documents):
    check(documents)


def test_metrics_on_odd_rows(odd, none):
    check(odd)
    check(none)


def test_cascade_order_does_not_change_the_verdict(documents):
    text = documents["text"]
    for order in (list(rules.RULES), list(reversed(rules.RULES))):
        n = documents.where(rules.cascade(order, text).isNull()).count()
        assert n == documents.where(rules.cascade(list(rules.RULES), text).isNull()).count()


def test_keep_agrees_with_judge_and_keeps_columns(odd, documents):
    for df in (odd, documents):
        kept = rules.keep(df)
        assert kept.columns == df.columns
        assert kept.count() == rules.judge(df).where("kept").count()


def test_order_is_by_rejection_per_cost(documents):
    found = rules.ordered(documents, (*rules.BASE, *rules.RULES))
    ratio = [rate / cost for _, cost, rate in found]
    assert ratio == sorted(ratio, reverse=True) and any(rate > 0 for _, _, rate in found)


def test_junk_goes_and_prose_stays(spark):
    prose = "The river ran past the old mill and nobody spoke of it again until the winter came back over the hills"
    rows = [(1, prose), (2, " ".join(w.upper() + "!!" for w in prose.split())), (3, " ".join(f"{w}%%%" for w in prose.split())),
            (4, " | ".join(prose.split())), (5, "word " * 50), (6, " ".join(w for w in prose.split() for _ in range(4)))]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_native_plan(documents):
    plan = rules.judge(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan), plan


def test_the_sample_is_drawn_by_all_tasks(spark):
    from pyspark.sql import functions as F
    docs = spark.range(0, 5000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    drawn = rules.sampled(docs, F.col("text"), 5000, 100)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.index("Exchange") < plan.index("Sample")
    assert drawn.rdd.getNumPartitions() == 1 and 30 < drawn.count() < 250
