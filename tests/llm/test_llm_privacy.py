"""Base spans against Python's regular expressions; trees as Columns against trees on arrays."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import privacy as P
from tessera.llm.queries import op9_privacy
from conftest import SF

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        t += v - 9 if v > 9 else v
    return t % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(t):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t or "") if holds(k, m.group())]


@pytest.fixture(scope="module")
def hard(spark):
    r = random.Random(1)
    texts = ["a.b+c@d.e.f-g@h.ij, x@y no@dot. @a.b q@w.e@r.t a@b.com_x@y.z", "1.2.3.4.5.6.7.8 999.1.2.3 256.0.0.1 001.02.3.0255 12.34.56.78",
             "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111" + " 5" * 30, "+1 (234) 567-8901 x +49.30.1234567 ++12 345 6789 +1 2 3",
             None, "", "9" * 4000 + " " + "1." * 3000 + " " + "a." * 2000 + "@" + "b." * 2000 + "c", "é@x.yé 😀 joe@mail.org 😀 4111111111111111",
             "1 2 3 " * 700, "x 1.2.3.4 " * 600, "joe (at) mail (dot) org, ann at host dot net call 0301234567"]
    texts += ["".join(r.choice("ab@.-+ 0123456789()") for _ in range(300)) for _ in range(150)]
    texts += [" ".join(r.choice(["+1 (555) 010-9999", "4111 1111 1111 1111", "10.0.0.1", "a@b.cd", "word", "12", "300.1.1.1"]) for _ in range(40)) for _ in range(20)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a@b.cd"), (1, "a@b.cd")], "doc_id long, text string").repartition(4)


def spans(rows):
    return [(s.kind, s.first, s.end) for s in rows]


def test_base(hard, documents, odd, none):
    for df in (hard, documents, odd, none):
        rows = P.find(df.withColumn("copy", F.col("text")).withColumn("both", F.struct("doc_id", "text")), id_col="both").collect()
        assert len(rows) == df.count()
        for r in rows:
            assert spans(r.base) == brute(r.both.text), r.both
            assert set(spans(r.base)) <= set(spans(r.spans))
            order = [(P.KINDS.index(s.kind), s.first) for s in r.spans]
            assert order == sorted(order)


def test_digest(spark, documents):
    import hashlib
    want = {r.doc_id: brute(r.text) for r in documents.collect()}
    for r in op9_privacy(spark, SF).collect():
        w = want[r.doc_id]
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in w) for k in P.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(":".join(map(str, x)) for x in w).encode()).hexdigest()


def test_plan_is_native(documents):
    trees = P.Boosted(0.0, (), {k: 0.0 for k in P.KINDS})
    plan = P.find(documents, trees=trees)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_trees_learn_and_columns_agree(spark):
    r = np.random.default_rng(3)
    x = r.integers(0, 20, (3000, len(P.FEATURES)))
    x[:, 0] = r.integers(0, 4, 3000)
    y = ((x[:, 2] > 12) & (x[:, 5] < 9) | (x[:, 10] > 17)).astype(float)
    trees = P.train(x, y)
    test = r.integers(0, 20, (500, len(P.FEATURES)))
    test[:, 0] = r.integers(0, 4, 500)
    truth = (test[:, 2] > 12) & (test[:, 5] < 9) | (test[:, 10] > 17)
    s = trees.scores(test)
    assert ((s > 0) == truth).mean() > 0.95                              # held-out accuracy
    assert truth[s > 4].mean() > 0.97 and (s > 4).sum() > 50
    df = spark.createDataFrame([(row.tolist(),) for row in test], "v array<int>")
    got = [v for (v,) in df.select(P.score(trees, [F.get("v", F.lit(i)) for i in range(len(P.FEATURES))])).collect()]
    assert np.allclose(got, s)


def test_added_spans_lie_where_no_base_span_does(hard):
    trees = P.Boosted(1.0, (), {k: 0.0 for k in P.KINDS})               # takes every candidate
    more = 0
    for r in P.find(hard, trees=trees).collect():
        base = spans(r.base)
        for k, a, b in set(spans(r.spans)) - set(base):
            more += 1
            assert all(y <= a or b <= x for _, x, y in base)
    assert more > 20
    found = {s for r in P.find(hard, trees=trees).collect() if r.doc_id == 10 for s in spans(r.spans)}
    assert ("email", 0, 23) in found and ("email", 25, 44) in found


def test_thresholds():
    assert P.thresholds([]) == {k: math.inf for k in P.KINDS}
    cells = [("email", 40, 3, 3), ("email", 20, 1, 1), ("email", -5, 2, 0), ("card", 9, 1000, 996), ("card", 8, 10, 10), ("phone", 64, 10, 9)]
    assert P.thresholds(cells) == {"email": 20 / P.CELL, "ip": math.inf, "card": 8 / P.CELL, "phone": math.inf}
    assert P.train(np.zeros((0, len(P.FEATURES)), np.int64), np.ones(0)).trees == ()


def with_check_digit(d):
    return next(d + c for c in "0123456789" if luhn(d + c))


def without_check_digit(d):
    return next(d + c for c in "0123456789" if not luhn(d + c))


def test_from_training_to_verdict(spark):
    """What is learned from rows that the test does not name: forms that no base pattern takes are added, look-alikes are not."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    forms = [("email", lambda: f"{word()} (at) {word()} (dot) org", True), ("email", lambda: f"{word()} at {word()} dot com", True),
             ("email", lambda: f"{word()}[at]{word()}.net", True), ("email", lambda: f"{word()} at {word()} dot {word()}s", False),
             ("ip", lambda: "10 .20.30 .4", True), ("ip", lambda: f"{digits(3)}9.1.2.3", False),
             ("card", lambda: ".".join(re.findall("....", with_check_digit(digits(15)))), True),
             ("card", lambda: ".".join(re.findall("....", without_check_digit(digits(15)))), False),
             ("phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", True), ("phone", lambda: f"x{digits(10)}y", False)]
    rows, truth = [], {}
    for i in range(2000):
        kind, make, good = forms[i % len(forms)]
        m, lead = make(), "; " + word() + ", " if i % 3 else ""
        rows.append((i, f"{lead}{m}; the end, joe@mail.org"))
        truth[i] = (kind, len(lead), len(lead) + len(m)) if good else None
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    trees = P.fit(docs.where("doc_id < 1000"))
    assert all(math.isfinite(t) for t in trees.thresholds.values())
    hit = wrong = 0
    for row in P.find(docs.where("doc_id >= 1000"), trees=trees).collect():
        added = set(spans(row.spans)) - set(spans(row.base))
        hit += truth[row.doc_id] in added
        wrong += len(added - {truth[row.doc_id]})
    good = sum(truth[i] is not None for i in range(1000, 2000))
    assert hit >= 0.9 * good and wrong <= 0.01 * good, (hit, wrong, good)


def test_fit_does_not_depend_on_partitions(spark, documents, none):
    assert P.fit(documents.repartition(1)) == P.fit(documents.repartition(7))
    assert P.fit(none).thresholds == {k: math.inf for k in P.KINDS}


def test_redact(spark):
    rows = [(1, "mail joe@mail.org or 10.0.0.1!"), (2, None), (3, "nothing"), (4, "😀 +1 (555) 010-9999, 4111111111111111")]
    trees = P.Boosted(0.0, (), {})
    got = {r.doc_id: r.text for r in P.redact(spark.createDataFrame(rows, "doc_id long, text string"), trees=trees).collect()}
    assert got == {1: "mail [email] or [ip]!", 2: None, 3: "nothing", 4: "😀 [phone], [card]"}
