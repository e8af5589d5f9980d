"""Budgets and prefixes against a recursive plain version."""

import hashlib
import re
from collections import defaultdict
from math import floor

import pytest
from pyspark.sql import functions as F
from tessera.llm import mixing


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def share(budget, nodes):
    """nodes: name -> (weight, cap)."""
    got, left = {}, dict(nodes)
    while left:
        level = (budget - sum(got.values())) / sum(w for w, _ in left.values())
        full = [n for n, (w, cap) in left.items() if cap <= level * w + 1e-9]
        if not full:
            return got | {n: min(floor(level * w + 1e-9), cap) for n, (w, cap) in left.items()}
        for n in full:
            got[n] = left.pop(n)[1]
    return got


def brute(rows, ratio, epochs, seed):
    leaf = defaultdict(list)
    for d, t, lang, source in rows:
        s = source or ""
        leaf[f"d{int(md5(s)[:2], 16) % 4}", lang or "", s].append((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    supply = {k: sum(n for _, n in v) for k, v in leaf.items()}
    total = lambda *p: sum(n for k, n in supply.items() if k[:len(p)] == p)
    out = []
    doms = share(floor(ratio * total()), {d: (mixing.DOMAIN_WEIGHTS.get(d, 1), total(d) * epochs) for d in {k[0] for k in leaf}})
    for d, b in doms.items():
        langs = share(b, {x: (mixing.LANG_WEIGHTS.get(x, 1), total(d, x) * epochs) for x in {k[1] for k in leaf if k[0] == d}})
        for x, c in langs.items():
            for s, budget in share(c, {k[2]: (1, supply[k] * epochs) for k in leaf if k[:2] == (d, x)}).items():
                own, n = leaf[d, x, s], supply[d, x, s]
                whole = budget // n if n else 0
                rest = budget - whole * n
                key = lambda i: int(md5(f"{seed}|{whole}|{'null' if i is None else i}")[:15], 16)
                for i, t in own:
                    upto = sum(m for j, m in own if key(j) <= key(i))
                    out.append((i, d, x, s, t, budget, whole + (rest > 0 and upto <= rest)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("ratio,epochs", [(1.0, 4), (0.3, 1), (0.9, 1), (3.7, 4), (9.0, 2)])
def test_documents(documents, ratio, epochs):
    got = sorted(map(tuple, mixing.mix(documents, budget_ratio=ratio, max_epochs=epochs, seed=3).collect()), key=repr)
    want = brute([(r.doc_id, r.text, r.lang, r.source) for r in documents.collect()], ratio, epochs, 3)
    assert got == want


def test_odd_rows(odd, none):
    for df in (odd, none):
        got = sorted(map(tuple, mixing.mix(df, budget_ratio=0.6, max_epochs=2, seed=1).collect()), key=repr)
        assert got == brute([(r.doc_id, r.text, r.lang, r.source) for r in df.collect()], 0.6, 2, 1)


def test_shortage_stays_among_siblings(spark):
    """One language of d0 is short: its sibling takes the rest and other domains get no more than their weight."""
    src = {}
    i = 0
    while len(src) < 2:
        src.setdefault(f"d{int(md5(f's{i}')[:2], 16) % 4}", f"s{i}")
        i += 1
    (da, a), (db, b) = sorted(src.items())[:2]
    rows = [(n, "w " * 10, "en", a) for n in range(1)] + [(100 + n, "w " * 10, "de", a) for n in range(100)] + [(300 + n, "w " * 10, "en", b) for n in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.mix(df, budget_ratio=0.5, max_epochs=1, domain_weights={da: 1, db: 1}).groupBy("domain", "lang").agg(F.max("leaf_budget")).collect()
    assert {tuple(r)[:2]: r[2] for r in got} == {(da, "en"): 10, (da, "de"): 492, (db, "en"): 502}


def test_mixed_rows_follow_copies(documents, odd):
    for df in (documents, odd):
        want = mixing.mix(df, budget_ratio=1.2, max_epochs=3).agg(F.sum("copies")).first()[0]
        out = mixing.mixed(df, budget_ratio=1.2, max_epochs=3)
        assert out.columns == df.columns and out.count() == want
