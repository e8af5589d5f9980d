"""FM-index and contamination against brute force."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import decontaminate as D
from tessera.llm.fm import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def brute(docs, bench):
    wins = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else []:
            wins.setdefault(tuple(w[k:k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, items = words(t), set()
        hit = [0] * len(w)
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in wins:
                    items |= wins[x]
                    hit[k:k + n] = [1] * n
        ids = ",".join(sorted(str(i) for i in items if i is not None))
        out.append((d, len(w), sum(hit), ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), sum(hit) > 0))
    return sorted(out, key=repr)


def check(docs, bench, **kw):
    got = sorted(map(tuple, D.digest(D.contamination(docs, bench, **kw)).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])


@pytest.fixture(scope="module")
def odd_bench(spark):
    rows = [(1, "one two three"), (2, None), (3, ""), (4, "..."), (5, "délta"), (6, "a a a a a a a a a a a"), (None, "one two"), (1, "one two three"), (10, "ONE, Two; three")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_documents(documents, benchmark):
    check(documents, benchmark)
    check(documents, benchmark, block_bytes=1500)


def test_odd_rows(odd, odd_bench, none, benchmark, spark):
    check(odd, odd_bench)
    check(odd, odd_bench, block_bytes=10)
    check(none, odd_bench)
    check(odd, spark.createDataFrame([], "item_id long, text string"))


def test_cut_texts_are_clean(documents, benchmark, odd, odd_bench, none):
    for docs, bench in ((documents, benchmark), (odd, odd_bench), (none, benchmark)):
        out = D.decontaminate(docs, bench)
        assert out.columns == docs.columns
        before = {(r.doc_id, r.n_words, r.n_hit) for r in D.digest(D.contamination(docs, bench)).collect()}
        rows = out.select("doc_id", "text", "n_chars").collect()
        assert len(rows) == docs.count() - sum(n == h and n > 0 for d, n, h in before if d not in (None, 6)) - (3 if docs is odd else 0)
        assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
        same = {r.doc_id: r.text for r in docs.collect()}
        clean = {d for d, _, h in before if not h}
        assert all(same[r.doc_id] == r.text for r in rows if r.doc_id in clean)


def test_cut():
    text = "Keep this. one TWO, three! and this"
    assert D.cut(text.encode(), [(2, 5)]) == b"Keep this. ! and this"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=80), st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=6), min_size=1, max_size=8), st.integers(1, 9))
def test_index_finds_every_occurrence(text, patterns, sample):
    index = FMIndex(np.array(text, np.int64), 6, sample)
    lengths = np.array([len(p) for p in patterns])
    table = np.zeros((len(patterns), 6), np.int64)
    for i, p in enumerate(patterns):
        table[i, :len(p)] = p
    low, high = index.search(table, lengths)
    for p, a, b in zip(patterns, low, high):
        want = [i for i in range(len(text) - len(p) + 1) if text[i:i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
