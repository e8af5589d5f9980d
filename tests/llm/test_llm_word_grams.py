"""Models of word trigrams against dictionaries of counts, each trusted document scored by the part that lacks it."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tessera.llm import kneser_ney as K
from tessera.llm import word_grams as W

TOKEN = re.compile(r"[　-鿿]|[^\x20\t-\r　-鿿]+")


def tokens(text):
    w = TOKEN.findall(text or "")
    return w + [None] if w else w


def dictionary_model(texts):
    counts = Counter()
    for w in texts:
        p = ["<"] * 2 + w
        counts.update(tuple(p[i - 2:i + 1]) for i in range(2, len(p)))
    levels = {3: counts}
    for n in (2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    rates, contexts = {}, {}
    for n, c in levels.items():
        k = Counter(c.values())
        y = k[1] / (k[1] + 2 * k[2]) if k[1] + k[2] else 0
        rate = [i - (i + 1) * y * k[i + 1] / k[i] if k[i] and k[i + 1] else 0 for i in (1, 2, 3)]
        rates[n] = [d if d > 0 else i / 2 for i, d in zip((1, 2, 3), rate)]
        own = contexts[n] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            own[g[:-1]][0] += v
            own[g[:-1]][1] += rates[n][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / (len(levels[1]) + 1)
        n = len(g)
        if g[:-1] not in contexts[n]:
            return p(g[1:])
        total, weight = contexts[n][g[:-1]]
        c = levels[n].get(g, 0)
        return (c - rates[n][min(c, 3) - 1] if c else 0) / total + weight / total * p(g[1:])
    return p


def brute(rows, trusted):
    part = lambda d: int(W.part_of(np.array([d]))[0])
    models = {}
    for lang in {x or '' for _, _, x in rows}:
        for k in range(W.PARTS):
            own = [w for w in (tokens(t) for d, t, x in rows if (x or "") == lang and d in trusted and part(d) == k) if w]
            if own:
                models[lang, k] = dictionary_model(own)
    out = []
    for d, t, lang in rows:
        w = tokens(t)
        by = [models[lang or "", k] for k in range(W.PARTS) if (lang or "", k) in models and not (d in trusted and part(d) == k)]
        pad = ["<"] * 2 + w
        nll = [-sum(math.log(p(tuple(pad[i - 2:i + 1]))) for i in range(2, len(pad))) / len(w) for p in by] if w else []
        out.append((d, lang, len((t or "").encode()), sum(nll) / len(nll) if nll else None))
    return out


def check(df, trusted, spark, **kw):
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = sorted(map(tuple, W.perplexities(df, ids, **kw).collect()), key=repr)
    want = sorted(brute([(r.doc_id, r.text, r.lang) for r in df.collect()], trusted), key=repr)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    for a, b in zip(got, want):
        assert (a[3] is None) == (b[3] is None) and (a[3] is None or a[3] == pytest.approx(b[3], rel=1e-4))


def test_documents_and_odd_rows(spark, documents, odd, none):
    check(documents.limit(60).cache(), set(range(0, 300, 2)), spark)
    check(documents.limit(60).coalesce(1).cache(), set(range(0, 300, 2)), spark, chunk_bytes=5000)
    small = odd.where("length(text) < 3000 or text is null")
    check(small, {1, 2, 3, 4, 6, 11, 100, 101, 102, 103, 104, 105, 110, 120}, spark)
    check(small, set(), spark)
    check(none, {1}, spark)


def test_probabilities_add_up():
    """All words of a model and one it has not seen have probability one together, after seen and unseen contexts."""
    texts = [tokens(t) for t in ("the cat sat on the mat", "the dog sat on the log", "a cat and a dog")] * 3
    p, every = dictionary_model(texts), {w for t in texts for w in t}
    for context in (("<", "<"), ("the", "cat"), ("sat", "on"), ("zz", "zz"), ("zz", "cat")):
        assert sum(p((*context, w)) for w in (*every, "unseen")) == pytest.approx(1.0)


def test_counts_without_ones_and_twos(spark):
    """Every gram occurs often: no discount can be estimated, and probabilities still add up."""
    rows = [(i, "ab ca bc", "en") for i in range(9)] + [(20, "ab d", "en")]
    check(spark.createDataFrame(rows, "doc_id long, text string, lang string"), set(range(9)), spark)


def test_words_in_no_trusted_order_are_junk(spark):
    """Word salad and one word over and over are made of good words; a model of few bytes takes them for good text."""
    good = ["the cat sat on the mat and then the dog ran to the old red barn", "when the sun is low we walk along the river to the mill"]
    rows = [(i, good[i % 2], "en") for i in range(40)]
    rows += [(100, " ".join(sorted(good[0].split(), reverse=True)), "en"), (101, " ".join(["the"] * 14), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.kept for r in K.classify(docs, docs.where("doc_id < 40").select("doc_id")).collect()}
    assert not found[100] and not found[101] and all(found[i] for i in range(40))


def test_what_it_leaves_on_disk(spark):
    """Grams are asked for in turns and leave only replies and sums of words: a small multiple of the text, not of its grams."""
    import os

    from tessera.session import checkpoint_dir
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 1000) % 20000), "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).cache()
    top = checkpoint_dir(spark).replace("file://", "") + "/stages"
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(top) for f in fs)
    before = held()
    assert W.perplexities(docs, docs.where("doc_id % 2 = 0").select("doc_id")).where("nll > 0").count() == 400
    assert held() - before < 1.5 * sum(len(t) for _, t, _ in rows)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
