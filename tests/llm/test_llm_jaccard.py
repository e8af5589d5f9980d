"""The Jaccard join against all pairs of plain sets."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F
from tessera.llm import jaccard


def shingles(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    tried = set()
    for own in holders.values():
        for i, j in combinations(own, 2):
            if (i, j) not in tried:
                tried.add((i, j))
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def check(df, **how):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_sets(df, **how).collect()), key=repr)
    want = brute([(r.doc_id, r.text) for r in df.collect()], how.get("percent", 90))
    assert got == want
    return got


def test_documents(documents):
    check(documents)


def test_odd_rows(odd, none):
    check(odd, chunk_bytes=3000)
    check(none)


def family(r, base, copies, changes):
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(r.randrange(changes + 1)):
            words[r.randrange(len(words))] = f"new{r.randrange(10 ** 6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("short", [2, 64])
def test_families_chains_and_common_passages(spark, short, monkeypatch):
    monkeypatch.setattr(jaccard, "_FEW", short // 16)
    r = random.Random(short)
    texts = []
    for length in (12, 40, 90, 200):
        base = [f"w{r.randrange(3000)}" for _ in range(length)]
        texts += family(r, base, 25, max(1, length // 25))
        chain = list(base)
        for i in range(0, length - 2, max(2, length // 12)):            # each step links with the next, the ends do not
            chain[i] = f"step{length}_{i}"
            texts.append(" ".join(chain))
    shared = [f"common{i}" for i in range(60)]
    texts += [" ".join(shared + [f"own{k}_{i}" for i in range(r.randrange(3, 9))]) for k in range(40)]      # near the limit, on both sides
    texts += [" ".join(shared[r.randrange(6):54 + r.randrange(6)]) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900 + i, texts[i]) for i in range(0, 60, 7)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    real = jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda classes, percent: real(classes, percent, short))
    got = check(df, chunk_bytes=2000)
    assert len({c for *_, c in got}) < len(texts) / 2


@pytest.mark.parametrize("percent", [60, 100])
def test_other_limits(spark, percent):
    r = random.Random(percent)
    base = [f"w{r.randrange(500)}" for _ in range(50)]
    rows = list(enumerate(family(r, base, 40, 6) + ["a b c", "A  B\tc", "a b", "A b", "a", "b"]))
    check(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)


def test_bounds_of_derived_answers(spark):
    r = random.Random(1)
    sets = [frozenset(r.sample(range(60), r.randrange(30, 50))) for _ in range(25)]
    size = [len(s) for s in sets]
    known = [(0, j, size[0], size[j], len(sets[0] & sets[j])) for j in range(1, 25)]
    pairs = [(i, j, size[i], size[j]) for i, j in combinations(range(25), 2)]
    got = jaccard._derived(spark.createDataFrame(pairs, "a long, b long, sa long, sb long"),
                           spark.createDataFrame(known, "a long, b long, sa long, sb long, o long")).collect()
    assert len(got) == 24 * 23 // 2
    assert all(g.low <= len(sets[g.a] & sets[g.b]) <= g.high for g in got)


def test_blocks_of_a_list_are_skipped(spark):
    live = spark.createDataFrame([(7, c, pos, size, 0, pos // jaccard.BLOCK, c) for c, pos, size in ((1, 0, 100), (2, 3, 100), (3, 40, 100), (4, 0, 50))],
                                 "token long, c long, pos long, size long, band long, block long, label long")
    found = jaccard._pairs(live, live.where("c = 1"), 90).collect()
    assert [(p.a, p.b) for p in found] == [(1, 2)]


def test_needed_overlap(spark):
    rows = [(a, b) for a in range(1, 60) for b in range(1, 60)]
    got = spark.createDataFrame(rows, "a long, b long").withColumn("o", jaccard.needed(F.col("a"), F.col("b"), 90)).collect()
    assert all(190 * r.o >= 90 * (r.a + r.b) > 190 * (r.o - 1) for r in got)
