"""SimHash against all pairs; hot blocks through midpoints give the same components."""

import random
import re
from itertools import combinations

import pytest
from tessera.llm import simhash
from tessera.llm.common import components
from xxhash import xxh64_intdigest


def plain(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    fp = [(d, plain(t)) for d, t in rows]
    nodes = sorted({f for _, f in fp})
    root = groups(nodes, [(a, b) for a, b in combinations(nodes, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for d, f in fp:
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    return sorted(((d, f, least.get(root[f])) for d, f in fp), key=repr)


def check(df):
    got = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_documents(documents):
    check(documents)


def test_odd_rows(odd, none):
    check(odd)
    check(none)


def test_fingerprint_in_slices(monkeypatch):
    text = " ".join(f"w{i % 700} W{i}" for i in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_AT_ONCE", 97)
    assert simhash.fingerprint(text.encode()) == whole == plain(text)


@pytest.mark.parametrize("bits", [0, 1, 2])
@pytest.mark.parametrize("cap", [1, 64])
def test_links_connect_what_all_pairs_connect(spark, bits, cap):
    r = random.Random(bits)
    seeds = [r.getrandbits(64) for _ in range(6)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(60):
            x = s
            for b in r.sample(range(64), r.randrange(1, 4)):
                x ^= 1 << b
            fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), bits, pairs_up_to=cap).collect()
    edges = [(e.a % (1 << 64), e.b % (1 << 64)) for e in found]
    assert all(0 < (a ^ b).bit_count() <= bits for a, b in edges)
    want = [(a, b) for a, b in combinations(sorted(fps), 2) if (a ^ b).bit_count() <= bits]
    assert groups(fps, edges) == groups(fps, want)
    if cap == 64 and bits < 2:
        assert {tuple(sorted(e)) for e in edges} == set(want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


def test_keep_one(odd, documents, none):
    for df in (documents, odd, none):
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        tagged = simhash.near_duplicates(df)
        assert kept.count() == tagged.select("label").distinct().count()
        stay = {r.component_id for r in tagged.select("component_id").distinct().collect()}
        assert {r.doc_id for r in kept.select("doc_id").collect()} == stay


def test_near_copies_of_long_texts_meet(spark):
    r = random.Random(3)
    base = [f"word{r.randrange(10_000)}" for _ in range(6000)]
    other = base[:3000] + ["changed"] + base[3001:]
    rows = [(7, " ".join(base)), (3, " ".join(other)), (9, " ".join(base[::-1]))]
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {7: 3, 3: 3, 9: 9}
