"""Repeated strings and windows against brute force; each step of the way against its plain form."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tessera.llm import common, hashes, sketch, suffix_dedup, window_dedup
from tessera.llm.bwt import prefix_classes

LAST = 2**63 - 1


def marks(items, length):
    """items: [(id, sequence)] -> removed flags, by the definition."""
    first = {}
    for d, s in items:
        for i in range(len(s) - length + 1):
            k = s[i:i + length]
            first[k] = min(d, first.get(k, LAST))
    out = []
    for d, s in items:
        gone = bytearray(len(s))
        for i in range(len(s) - length + 1):
            if first[s[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        out.append(gone)
    return out


def brute_bytes(rows, length):
    items = [(LAST if d is None else d, (t or "").encode()) for d, t in rows]
    return sorted(((d, len(s), sum(g), [x for m in re.finditer(b"\1+", g) for x in m.span()], bytes(b for b, x in zip(s, g) if not x))
                   for (d, _), (_, s), g in zip(rows, items, marks(items, length))), key=repr)


def brute_words(rows, words):
    items = [(LAST if d is None else d, tuple(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t in rows]
    return sorted(((d, len(s), sum(g), " ".join(w for w, x in zip(s, g) if not x)) for (d, _), (_, s), g in zip(rows, items, marks(items, words))), key=repr)


@pytest.fixture(scope="module")
def copies(spark, odd, documents):
    """Copies with changes, shared passages, self-repeats and a passage that most rows hold."""
    r = random.Random(9)
    texts = [t for (t,) in documents.select("text").limit(25).collect()]
    passage = " ".join(f"shared{i}" for i in range(120))
    rows = [(r.randrange(1000), t[:r.randrange(len(t) + 1)] + passage + t[r.randrange(len(t) + 1):]) for t in texts for _ in range(3)]
    rows += [(2000 + i, t) for i, t in enumerate(texts)] + [(1, "ab" * 400), (5, "ab" * 300), (6, "xyz " * 200), (7, "xyz " * 150)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("chunk_bytes", [3_000, 4_000_000])
def test_bytes(documents, odd, copies, none, chunk_bytes):
    for df in (documents, odd.where("length(text) < 10000 or text is null"), copies, none):
        got = suffix_dedup.remove_repeats(df, length=50, chunk_bytes=chunk_bytes).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, list(r.spans), bytes(r.kept)) for r in got), key=repr) == \
            brute_bytes([(r.doc_id, r.text) for r in df.collect()], 50)


@pytest.mark.parametrize("chunk_bytes", [3_000, 4_000_000])
def test_words(documents, odd, copies, none, chunk_bytes):
    for df in (documents, odd, copies, none):
        got = sorted(map(tuple, window_dedup.remove_repeats(df, words=50, chunk_bytes=chunk_bytes).collect()), key=repr)
        assert got == brute_words([(r.doc_id, r.text) for r in df.collect()], 50)


def test_other_lengths(copies):
    rows = [(r.doc_id, r.text) for r in copies.collect()]
    assert sorted(map(tuple, window_dedup.remove_repeats(copies, words=7).collect()), key=repr) == brute_words(rows, 7)
    got = suffix_dedup.remove_repeats(copies, length=11).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, list(r.spans), bytes(r.kept)) for r in got), key=repr) == brute_bytes(rows, 11)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=150), st.integers(1, 20))
def test_classes_are_common_prefixes(symbols, length):
    text = np.array([*symbols, 0], np.uint8)
    classes, seen = prefix_classes(text, length), {}
    for i in range(len(text) - length + 1):
        if 0 not in text[i:i + length]:
            seen.setdefault(bytes(text[i:i + length]), set()).add(int(classes[i]))
    assert all(len(c) == 1 for c in seen.values())
    assert len({min(c) for c in seen.values()}) == len(seen)


def test_many_transforms_agree_with_one(monkeypatch):
    r = random.Random(4)
    base = bytes(r.choice(b"abcd") for _ in range(900))
    parts = list(dict.fromkeys(base[i:i + r.randrange(20, 90)] for i in range(0, 800, 3)))
    docs = np.array([r.randrange(50) for _ in parts])
    want = suffix_dedup.least_by_window(parts, docs, 20)
    monkeypatch.setattr(suffix_dedup, "TRANSFORM_SYMBOLS", 500)
    assert all((suffix_dedup._grouped(parts, docs, 20, depth) == want).all() for depth in range(4))


def test_heavy_keys_by_window(documents, odd, copies, none, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HEAVY_BYTES", 300)
    for df in (documents, odd.where("length(text) < 10000 or text is null"), copies, none):
        got = suffix_dedup.remove_repeats(df, length=50, chunk_bytes=3_000).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, list(r.spans), bytes(r.kept)) for r in got), key=repr) == \
            brute_bytes([(r.doc_id, r.text) for r in df.collect()], 50)


def test_a_common_phrase_fills_no_shard(spark, monkeypatch, tmp_path):
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, some(60) + " a phrase that most rows hold between different neighbours " + some(60)) for i in range(600)]
    answer = suffix_dedup.answer

    def counted(blobs, length):
        (tmp_path / str(random.getrandbits(64))).write_text(str(sum(len(x) for b in blobs for x in suffix_dedup._parse(b)[3:])))
        return answer(blobs, length)

    monkeypatch.setattr(suffix_dedup, "answer", counted)
    monkeypatch.setattr(suffix_dedup, "HEAVY_BYTES", 5_000, raising=False)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=50, chunk_bytes=3_000).collect()
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert max(sizes) < 2 * sum(sizes) / common.n_shards(spark)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, list(r.spans), bytes(r.kept)) for r in got), key=repr) == brute_bytes(rows, 50)


@pytest.mark.parametrize("at_once", [1, 700, 10**9])
def test_shards_answer_some_keys_at_a_time(at_once, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ANSWER_BYTES", at_once, raising=False)
    r = random.Random(6)
    base, sent, least = bytes(r.choice(b"abcd") for _ in range(400)), [], {}
    key = lambda w: int.from_bytes(min(w[i:i + 5] for i in range(8)), "big")
    for _ in range(9):
        some = {}
        for _ in range(40):
            i = r.randrange(380)
            n = next(m for m in range(1, 10) if i + m + 12 > len(base) or key(base[i + m:i + m + 12]) != key(base[i:i + 12]))
            some[base[i:i + n + 11]] = r.randrange(50)
        sent.append(sorted((key(f[:12]), f, d) for f, d in some.items()))
        for _, f, d in sent[-1]:
            for j in range(len(f) - 11):
                least[f[j:j + 12]] = min(d, least.get(f[j:j + 12], LAST))
    blobs = [suffix_dedup._pack(np.array([k for k, _, _ in x], np.uint64), [f for _, f, _ in x], np.array([d for _, _, d in x])) for x in sent]
    for x, got in zip(sent, suffix_dedup.answer(blobs, 12)):
        assert suffix_dedup._runs(got).tolist() == [least[f[j:j + 12]] for _, f, _ in x for j in range(len(f) - 11)]


def test_fragments_are_cut_with_their_overlap(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FRAGMENT_WINDOWS", 10)
    data = b"ab" * 500
    s = suffix_dedup.Strings(pa.RecordBatch.from_arrays([pa.array([1]), pa.array([data.decode()])], ["doc_id", "text"]), 50)
    s.keep(np.ones(len(s.key), bool))
    windows = np.repeat(s.start, s.count) + hashes.spread(s.count)
    assert (np.sort(windows) == np.arange(len(data) - 49)).all() and s.count.max() <= 10


@pytest.mark.parametrize("window,k", [(5, 2), (50, 16), (7, 7), (3, 1)])
def test_key_runs(window, k, monkeypatch):
    monkeypatch.setattr(hashes, "_BLOCK", 64)
    r = np.random.default_rng(window)
    codes = r.integers(0, 3, 3000).astype(np.uint64)
    bounds = np.unique(np.concatenate(([0, 3000], r.integers(0, 3000, 40), np.arange(100, 110))))
    bounds = np.sort(np.append(bounds, 500))                            # an empty document
    start, count, key, owner = hashes.key_runs(codes, bounds, window, k)
    at, keys = np.repeat(start, count) + hashes.spread(count), np.repeat(key, count)
    want = [i for a, b in zip(bounds[:-1], bounds[1:]) for i in range(a, b - window + 1)]
    assert at.tolist() == want
    assert all(bounds[o] <= s and s + c + window - 1 <= bounds[o + 1] for s, c, o in zip(start, count, owner))
    seen = {}
    for i, x in zip(at.tolist(), keys.tolist()):
        assert seen.setdefault(codes[i:i + window].tobytes(), x) == x


@pytest.mark.parametrize("bits,most", [(10, 1.0), (16, 0.1), (48, 0.0)])
def test_merged_sketches_never_underestimate(bits, most):
    r = np.random.default_rng(2)
    chunks, truth = [], {}
    for c in range(20):
        keys = hashes.mix(r.integers(0, 4000, 500).astype(np.uint64))
        owner = np.sort(r.integers(0, 9, 500)) + 9 * c
        for k, o in zip(keys.tolist(), owner.tolist()):
            truth.setdefault(k, set()).add(o)
        chunks.append((keys, sketch.sketch(owner, keys, bits)))
    n = 5
    blobs = [dict(sketch.send(k, n)) for _, k in chunks]
    answers = [{} for _ in chunks]
    for s in range(n):
        own = [i for i, b in enumerate(blobs) if s in b]
        for i, a in zip(own, sketch.merge([blobs[i][s] for i in own])):
            answers[i][s] = a
    wrong = total = 0
    for (keys, counters), a in zip(chunks, answers):
        for x, found in zip(keys.tolist(), sketch.repeated(keys, counters, bits, n, a)):
            assert found or len(truth[x]) < 2
            wrong, total = wrong + (found and len(truth[x]) < 2), total + 1
    assert wrong <= most * total
    assert not len(sketch.repeated(keys[:0], sketch.sketch(owner[:0], keys[:0], bits), bits, n, {}))


@pytest.mark.parametrize("bits", [10, 16, 48])
def test_no_heavy_key_is_missed(bits):
    r = np.random.default_rng(3)
    chunks, truth, n, limit = [], {}, 5, 20_000
    for c in range(20):
        keys = hashes.mix((r.pareto(0.7, 500) * 10).astype(np.uint64))
        owner, weight = np.sort(r.integers(0, 9, 500)), r.integers(50, 4000, 500)
        for k, w in zip(keys.tolist(), weight.tolist()):
            truth[k] = truth.get(k, 0) + w
        chunks.append((keys, sketch.sketch(owner, keys, bits, weight)))
    blobs = [dict(sketch.send(k, n)) for _, k in chunks]
    answers = [{} for _ in chunks]
    for s in range(n):
        own = [i for i, b in enumerate(blobs) if s in b]
        plain = sketch.merge([blobs[i][s] for i in own])
        for i, a, p in zip(own, sketch.merge([blobs[i][s] for i in own], limit), plain):
            assert a[:len(p)] == p
            answers[i][s] = a
    found = {}
    for (keys, counters), a in zip(chunks, answers):
        for x, y in zip(keys.tolist(), sketch.heavy(keys, counters, bits, n, a).tolist()):
            assert found.setdefault(x, y) == y                          # all chunks agree
    assert all(found[k] for k, w in truth.items() if w > limit) and sum(truth[k] > limit for k in truth) > 3
    if bits == 48:
        assert not any(found[k] for k, w in truth.items() if w < limit / 2)
    assert not len(sketch.heavy(keys[:0], counters[:0], bits, n, {}))


def test_cells_follow_the_text():
    assert sketch.cell_bits(0) == 10 and sketch.cell_bits(4_000_000) == 22 and sketch.cell_bits(10**20) == 48


def test_planes_and_texts_round_trip():
    a = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (common.unplanes(common.planes(a)) == a).all()
    data, offsets = common.texts(pa.array(["é", None, "", "abc"]).slice(1))
    assert data.tobytes() == b"abc" and offsets.tolist() == [0, 0, 0, 3]
