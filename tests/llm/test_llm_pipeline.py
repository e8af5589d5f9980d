"""The pipeline against a composition of the operators' brute-force versions, and its registration."""

import re
import zlib
from collections import Counter

import corpus_pipeline
import __spark_entry__ as E
import test_llm_decontaminate as contamination
import test_llm_mixing as mixing
import test_llm_rules as rules
import test_llm_sharding as sharding
import test_llm_simhash as simhash
from conftest import SF


def junk(text):
    """The rules beyond the base, from their definitions."""
    t = text or ""
    w = rules.WORD.findall(t)
    upper, letters = sum(c.isupper() for c in t), sum(c.isalpha() for c in t)
    lines = [x for x in t.split("\n") if rules.WORD.search(x)]
    return (10 * sum(c in "#*$%&|<>" for c in t) > 3 * len(w) or (upper >= 20 and 2 * upper > letters) or 10 * t.count("!") > 3 * len(w)
            or 10 * sum(a == b for a, b in zip(w, w[1:])) > 3 * len(w) or 2 * (len(lines) - len(set(lines))) > len(lines)
            or sum(map(len, w)) > 30 * len(w))


def without_hits(text, bench):
    wins = {tuple(w[k:k + 10]) for _, t in bench for w in [contamination.words(t)] if w for k in range(max(1, len(w) - 9))}
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    places = [m.span() for m in contamination.WORD.finditer(low)]
    w = [low[a:b] for a, b in places]
    hit = [False] * len(w)
    for n in {len(x) for x in wins}:
        for k in range(len(w) - n + 1):
            if tuple(w[k:k + n]) in wins:
                hit[k:k + n] = [True] * n
    out, at, k = [], 0, 0
    while k < len(w):
        if hit[k]:
            e = k
            while e < len(w) and hit[e]:
                e += 1
            out.append(text[at:places[k][0]])
            at, k = places[e - 1][1], e
        else:
            k += 1
    return None if w and all(hit) else "".join((*out, text[at:]))


def test_run_is_the_composition(spark, documents, benchmark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in documents.collect()]
    rows = [r for r in rows if not rules.brute(r[1])[-1] and not junk(r[1])]
    stay = {d for d, _, least in simhash.brute([r[:2] for r in rows]) if d == least}
    rows = [r for r in rows if r[0] in stay]
    bench = [(r.item_id, r.text) for r in benchmark.collect()]
    rows = [(d, t, x, s) for d, t, x, s in ((r[0], without_hits(r[1], bench), *r[2:]) for r in rows) if t is not None]
    taken = {r[0] for r in mixing.brute(rows, corpus_pipeline.MIX_RATIO, 1, mixing.mixing.SEED) if r[-1]}
    rows = [r for r in rows if r[0] in taken]
    got = corpus_pipeline.run(spark, SF).collect()
    assert 50 < len(rows) < documents.count()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t, _, _ in rows)
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    groups = Counter()
    for _, t, _, _ in rows:
        groups[t] += len(t.encode()) + 16
    assert sorted(loads[s] for s in range(40)) == sharding.plain(groups.values(), 40)


def test_stages_pass_documents_on(spark, documents, odd, none):
    for df in (documents, odd, none):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert set(docs.columns) == set(df.columns)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_all_are_registered():
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
