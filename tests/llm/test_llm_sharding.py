"""LPT against a plain heap over single groups."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from tessera.llm import sharding


def plain(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_classes_give_the_loads_of_dealing_one_by_one(shards):
    r = random.Random(shards)
    sizes = [r.choice([17, 18, 40, 1000, r.randrange(1, 5000)]) for _ in range(3000)] + [10**6, 7 * 10**5] + [16] * 5000
    loads, seen = Counter(), defaultdict(list)
    for size, first, end, s in sharding.assign_classes(sorted(Counter(sizes).items(), reverse=True), shards):
        loads[s] += size * (end - first)
        seen[size].append((first, end))
    assert sorted(loads.values()) == plain(sizes, shards)
    for size, n in Counter(sizes).items():
        runs = sorted(seen[size])
        assert runs[0][0] == 0 and runs[-1][1] == n and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))


def check(df, shards):
    rows = sharding.shard(df, shards).collect()
    docs = df.collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs)
    assert {(r.law, r.grown_shard) for r in rows} <= {("bytes", None)}
    slots, loads = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for r in docs:
        groups[r.text] += len((r.text or "").encode()) + 16
    full = [loads[s] for s in range(shards)]
    assert sorted(full) == plain(groups.values(), shards)
    where = defaultdict(set)
    for r in rows:
        if r.doc_id is not None and Counter(d.doc_id for d in docs)[r.doc_id] == 1:
            where[next(d.text for d in docs if d.doc_id == r.doc_id)].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_documents(documents):
    check(documents, 7)


def test_odd_rows(odd, none):
    check(odd, 5)
    check(none, 5)
