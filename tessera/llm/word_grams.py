"""Perplexity by interpolated modified Kneser-Ney models of word trigrams, each trusted document scored by a model that
has not seen it.

Trusted documents fall into two parts by a hash of their id, with a model each. Counts go to
shards by the hash of the gram and are merged there; a shard aggregates what it holds before it sends sums of contexts
and counts of shorter grams on, so no word, however common, gathers in one task. To score, every group of chunks asks
the shards for its distinct grams and contexts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import CHUNK_BYTES, bucketed, discard, materialize, n_shards, planes, require, ship_package, shuffles_dropped, sliced, unplanes
from tessera.llm.hashes import among, mix, table
from tessera.llm.kneser_ney import PRIME, _by_shard, _languages

#: Parts of the trusted documents.
PARTS = 2
#: Chunks that ask together. Word grams are rarely shared, so more would only hold more.
GROUP = 2
#: Turns in which grams are counted and asked for, by their last word; only one turn's are in shuffle files at a time.
TURNS = 12
#: Of the session's shards one in so many is used: a turn holds a part of the grams only, and larger messages are smaller in all.
FEWER = 4

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BYTES = table(17)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: The word before a text, the one after it; and what tells pairs of words from single ones.
_PAD, _END, _TWO = (_U(x) for x in (0xB5297A4D3F84D5A7, 0xD1B54A32D192ED03, 0x1B56C4E9A2F3D8C1))
#: Kinds of rows: questions and replies, counts of words, counts of counts, replies on words, trusted ids.
_REPLY, _LOWER, _TALLY, _WORDS, _KNOWN = range(5)
#: Numbers of a pair or word: by part, in how many longer grams it ends; as a context its total, and how many words follow once, twice, more often.
_WIDTH = 5 * PARTS
#: Bits of a word's hash that are not sent where the rest of 48 is compared within one shard or one pair only.
_DROP = 16
_CODED = "chunk long, lang string, docs binary, vocab binary, codes binary"
_SENT = "kind int, lang string, shard int, chunk long, blob binary"
_ARROW = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("shard", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word: what stands between white space, or one character of U+3000 to U+9FFF, which are
    written without spaces; after the last word of a document stands its end."""
    space = _SPACE[data]
    wide = (data >= 0xE3) & (data <= 0xE9)
    begins = np.append(True, space[:-1])[:len(data)] | wide
    begins[3:] |= wide[:-3]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins &= ~space
    at = np.flatnonzero(begins)
    if not len(at):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    place = np.arange(len(data)) - at[np.cumsum(begins) - 1]
    place[space] = 0
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(place.max()) + 1, _BASE, _U))
        value = _BYTES[data] * power[place]
    value[space] = 0
    doc = np.searchsorted(offsets, at, side="right") - 1
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    return np.insert(mix(np.add.reduceat(value, at)), ends, _END), np.insert(doc, ends, doc[ends - 1])


def _left(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def two(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _left(b, 21) ^ c ^ _TWO


def part_of(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).astype(_U)) % _U(PARTS)).astype(np.int64)


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, where each first stands, and sums of the columns by key."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[:len(ranked)])
    return ranked[at], order[at], *[np.add.reduceat(c[order], at) if len(at) else c[:0] for c in columns]


def _cast(columns: list[np.ndarray], n: int, drop: int = 0):
    """(shard, blob) of the rows of columns, the first of which holds the keys; without the lowest ``drop`` bits of these."""
    order, cuts = _by_shard(columns[0], n)
    for s in range(n):
        pick = order[cuts[s]:cuts[s + 1]]
        if len(pick):
            yield s, _pressed(planes(columns[0][pick] >> _U(drop)) + b"".join(planes(c[pick].astype(_U)) for c in columns[1:]))


def _columns(blobs, k: int) -> list[np.ndarray]:
    parts = [[unplanes(b[i * len(b) // k:(i + 1) * len(b) // k]) for i in range(k)] for b in map(_opened, blobs)]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, _U) for i in range(k)]


def _unknown_first(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words from the most frequent on, from 1 on the code of each); code 0 is for words that no model knows."""
    own, code, count = np.unique(found, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(1, len(own) + 1)
    return np.append(_U(0), own[order]), rank[code]


def coded(docs: DataFrame, limit: int) -> DataFrame:
    """(chunk long, lang string, docs binary, vocab binary, codes binary): each language of a run of rows (id, lang, text) of at
    most ``limit`` text bytes, its words numbered: a text is cut into words just once."""
    def pack(batches):
        from pyspark import TaskContext
        base, k = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list] = {}
        size = 0

        def out():
            for lang, pieces in held.items():
                table = pa.concat_tables([p[0] for p in pieces])
                vocab, codes = _unknown_first(np.concatenate([p[1] for p in pieces]))
                yield _row(base + k, lang, table, vocab, codes)

        for piece in sliced(batches, "text", min(limit, CHUNK_BYTES)):
            n = int(pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0)
            if held and size + n > limit:
                yield from out()
                held, size, k = {}, 0, k + 1
            for lang, rows, data, offsets in _languages(piece):
                found, doc = words(data, offsets)
                table = pa.table({"id": piece.column(0).take(pa.array(rows)), "lang": piece.column(1).take(pa.array(rows)), "n_bytes": np.diff(offsets),
                                  "n_words": np.bincount(doc, minlength=len(rows)), "part": np.full(len(rows), PARTS, np.int8)})
                held.setdefault(lang, []).append((table, found))
            size += n
        yield from out()

    return docs.select("id", "lang", "text").mapInArrow(pack, _CODED)


def _row(chunk: int, lang: str, table: pa.Table, vocab: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table.combine_chunks())
    blobs = [sink.getvalue().to_pybytes(), _pressed(planes(vocab)), _pressed(planes(codes.astype(np.uint32)))]
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([lang]), *[pa.array([b], pa.binary()) for b in blobs]], ["chunk", "lang", "docs", "vocab", "codes"])


def _rows(own):
    """(chunk, language, documents, words by code, codes) of coded rows, as pandas."""
    for chunk, lang, docs, vocab, codes in zip(own["chunk"], own["lang"], own["docs"], own["vocab"], own["codes"]):
        yield chunk, lang, pa.ipc.open_stream(pa.py_buffer(docs)).read_all(), unplanes(_opened(vocab)), unplanes(_opened(codes), np.uint32).astype(np.int64)


def _parts(table: pa.Table, known: np.ndarray) -> np.ndarray:
    """The part of each trusted document, ``PARTS`` for all others."""
    ids = table["id"].fill_null(0).to_numpy()
    return np.where(np.isin(ids, known) & ~table["id"].is_null().to_numpy(), part_of(ids), PARTS)


def _known(trusted) -> np.ndarray:
    return np.unique(np.concatenate([np.asarray(x, np.int64) for x in trusted["ids"]])) if len(trusted) else np.zeros(0, np.int64)


def _frame(out: list[tuple]):
    import pandas as pd
    return pd.DataFrame(out, columns=["kind", "lang", "shard", "chunk", "blob"])


def _send_words(own, trusted, n: int):
    """All words of a chunk, and which of them stand in its trusted documents."""
    out, known = [], _known(trusted)
    for chunk, lang, table, vocab, codes in _rows(own):
        good = np.zeros(len(vocab), _U)
        good[codes[np.repeat(_parts(table, known) < PARTS, table["n_words"].to_numpy())]] = 1
        out.extend((_REPLY, lang, s, chunk, blob) for s, blob in _cast([vocab[1:], good[1:]], n))
    return _frame(out)


def _answer_words(pdf):
    """Which words stand in any trusted document."""
    asked = [_columns([b], 2) for b in pdf["blob"]]
    seen = np.unique(np.concatenate([w[good == 1] for w, good in asked]))
    return _frame([(_REPLY, lang, s, chunk, np.packbits(among(w, seen)).tobytes())
                   for lang, s, chunk, (w, _) in zip(pdf["lang"], pdf["shard"], pdf["chunk"], asked)])


def _recode(own, replies, trusted, n: int):
    """The chunk with its parts, and with one code for all words that no trusted document has: no gram with one is ever found."""
    import pandas as pd
    known, out = _known(trusted), []
    for chunk, lang, table, vocab, codes in _rows(own):
        order, cuts = _by_shard(vocab[1:], n)
        mine = replies[replies["lang"] == lang]
        got, seen = dict(zip(mine["shard"], mine["blob"])), np.zeros(len(vocab), bool)
        for s in range(n):
            pick = order[cuts[s]:cuts[s + 1]]
            if len(pick):
                seen[1 + pick] = np.unpackbits(np.frombuffer(got[s], np.uint8), count=len(pick)).astype(bool)
        table = table.set_column(table.schema.get_field_index("part"), "part", pa.array(_parts(table, known).astype(np.int8)))
        out.append(_row(chunk, lang, table, np.append(_U(0), vocab[seen]), np.where(seen, np.cumsum(seen), 0)[codes]))
    return pa.Table.from_batches(out).to_pandas() if out else pd.DataFrame(columns=["chunk", "lang", "docs", "vocab", "codes"])


def _padded(table: pa.Table, vocab: np.ndarray, codes: np.ndarray):
    """(words by code, the last the one before texts; codes with two of it before each text; place of each word; place in its text; part) of all places."""
    n_words = table["n_words"].to_numpy()
    there = np.flatnonzero(n_words)
    wide = n_words[there] + 2
    begin = np.cumsum(wide) - wide
    within = np.arange(wide.sum()) - np.repeat(begin, wide)
    line = np.full(len(within), len(vocab), np.int64)
    at = np.flatnonzero(within > 1)
    line[at] = codes
    return np.append(vocab, _PAD), line, at, within, np.repeat(table["part"].to_numpy()[there], wide)


def _pairs(vocab: np.ndarray, line: np.ndarray, within: np.ndarray, turn: int, n: int):
    """Of the pairs of known words whose last word has its turn: (where they end, number of each pair in the order of shards, first
    and last code of each pair, key of each, where each shard begins; then of the triples ending there: place among the ends, number; (pair, first code) of each)."""
    turns = (mix(vocab) >> _U(32)) % _U(TURNS) == _U(turn)
    turns[0] = False
    ends = np.flatnonzero(turns[line] & (within > 0))
    ends = ends[line[ends - 1] > 0]
    size = len(vocab)
    own, number = np.unique(line[ends - 1] * size + line[ends], return_inverse=True)
    first, last = own // size, own % size
    keys = two(vocab[first], vocab[last])
    shard = (keys % _U(PRIME) % _U(n)).astype(np.int64)
    order = np.argsort(keys)
    order = order[np.argsort(shard[order].astype(np.uint16) if n < 1 << 16 else shard[order], kind="stable")]      # by shard, then key
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number, first, last, keys = rank[number], first[order], last[order], keys[order]
    cuts = np.searchsorted(shard[order], np.arange(n + 1))
    longer = np.flatnonzero((within[ends] > 1) & (line[ends - 2] > 0))
    triples, which = np.unique(number[longer] * size + line[ends[longer] - 2], return_inverse=True)
    return ends, number, first, last, keys, cuts, longer, which, triples // size, triples % size


def _listed(pair: np.ndarray, word: np.ndarray, counts: list[np.ndarray], a: int, b: int) -> list[bytes]:
    """What belongs to pairs ``a`` to ``b``: how many entries each has, 48 bits of the other word's hash, counts by part."""
    lo, hi = np.searchsorted(pair, [a, b])
    lengths = np.bincount(pair[lo:hi] - a, minlength=b - a)
    return [planes(lengths.astype(np.uint32)), planes(word[lo:hi] >> _U(_DROP)), *[planes(c[lo:hi].astype(np.uint32)) for c in counts]]


def _send(own, turn: int, n: int):
    out = []
    for chunk, lang, table, vocab, codes in _rows(own):
        vocab, line, _, within, part = _padded(table, vocab, codes)
        ends, number, first, _, keys, cuts, longer, which, pair3, word3 = _pairs(vocab, line, within, turn, n)
        counts = [np.bincount(which[part[ends[longer]] == p], minlength=len(pair3)) for p in range(PARTS)]
        trusted = np.bincount(pair3, sum(counts), minlength=len(keys)) > 0
        mid = np.flatnonzero(part[ends] < PARTS)
        mid = mid[np.append(within, 0)[ends[mid] + 1] > within[ends[mid]]]                    # a word follows in the same text
        nexts, which = np.unique(number[mid] * len(vocab) + line[ends[mid] + 1], return_inverse=True)
        follow = [np.bincount(which[part[ends[mid]] == p], minlength=len(nexts)) for p in range(PARTS)]
        for s in range(n):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                blobs = [planes(keys[a:b]), np.packbits(trusted[a:b]).tobytes(), planes(vocab[first[a:b][trusted[a:b]]]),
                         *_listed(pair3, vocab[word3], counts, a, b), *_listed(nexts // len(vocab), vocab[nexts % len(vocab)], follow, a, b)]
                out.append((_REPLY, lang, s, chunk, _joined(blobs)))
    return _frame(out)


def _pressed(blob: bytes) -> bytes:
    return np.array([len(blob)], "<u4").tobytes() + pa.Codec("zstd", 3).compress(blob, asbytes=True)


def _opened(blob: bytes) -> bytes:
    return pa.Codec("zstd", 3).decompress(blob[4:], int(np.frombuffer(blob, "<u4", 1)[0]), asbytes=True)


def _joined(blobs: list[bytes]) -> bytes:
    return _pressed(np.array([len(blobs), *map(len, blobs)], "<u4").tobytes() + b"".join(blobs))


def _split(blob: bytes) -> list[bytes]:
    blob = _opened(blob)
    k = int(np.frombuffer(blob, "<u4", 1)[0])
    ends = 4 * (k + 1) + np.cumsum(np.append(0, np.frombuffer(blob, "<u4", k, 4).astype(np.int64)))
    return [blob[a:b] for a, b in zip(ends, ends[1:])]


def _sparse(columns: list[np.ndarray]) -> list[bytes]:
    """Which rows have a number that is not zero, and these rows."""
    some = np.any(columns, axis=0)
    return [np.packbits(some).tobytes(), planes(np.concatenate([c[some] for c in columns]).astype(np.uint32))]


def _full(bits: bytes, blob: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of ``_sparse``: (rows, their numbers)."""
    some = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8)))
    return some, unplanes(blob, np.uint32).reshape(k, len(some))


def _classes(counts: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """By owner: the sum of counts, and how many are one, two, more."""
    return [np.bincount(owner, counts, minlength=n), *[np.bincount(owner[x], minlength=n) for x in (counts == 1, counts == 2, counts > 2)]]


def _tally(counts: np.ndarray) -> list[int]:
    """Counts of counts, how many there are, and their sum."""
    return [*[int((counts == i).sum()) for i in range(1, 5)], int((counts > 0).sum()), int(counts.sum())]


def _answer(pdf, n: int):
    """Counts of all grams asked for, what trusted pairs add to their words, and counts of counts."""
    parsed = [_split(b) for b in pdf["blob"]]
    asked = [unplanes(p[0]) for p in parsed]
    sizes = [len(x) for x in asked]
    keys, number = np.unique(np.concatenate(asked), return_inverse=True)
    before = np.cumsum([0, *sizes])

    def merged(i):
        """(entries a message, group of each entry, pair of each group, counts of each group by part)."""
        lengths = np.concatenate([unplanes(p[i], np.uint32) for p in parsed]).astype(np.int64)
        pair = np.repeat(number, lengths)
        _, at, group = np.unique(mix(keys[pair]) ^ _left(np.concatenate([unplanes(p[i + 1]) for p in parsed]), 11), return_index=True, return_inverse=True)
        counts = [np.bincount(group, np.concatenate([unplanes(p[i + 2 + k], np.uint32) for p in parsed]), minlength=len(at)) for k in range(PARTS)]
        return [len(p[i + 1]) // 8 for p in parsed], group, pair[at], counts

    own, group, pair, counts = merged(3)
    _, _, follows, nexts = merged(3 + 2 + PARTS)
    types = [np.bincount(pair[c > 0], minlength=len(keys)) for c in counts]
    contexts = [_classes(c[c > 0], follows[c > 0], len(keys)) for c in nexts]
    lang, shard = pdf["lang"].iloc[0], int(pdf["shard"].iloc[0])
    out, start = [], 0
    for k, (chunk, size) in enumerate(zip(pdf["chunk"], own)):
        mine, entries = number[before[k]:before[k + 1]], group[start:start + size]
        start += size
        columns = [x[mine] for t, c in zip(types, contexts) for x in (t, *c)]
        out.append((_REPLY, lang, shard, chunk, _joined([*_sparse([c[entries] for c in counts]), *_sparse(columns)])))
    trusted = [np.unpackbits(np.frombuffer(p[1], np.uint8), count=m).astype(bool) for p, m in zip(parsed, sizes)]
    first = np.zeros(len(keys), _U)
    first[number[np.concatenate(trusted)]] = np.concatenate([unplanes(p[2]) for p in parsed])
    used = np.flatnonzero(sum(types))
    b, c = first[used], keys[used] ^ _TWO ^ _left(first[used], 21)
    both, place = np.unique(np.concatenate((b, c)), return_inverse=True)
    at_b, at_c, columns = place[:len(b)], place[len(b):], []
    for t in types:
        t = t[used]
        columns += [np.bincount(at_c[t > 0], minlength=len(both)), *_classes(t[t > 0], at_b[t > 0], len(both))]
    out.extend((_LOWER, lang, s, 0, blob) for s, blob in _cast([both, *columns], n, _DROP))
    tally = np.array([[_tally(c), _tally(t)] for c, t in zip(counts, types)], _U)
    out.append((_TALLY, lang, 0, 0, tally.tobytes()))
    return _frame(out)


def _merge(pdf):
    """Replies as they are; words and counts of counts added up."""
    kind, lang, shard = int(pdf["kind"].iloc[0]), pdf["lang"].iloc[0], int(pdf["shard"].iloc[0])
    if kind == _REPLY:
        return pdf
    if kind == _TALLY:
        return _frame([(kind, lang, shard, 0, sum(np.frombuffer(b, _U) for b in pdf["blob"]).tobytes())])
    columns = _columns(pdf["blob"], _WIDTH + 1)
    keys, _, *sums = _summed(columns[0], *columns[1:])
    return _frame([(kind, lang, shard, 0, _pressed(b"".join(planes(c) for c in (keys, *sums))))])


def _send_vocab(own, n: int):
    """The known words of a chunk, and the one before texts."""
    out = []
    for chunk, lang, vocab in zip(own["chunk"], own["lang"], own["vocab"]):
        out.extend((_REPLY, lang, s, chunk, blob) for s, blob in _cast([np.append(unplanes(_opened(vocab))[1:], _PAD)], n))
    return _frame(out)


def _answer_vocab(pdf):
    """What a word counts as a gram and as a context, and counts of counts of words."""
    lower = pdf[pdf["kind"] == _LOWER]
    columns = _columns(lower["blob"], _WIDTH + 1)
    keys, _, *sums = _summed(columns[0], *columns[1:])
    out = []
    for kind, lang, s, chunk, blob in zip(pdf["kind"], pdf["lang"], pdf["shard"], pdf["chunk"], pdf["blob"]):
        if kind == _REPLY:
            want = unplanes(_opened(blob)) >> _U(_DROP)
            hit, at = among(want, keys), np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0))
            out.append((_WORDS, lang, s, chunk, _pressed(b"".join(planes(np.where(hit, c[at] if len(c) else 0, 0).astype(_U)) for c in sums))))
    if len(keys):
        out.append((_TALLY, pdf["lang"].iloc[0], 0, 0, np.array([_tally(sums[p * _WIDTH // PARTS]) for p in range(PARTS)], _U).tobytes()))
    return _frame(out)


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of modified Kneser-Ney for counts of one, two, and more; what the counts of counts do not determine is half the class."""
    y, k = n1 / (n1 + 2 * n2) if n1 + n2 else 0, (n1, n2, n3, n4)
    rate = [i - (i + 1) * y * k[i] / k[i - 1] if k[i - 1] and k[i] else 0 for i in (1, 2, 3)]
    return [r if r > 0 else i / 2 for i, r in zip((1, 2, 3), rate)]


def _short(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float32).astype(np.float64)


def _less(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return _short(np.where(counts > 0, counts - np.array([0, *d])[np.minimum(counts, 3).astype(np.int64)], 0))


def _context(classes: np.ndarray, d: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(total, back-off weight) of contexts."""
    return _short(classes[0]), _short(sum(x * y for x, y in zip(d, classes[1:])) / np.maximum(classes[0], 1))


def _score(own, replies, n: int, rates, id_col: str):
    import pandas as pd
    frames = []
    for _, lang, table, vocab, codes in _rows(own):
        mine = replies[replies["lang"] == lang]
        vocab, line, at, within, _ = _padded(table, vocab, codes)
        got = dict(zip(zip(mine["kind"], mine["turn"], mine["shard"]), mine["blob"]))
        grams, pairs, single = np.zeros((PARTS, len(line)), np.uint32), np.zeros((_WIDTH, len(line)), np.uint32), np.zeros((_WIDTH, len(vocab)))
        order, cuts = _by_shard(vocab[1:], n)
        for s in range(n):
            pick = order[cuts[s]:cuts[s + 1]]
            if len(pick):
                single[:, 1 + pick] = _columns([got[_WORDS, TURNS, s]], _WIDTH)
        for turn in range(TURNS):
            ends, number, *_, bounds, longer, which, pair3, _ = _pairs(vocab, line, within, turn, n)
            high, low, begins = np.zeros((PARTS, len(pair3)), np.uint32), np.zeros((_WIDTH, bounds[-1]), np.uint32), np.searchsorted(pair3, bounds)
            for s in range(n):
                if bounds[s] < bounds[s + 1]:
                    bits3, numbers3, bits2, numbers2 = _split(got[_REPLY, turn, s])
                    for to, begin, bits, numbers in ((high, begins[s], bits3, numbers3), (low, bounds[s], bits2, numbers2)):
                        some, columns = _full(bits, numbers, len(to))
                        to[:, begin + some] = columns
            grams[:, ends[longer]] = high[:, which]
            pairs[:, ends] = low[:, number]
        ids, null, part = table["id"].fill_null(0).to_numpy(), table["id"].is_null().to_numpy(), table["part"].to_numpy()
        n_words = table["n_words"].to_numpy()
        doc = np.repeat(np.arange(len(ids)), n_words)
        by_part, wide = [], _WIDTH // PARTS
        for p in range(PARTS):
            if (lang, p) not in rates:                                  # decided by the whole table, not by this group's replies
                by_part.append(np.full(len(ids), np.nan))
                continue
            d, (*classes, total, types) = rates[lang, p]
            prob = np.full(len(at), 1 / (types + 1))
            own2, own1 = pairs[p * wide:(p + 1) * wide], single[p * wide:(p + 1) * wide]
            t1, w1 = _context(np.array([total, *classes], float)[:, None], d[1])
            t2, w2 = _context(own1[1:], d[2])
            t3, w3 = _context(own2[1:], d[3])
            last, before = line[at], line[at - 1]
            for gram, t, w in ((_less(own1[0], d[1])[last], np.repeat(t1, len(at)), np.repeat(w1, len(at))), (_less(own2[0], d[2])[at], t2[before], w2[before]), (_less(grams[p], d[3])[at], t3[at - 1], w3[at - 1])):
                prob = np.where(t > 0, gram / np.maximum(t, 1) + w * prob, prob)
            by_part.append(np.where(part == p, np.nan, np.bincount(doc, -np.log(prob), minlength=len(ids)) / np.where(n_words, n_words, np.nan)))   # not by the model that has seen it
        there = [~np.isnan(x) for x in by_part]
        some = sum(t.astype(int) for t in there)
        mean = sum(np.where(t, x, 0) for t, x in zip(there, by_part)) / np.where(some, some, np.nan)
        frames.append(pd.DataFrame({id_col: pd.array(np.where(null, None, ids.astype(object)), "Int64"), "lang": pd.Series(table["lang"].to_pylist(), dtype=object),
                                    "n_bytes": table["n_bytes"].to_numpy(), "nll": pd.Series(mean).astype("Float64").where(~np.isnan(mean))}))
    return pd.concat(frames) if frames else pd.DataFrame(columns=[id_col, "lang", "n_bytes", "nll"])


def perplexities(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id long, lang, n_bytes long, nll double) of every row: mean negative log-probability a word, the end of the text being one more.

    A trusted document is scored by the model of the other part, every other document by both (the mean). A word that
    a model has not seen has the share of one word beside all it has seen. Null where the text is null or has no word, or
    where no model of the language is left to score by. A null language is the empty one. Null ids are never trusted; repeated rows are
    scored each; an empty table gives an empty result; other columns are not read.
    """
    require(docs, id_col, text_col, lang_col)
    require(trusted, id_col)
    spark = docs.sparkSession
    ship_package(spark)
    buckets = n_shards(spark)
    n = -(-buckets // FEWER)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def ids(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = pa.ipc.open_stream(pa.py_buffer(blob)).read_all().column("id").combine_chunks()
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(own), pa.int64()), own], ["chunk", "id"])

    def sending(work):
        def run(batches):
            for b in batches:
                for i in range(b.num_rows):                             # one chunk and language at a time
                    yield pa.RecordBatch.from_pandas(work(b.slice(i, 1).to_pandas()), schema=_ARROW, preserve_index=False)
        return run

    def turn_of(i):
        return lambda own: _send(own, i, n)

    def both(own, other):
        return _recode(own, other[other["kind"] == _REPLY], other[other["kind"] == _KNOWN], n)

    with shuffles_dropped(spark):
        raw = bucketed(coded(rows, GROUP * chunk_bytes), "chunk", buckets, "words")
        good = trusted.select(F.col(id_col).cast("long").alias("id")).where("id is not null").distinct()
        known = materialize(raw.select("chunk", "docs").mapInArrow(ids, "chunk long, id long").join(good, "id").groupBy("chunk").agg(F.collect_list("id").alias("ids")), spark, "known")
        sent = raw.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInPandas(lambda own, ids: _send_words(own, ids, n), _SENT)
        seen = materialize(sent.groupBy("lang", "shard").applyInPandas(_answer_words, _SENT), spark, "seen")
        other = seen.withColumn("ids", F.lit(None).cast("array<bigint>")).unionByName(known.withColumn("kind", F.lit(_KNOWN)), allowMissingColumns=True)
        packed = bucketed(raw.groupBy("chunk").cogroup(other.groupBy("chunk")).applyInPandas(both, _CODED), "chunk", buckets, "chunks")
        discard(raw)
        turns = []
        for i in range(TURNS):
            sent = packed.mapInArrow(sending(turn_of(i)), _SENT)
            answered = sent.groupBy("lang", "shard").applyInPandas(lambda pdf: _answer(pdf, n), _SENT)
            turns.append(materialize(answered.groupBy("kind", "lang", "shard").applyInPandas(_merge, _SENT), spark, f"turn{i}").withColumn("turn", F.lit(i)))
        every = reduce(DataFrame.unionByName, turns)
        sent = packed.select("chunk", "lang", "vocab").mapInArrow(sending(lambda own: _send_vocab(own, n)), _SENT)
        lower = every.where(F.col("kind") == _LOWER).drop("turn").unionByName(sent)
        single = materialize(lower.groupBy("lang", "shard").applyInPandas(_answer_vocab, _SENT), spark, "single").withColumn("turn", F.lit(TURNS))
        tallies: dict[tuple[str, int], np.ndarray] = {}
        for r in every.unionByName(single).where(F.col("kind") == _TALLY).select("lang", "turn", "blob").toLocalIterator():     # a few numbers a language and shard
            for p, own in enumerate(np.frombuffer(r["blob"], _U).reshape(PARTS, -1, 6).astype(np.int64)):
                sums = tallies.setdefault((r["lang"], p), np.zeros((3, 6), np.int64))
                sums[[2, 1] if r["turn"] < TURNS else [0]] += own
        rates = {k: ({i + 1: discounts(*map(int, t[i, :4])) for i in range(3)},
                     (int(t[0, 0]), int(t[0, 1]), int(t[0, 4] - t[0, 0] - t[0, 1]), int(t[0, 5]), int(t[0, 4]))) for k, t in tallies.items() if t[0, 4]}
        replies = every.unionByName(single).where(F.col("kind").isin(_REPLY, _WORDS))
        found = packed.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(
            lambda own, replies: _score(own, replies, n, rates, id_col), f"`{id_col}` long, lang string, n_bytes long, nll double")
        return materialize(found, spark, "scored")
