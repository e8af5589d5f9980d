"""Personal data: base patterns, and further spans chosen by gradient-boosted trees.

Generators of high recall propose spans that may overlap. Every candidate has
features of its format and of its context; boosted trees, trained on the
driver from a bounded sample, give it a score. What a candidate is worth is told by its own format,
whether or not a base pattern takes it: an address once signs written out are put back, four octets, Luhn's check, a
number grouped as telephone numbers are. Of each kind those above a threshold, calibrated on the candidates of all rows,
are added where no base span lies. All work on rows is DataFrame expressions: spans, features and trees are Columns over
arrays within a row; only counts by cells of the score are shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import require
from tessera.llm.rules import let

KINDS = ("email", "ip", "card", "phone")
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_EMAIL_CHARS = "[A-Za-z0-9._%+-]"
#: Leftmost matches as of the plain patterns, but linear on long runs: a match can only begin where a run does or
#: where the last match ended, and repeated parts are possessive.
BASE = {
    "email": rf"(?:(?<!{_EMAIL_CHARS})|\G){_EMAIL_CHARS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates of each kind.
LOOSE = {
    "email": rf"(?i)(?:(?<!{_EMAIL_CHARS})|\G){_EMAIL_CHARS}++(?:@|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\x20?\.\x20?[0-9]++){3}",
    "card": r"[0-9](?:[\x20./_-]{0,2}[0-9])++",
    "phone": r"[+(]?[0-9](?:[\x20()./-]{0,2}[0-9])++",
}
#: A text without this has no candidate of the kind (cards have 13 digits at least, telephone numbers 9).
NEEDS = {"email": r"(?i)@|[(\[]at[)\]]|\x20at\x20[a-z0-9-]+(?:\x20dot\x20|\x20?[(\[]dot[)\]]|\.[a-z0-9-])", "ip": r"[0-9]\x20?\.\x20?[0-9]",
         "card": r"[0-9](?:[\x20./_-]{0,2}[0-9]){12}", "phone": r"[0-9](?:[\x20()./-]{0,2}[0-9]){8}"}
#: The same for the base patterns.
BASE_NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: Last parts of addresses whose signs are written as bare words; other words follow "at" and "dot" in plain text. Fixed values.
ENDINGS = "com|org|net|edu|gov|int|info|biz|io|eu|uk|de|fr|es|it|nl|ch|at|pl|se|jp|cn|in|br|ru|us|ca|au"
#: Context words, one feature each.
CONTEXT = {"mail": r"(?i)mail|contact|write", "tel": r"(?i)tel|phone|call|fax|mobile", "pay": r"(?i)card|visa|credit|pay|account", "net": r"(?i)\bip\b|host|server|addr"}
FEATURES = ("kind", "length", "digits", "others", "groups", "longest", "plus", "brackets", "at", "dots", "luhn", "octets", "bare", "ending", *CONTEXT, "after_word", "before_word")
#: Rows sampled for training, at most half of all, and the distinct labelled feature vectors of them that the driver takes.
SAMPLE_ROWS, SAMPLE_VECTORS = 20_000, 50_000
TREES, DEPTH, RATE = 24, 3, 0.3
#: Share of true candidates that every cell of the score must reach from the threshold up.
PRECISION = 0.995
#: Cells of the score are 1 / CELL wide, from -EDGE to EDGE.
CELL, EDGE = 16, 8
_BLOCK = 256


def _starts(lens: Column) -> Column:
    """Sums of all earlier elements, block by block, so that long arrays stay far from a square."""
    n = F.size(lens)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    upto = lambda a: F.aggregate(a, F.array(F.lit(0).cast("long")), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    block = lambda b: F.slice(lens, b * _BLOCK + 1, _BLOCK)
    return let(upto(F.transform(blocks, lambda b: total(block(b)))), lambda base: F.flatten(F.transform(
        blocks, lambda b: F.transform(F.slice(upto(block(b)), 1, F.size(block(b))), lambda x: x + F.get(base, b)))))


_SPAN = "array<struct<first:long,end:long,match:string,before:string,after:string>>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """Array of (first, end, match, before, after) of the leftmost non-overlapping matches; places are code points."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(p: Column) -> Column:
        pieces, found = p["pieces"], p["found"]
        lens = F.transform(found, lambda m, i: (F.char_length(F.get(pieces, i)) + F.char_length(m)).cast("long"))

        def spans(starts: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                before = F.get(pieces, i)
                first = F.get(starts, i) + F.char_length(before)
                return F.struct(first.cast("long").alias("first"), (first + F.char_length(m)).cast("long").alias("end"), m.alias("match"),
                                F.substring(before, F.greatest(F.char_length(before) - 23, F.lit(1)), F.lit(24)).alias("before"),
                                F.substring(F.get(pieces, i + 1), 1, 1).alias("after"))
            return F.transform(found, one)
        return F.when(F.size(found) > 0, let(_starts(lens), spans)).otherwise(F.array().cast(_SPAN))

    pair = F.struct(pieces.alias("pieces"), found.alias("found"))
    return F.when(text.rlike(needs), let(pair, placed)).otherwise(F.array().cast(_SPAN))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of 13 to 19 digits passes the check."""
    def total(d: Column) -> Column:
        n = F.char_length(d)

        def add(s: Column, i: Column) -> Column:
            v = F.substring(d, i, F.lit(1)).cast("int")
            return s + F.when((n - i) % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when(F.char_length(digits).between(13, 19), let(digits, total) % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return luhn(_digits(m))
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind], BASE_NEEDS[kind]), lambda s: _valid(kind, s["match"]))


def candidates(text: Column, kind: str) -> Column:
    bounds = {"card": (13, 19), "phone": (9, 15)}
    found = matches(text, LOOSE[kind], NEEDS[kind])
    if kind in bounds:
        return F.filter(found, lambda s: F.char_length(_digits(s["match"])).between(*bounds[kind]))
    return found


def genuine(kind: str, s: Column) -> Column:
    """Whether a candidate is what its kind says, by its format and the characters beside it."""
    m = s["match"]
    digits, runs = _digits(m), F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), F.char_length)
    alone = ~s["before"].rlike(r"[\p{L}\p{N}@._-]$") & ~s["after"].rlike(r"[\p{L}\p{N}@_]")
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(m, r"(?i)\x20?[(\[]at[)\]]\x20?|\x20at\x20", "@"), r"(?i)\x20?[(\[]dot[)\]]\x20?|\x20dot\x20", ".")
        address = (F.char_length(m) <= 254) & plain.rlike(rf"^{_EMAIL_CHARS}++@(?:[A-Za-z0-9][A-Za-z0-9-]*+\.)++[A-Za-z]{{2,24}}$")
        return address & (~m.rlike(r"(?i)\x20at\x20") | m.rlike(rf"(?i)\x20dot\x20(?:{ENDINGS})$"))
    if kind == "ip":
        return alone & F.replace(m, F.lit(" "), F.lit("")).rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return alone & luhn(digits) & (F.array_min(runs) >= 2)
    grouped = F.size(runs).between(3, 6) & (F.array_max(runs) >= 3) & (F.array_min(runs) >= 2)
    signed = m.rlike(r"^(?:\+|\(|00)") & (F.size(runs) <= 8)
    return alone & F.char_length(digits).between(9, 15) & ~luhn(digits) & (signed | (grouped & (F.array_max(runs) <= 8)))


def features(kind: str, s: Column) -> dict[str, Column]:
    """Format and context of a candidate, as integers."""
    m = s["match"]
    digits = _digits(m)
    runs = F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))
    flag = lambda c: F.when(c, 1).otherwise(0)
    out = {"kind": F.lit(KINDS.index(kind)), "length": F.least(F.char_length(m), F.lit(99)), "digits": F.least(F.char_length(digits), F.lit(99)),
           "others": F.least(F.char_length(m) - F.char_length(digits), F.lit(99)), "groups": F.least(F.size(runs), F.lit(99)),
           "longest": F.coalesce(F.least(F.array_max(F.transform(runs, lambda r: F.char_length(r))), F.lit(99)), F.lit(0)),
           "plus": flag(m.startswith("+")), "brackets": flag(m.rlike(r"[()\[\]]")), "at": flag(m.contains("@")),
           "dots": F.least(F.char_length(m) - F.char_length(F.replace(m, F.lit("."), F.lit(""))), F.lit(99)),
           "luhn": flag(luhn(digits)), "octets": flag(m.rlike(rf"^{_OCTET}(?:\x20?\.\x20?{_OCTET}){{3}}$"))}
    out |= {"bare": flag(m.rlike(r"(?i)\x20at\x20")), "ending": flag(m.rlike(rf"(?i)\x20dot\x20(?:{ENDINGS})$"))}
    out |= {k: flag(s["before"].rlike(p)) for k, p in CONTEXT.items()}
    out |= {"after_word": flag(s["after"].rlike(r"[\p{L}\p{N}@.]")), "before_word": flag(s["before"].rlike(r"[\p{L}\p{N}@.]$"))}
    return {k: out[k].cast("int") for k in FEATURES}


# Boosted trees ----------------------------------------------------------------
@dataclass(frozen=True)
class Node:
    """A split (feature at most ``limit`` goes left) or, without a feature, a leaf's value."""
    value: float = 0.0
    feature: int | None = None
    limit: int = 0
    left: Node | None = None
    right: Node | None = None


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, w: np.ndarray, depth: int) -> Node:
    """A tree by second-order gains; ``x`` holds small integers, so every split is tried on histograms."""
    leaf = Node(float(g.sum() / (h.sum() + 1.0)))
    if not depth or w.sum() < 20:
        return leaf
    best, whole = (1e-6, None, 0), g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        gs, hs = np.cumsum(np.bincount(x[:, f], g)), np.cumsum(np.bincount(x[:, f], h))
        if len(gs) > 1:
            gain = gs[:-1] ** 2 / (hs[:-1] + 1.0) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1.0) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = (float(gain[k]), f, k)
    if best[1] is None:
        return leaf
    _, f, k = best
    left = x[:, f] <= k
    return Node(0.0, f, k, *(_grow(x[i], g[i], h[i], w[i], depth - 1) for i in (left, ~left)))


def _apply(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.feature is None:
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.limit, _apply(tree.left, x), _apply(tree.right, x))


@dataclass(frozen=True)
class Boosted:
    """Log-odds ``start`` plus ``RATE`` times the trees, and the score from which candidates of a kind are taken."""
    start: float
    trees: tuple[Node, ...]
    thresholds: dict[str, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.start + RATE * sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Boosted:
    """Logistic boosting on vectors ``x`` with labels ``y``, each met ``w`` times. There are no thresholds yet."""
    w = np.ones(len(y)) if w is None else w.astype(np.float64)
    rate = min(max(float((w * y).sum() / w.sum()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    start, trees = math.log(rate / (1 - rate)), []
    score = np.full(len(y), start)
    for _ in range(TREES if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        trees.append(_grow(x, w * (y - p), w * p * (1 - p), w, DEPTH))
        score = score + RATE * _apply(trees[-1], x)
    return Boosted(start, tuple(trees), {})


def thresholds(cells: list[tuple[str, int, int, int]]) -> dict[str, float]:
    """By kind, from (kind, cell, candidates, true ones): the lower edge of the last cell, from the highest down, before one
    that falls short of ``PRECISION``. A kind without a candidate, or whose highest cell falls short, has infinity."""
    out = {kind: math.inf for kind in KINDS}
    for kind in KINDS:
        for _, cell, n, true in sorted((c for c in cells if c[0] == kind), key=lambda c: -c[1]):
            if true < PRECISION * n:
                break
            out[kind] = cell / CELL
    return out


def _overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["first"] < s["end"]) & (s["first"] < b["end"]))


def _vector(kind: str, s: Column) -> Column:
    return F.array(*features(kind, s).values())


def _scored(kind: str, s: Column, trees: Boosted) -> Column:
    return let(_vector(kind, s), lambda v: score(trees, [F.get(v, F.lit(i)) for i in range(len(FEATURES))]))


def _chosen(kind: str, trees: Boosted):
    def one(s: Column) -> Column:
        return F.struct(s["first"].alias("first"), s["end"].alias("end"), _scored(kind, s, trees).alias("score"))
    return lambda p: F.filter(F.transform(F.filter(p["cand"], lambda s: ~_overlaps(p["base"], s)), one), lambda s: s["score"] >= trees.thresholds[kind])


def fit_sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, vectors: int = SAMPLE_VECTORS) -> Boosted:
    """Trees from the candidates of about ``rows`` rows, at most half of all, drawn by a hash of id and text. Equal labelled
    vectors are one with a weight; at most ``vectors`` of them, by their hash, reach the driver. No thresholds yet."""
    n = docs.count()
    text = F.coalesce(F.col(text_col), F.lit(""))
    share = min(0.5, rows / n) if n else 0.5
    sample = docs.where(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select(text.alias("text"))
    both = lambda kind: F.transform(candidates(F.col("text"), kind), lambda s: F.struct(genuine(kind, s).alias("y"), _vector(kind, s).alias("x")))
    found = sample.select(F.explode(F.concat(*[both(k) for k in KINDS])).alias("c")).groupBy("c.y", "c.x").agg(F.count("*").alias("w"))
    got = sorted(found.orderBy(F.xxhash64("y", "x"), "x", "y").limit(vectors).collect(), key=lambda r: (r.x, r.y))
    x = np.array([r.x for r in got], np.int64).reshape(len(got), len(FEATURES))
    return train(x, np.array([r.y for r in got], np.float64), np.array([r.w for r in got], np.float64))


def calibrate(docs: DataFrame, trees: Boosted, *, text_col: str = "text") -> Boosted:
    """``trees`` with thresholds from the candidates of all rows, counted by kind and cell of the score."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")

    def cells(kind: str) -> Column:
        cell = lambda s: F.greatest(F.lit(-EDGE * CELL), F.least(F.lit(EDGE * CELL), F.floor(_scored(kind, s, trees) * CELL).cast("int")))
        return F.transform(candidates(F.col("text"), kind), lambda s: F.struct(F.lit(kind).alias("kind"), cell(s).alias("cell"), genuine(kind, s).cast("int").alias("y")))
    found = docs.select(text).select(F.explode(F.concat(*[cells(k) for k in KINDS])).alias("c")).groupBy("c.kind", "c.cell")
    rows = found.agg(F.count("*").alias("n"), F.sum("c.y").alias("true")).collect()     # kinds x cells at most
    return Boosted(trees.start, trees.trees, thresholds([(r["kind"], r["cell"], r["n"], r["true"]) for r in rows]))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Boosted:
    """Trees of a sample with the thresholds of all rows; a table without candidates gives trees that add nothing."""
    return calibrate(docs, fit_sample(docs, id_col=id_col, text_col=text_col), text_col=text_col)


def score(trees: Boosted, values: list[Column]) -> Column:
    def column(node: Node) -> Column:
        if node.feature is None:
            return F.lit(node.value)
        return F.when(values[node.feature] <= node.limit, column(node.left)).otherwise(column(node.right))
    out = F.lit(trees.start)
    for t in trees.trees:
        out = out + F.lit(RATE) * column(t)
    return out


def find(docs: DataFrame, *, trees: Boosted | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row: arrays of (kind, first, end) by kind as in ``KINDS``, then place; ends are exclusive.

    ``base`` holds the base patterns' valid matches, ``spans`` these and the candidates that the trees add. A null or
    empty text has none; null ids and repeated rows are taken row by row; an empty table gives an empty result; other
    columns are not read.
    """
    require(docs, id_col, text_col)
    trees = trees or fit(docs, id_col=id_col, text_col=text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = lambda a, kind: F.transform(a, lambda s: F.struct(F.lit(kind).alias("kind"), s["first"].alias("first"), s["end"].alias("end")))
    base = docs.select(F.col(id_col), text.alias("__text"), *[slim(base_spans(text, k), k).alias(f"__{k}") for k in KINDS])
    every = F.concat(*[F.col(f"__{k}") for k in KINDS])
    spans = []
    for kind in KINDS:
        own = F.col(f"__{kind}")
        if math.isfinite(trees.thresholds.get(kind, math.inf)):
            more = slim(let(F.struct(candidates(F.col("__text"), kind).alias("cand"), every.alias("base")), _chosen(kind, trees)), kind)
            own = F.array_sort(F.concat(own, more))
        spans.append(own)
    return base.select(id_col, every.alias("base"), F.concat(*spans).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, trees: Boosted | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text with every span replaced by its kind in brackets); spans that overlap a replaced one go with it.

    A null text stays null, an empty one empty; null ids and repeated rows are taken row by row; an empty table gives an empty
    result; other columns are not read."""
    trees = trees or fit(docs, id_col=id_col, text_col=text_col)
    both = docs.select(F.col(id_col), F.col(text_col), F.col(text_col).alias("__t"))
    found = find(both.withColumn("__id", F.struct(F.col(id_col), F.col("__t"))), trees=trees, id_col="__id", text_col="__t")
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["first"], s["end"], s["kind"])))
    text = F.col("__id.__t")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        keep = F.substring(text, a["at"].cast("int") + 1, (s["first"] - a["at"]).cast("int"))
        return F.when(s["first"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], keep, F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("at")))
    done = F.aggregate(by_place, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.char_length(text))))
    return found.select(F.col(f"__id.{id_col}").alias(id_col), done.alias(text_col))
