"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule is a boolean Column that is true where a text is rejected. On a
bounded sample each rule's cost (seconds) and rejection rate are measured;
rules then run by rejection per cost inside one nested CASE, which stops at the
first that rejects. The order changes time only: the verdict is the same for any.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, require

SPACE = r"[\x20\x09-\x0D]+"
#: Rows of the sample on which cost and selectivity are measured.
SAMPLE_ROWS = 2000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside 5-word windows found twice or more in one text; windows are compared by 64-bit hash."""
    n = F.size(words)
    grams = F.when(n >= 5, F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, 5)))
                   ).otherwise(F.array().cast("array<bigint>"))

    def covered(grams: Column) -> Column:
        def positions(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))
        placed = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-5).alias("last"))
        return F.aggregate(let(placed, positions), start,
                           lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")


def base_metrics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a non-null text."""
    return let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        symbols(text).alias("n_symbols"), dup_lines(text).alias("n_dup_lines"), repeat_words(w).alias("n_repeat_words")))


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the text and a struct of base metrics, or None where none are at hand."""
    name: str
    rejects: Callable[[Column, Column | None], Column]


def _n_words(text: Column, m: Column | None) -> Column:
    return m["n_words"] if m is not None else F.size(words_of(text))


#: The base of the contract: too short, or mostly repeated windows.
BASE = (
    Rule("short", lambda t, m: _n_words(t, m) < 10),
    Rule("repeats", lambda t, m: 100 * m["n_repeat_words"] > 20 * m["n_words"] if m is not None else
         let(words_of(t), lambda w: 100 * repeat_words(w) > 20 * F.size(w))),
)


def _count(text: Column, others: str) -> Column:
    return F.char_length(F.regexp_replace(text, others, ""))


#: Beyond the base; each bound lies far from running prose.
RULES = (
    Rule("symbols", lambda t, m: 10 * (m["n_symbols"] if m is not None else symbols(t)) > 3 * _n_words(t, m)),
    Rule("shouting", lambda t, m: let(_count(t, r"[^\p{Lu}]+"), lambda up: (up >= 20) & (2 * up > _count(t, r"[^\p{L}]+")))),
    Rule("exclaims", lambda t, m: 10 * _count(t, r"[^!]+") > 3 * _n_words(t, m)),
    Rule("stutter", lambda t, m: let(words_of(t), lambda w: 10 * F.size(F.filter(w, lambda x, i: F.get(w, i - 1) == x)) > 3 * F.size(w))),
    Rule("same_lines", lambda t, m: let(_lines(t), lambda a: 2 * (F.size(a) - F.size(F.array_distinct(a))) > F.size(a))),
    Rule("long_words", lambda t, m: (m["word_chars"] if m is not None else _count(t, SPACE)) > 30 * _n_words(t, m)),
)


def sampled(docs: DataFrame, text: Column, n: int, sample_rows: int) -> DataFrame:
    """About ``sample_rows`` texts of ``n`` in one partition. All tasks scan and draw; only drawn texts are brought together."""
    drawn = docs.select(text) if n <= sample_rows else docs.sample(fraction=sample_rows / n, seed=7).select(text)
    return drawn.repartition(1)


def ordered(docs: DataFrame, rules: tuple[Rule, ...], *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, rejection rate) by falling rejection per cost, measured on about ``sample_rows`` rows."""
    n = docs.count()
    if not n or not rules:
        return [(r, 0.0, 0.0) for r in rules]
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    sample = materialize(sampled(docs, text, n, sample_rows), name="sample")

    def seconds(*columns: Column) -> tuple[float, list[float]]:
        began = time.perf_counter()
        row = sample.agg(*[F.coalesce(F.avg(c.cast("double")), F.lit(0.0)).alias(f"r{i}") for i, c in enumerate(columns)]).first()
        return time.perf_counter() - began, list(row)

    seconds(F.char_length("text"))                                  # opens the file and starts workers
    floor, _ = seconds(F.char_length("text"))
    found = []
    for rule in rules:
        cost, rate = seconds(rule.rejects(F.col("text"), None))
        found.append((rule, max(cost - floor, 1e-3), rate[0]))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def cascade(rules: list[Rule], text: Column, metrics: Column | None = None) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = None
    for rule in rules:
        hit = rule.rejects(text, metrics)
        out = F.when(hit, F.lit(rule.name)) if out is None else out.when(hit, F.lit(rule.name))
    return out if out is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) of every row.

    The contract's metrics are computed for all rows; ``kept`` runs the cascade over rows that pass the base. A null
    or empty text has no words and fails the base. Null ids and repeated rows are judged row by row, an empty table
    gives an empty result, other columns are not read. No shuffle.
    """
    require(docs, id_col, text_col)
    order = [r for r, _, _ in ordered(docs, rules, text_col=text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    m = docs.select(F.col(id_col), text.alias("__text"), base_metrics(text).alias("__m"))
    base = (F.col("__m.n_words") < 10) | (100 * F.col("__m.n_repeat_words") > 20 * F.col("__m.n_words"))
    kept = F.when(base, F.lit(False)).otherwise(cascade(order, F.col("__text"), F.col("__m")).isNull())
    return m.select(id_col, "__m.*", base.alias("base_failed"), kept.alias("kept"))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = (*BASE, *RULES), *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that no rule rejects: base rules and others run in one measured order,
    and a text stops at the first that rejects it. A null or empty text has no words and goes; null ids, ties and repeated
    rows are judged row by row; an empty table gives an empty result; other columns, whatever their names, stay as they are."""
    order = [r for r, _, _ in ordered(docs, rules, text_col=text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.where(cascade(order, text).isNull())
