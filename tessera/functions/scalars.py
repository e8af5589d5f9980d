"""Scalar expressions (operators X1-X13, S5). All are built-in Column
expressions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# X1
def feature_id(category, featurename) -> Column:
    """``category`` without spaces + ``_`` + name, then spaces -> ``_``."""
    return F.replace(F.concat(F.replace(_col(category), F.lit(" "), F.lit("")), F.lit("_"),
                              _col(featurename)), F.lit(" "), F.lit("_"))


# S5
def canonical_id(c) -> Column:
    """Canonical feature id: every character outside ``[0-9A-Za-z_.]`` -> ``.``
    (the spelling a header-mangling CSV reader produces)."""
    return F.regexp_replace(_col(c), r"[^0-9A-Za-z_.]", ".")


# X2
def before_first(c, sep: str = "_") -> Column:
    return F.substring_index(_col(c), sep, 1)


# X3
def after_first(c, sep: str = "_") -> Column:
    """Text after the first ``sep`` (keeps later separators); whole text if absent."""
    x = _col(c)
    return F.when(F.instr(x, sep) > 0, x.substr(F.instr(x, sep) + len(sep), F.lit(1 << 30))).otherwise(x)


# X4
def underscores_to_spaces(c) -> Column:
    return F.replace(_col(c), F.lit("_"), F.lit(" "))


# X5
def cluster_label(c, prefix: str = "Cluster ") -> Column:
    return F.concat(F.lit(prefix), _col(c).cast("string"))


# X6
def any_equals(cols: Sequence, value: str = "Yes") -> Column:
    """1 when any column equals ``value`` exactly, else 0 (NULLs count as no)."""
    return F.when(F.array_contains(F.array(*[F.coalesce(_col(c), F.lit("")) for c in cols]),
                                   value), 1).otherwise(0)


# X7
def positive_flag(c) -> Column:
    return F.when(_col(c) > 0, 1).otherwise(0)


# X8
def yes_no_code(c) -> Column:
    """"Yes" -> 1, "No" -> 0, anything else NULL."""
    x = _col(c)
    return F.when(x == "Yes", 1).when(x == "No", 0)


def code_yes_no(c) -> Column:
    x = _col(c)
    return F.when(x == 1, "Yes").when(x == 0, "No")


# X9
def row_sum(cols: Sequence) -> Column:
    """Sum across columns, NULL if any is NULL."""
    out = None
    for c in cols:
        out = _col(c) if out is None else out + _col(c)
    return out


# X10
def log2_ratio(num, den) -> Column:
    """log2(num/den) with R's IEEE cases written out: x/0 -> +Inf (x>0),
    0/x -> -Inf, 0/0 -> NaN. ANSI division never sees a zero denominator."""
    a, b = _col(num), _col(den)
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when((a == 0) & (b == 0), F.lit(float("nan")))
            .when(b == 0, F.when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
            .when(a == 0, F.lit(float("-inf")))
            .otherwise(F.log2(a / b)))


# X11
def clamp_neg_inf(c, value: float = 0.0) -> Column:
    x = _col(c)
    return F.when(x == F.lit(float("-inf")), F.lit(value)).otherwise(x)


# X12
def round_half_even(c, places: int = 2) -> Column:
    return F.bround(_col(c), places)


# X13
def percent_of_max(c, max_value: float = 4.0) -> Column:
    """Display scaling: score as a percent of the scale maximum, in [0, 100]."""
    return F.least(F.greatest(_col(c) / F.lit(max_value) * 100.0, F.lit(0.0)), F.lit(100.0))


def filled_segments(c, segments: int) -> Column:
    """Number of filled display segments for an integer-like value, clipped to [0, segments]."""
    return F.least(F.greatest(F.round(_col(c)).cast("int"), F.lit(0)), F.lit(segments))


def sig_round(c, digits: int = 3) -> Column:
    """Round to ``digits`` significant digits (R's ``signif``); 0 stays 0."""
    x = _col(c)
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    # in two steps: for values below 1e-306 the whole power would overflow
    half = F.floor(places / 2)
    one, two = F.pow(F.lit(10.0), half), F.pow(F.lit(10.0), places - half)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * one * two) / one / two)
