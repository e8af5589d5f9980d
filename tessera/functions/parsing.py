"""Model-response parsing: JSON text -> typed columns (operators J1-J10).

All parsing stays JVM-side (``from_json`` / ``get_json_object``). Spark's
``from_json`` is lenient (it ignores trailing text and wraps a bare object
into an array), so every parse is gated on :func:`json_valid`, which accepts
exactly one complete JSON value, as Python's ``json.loads`` does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_valid(text) -> Column:
    """True when ``text`` holds exactly one JSON value, as Python's
    ``json.loads`` would accept it (except bare NaN/Infinity).

    Three JVM-side checks, each closing a gap of the others:
    the text as the value of a one-key object must parse (rejects leading
    prose and truncation); the text as the single element of an array must
    give length 1 (rejects trailing text, including a stray closing brace);
    and a strict parse must succeed (rejects single-quoted pseudo-JSON and raw
    control characters inside strings, which Jackson's lenient mode allows).
    """
    t = _col(text)
    as_value = F.json_object_keys(F.concat(F.lit('{"v":'), t, F.lit("}"))).isNotNull()
    as_element = F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1
    strict = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>",
                         {"allowSingleQuotes": "false"}).isNotNull()
    return F.coalesce(as_value & as_element & strict, F.lit(False))


def unwrap_json_string(text) -> Column:
    """Decode a JSON document that may have been dumped a second time as a
    JSON string (S4/D5). Plain and double-encoded text give the same result."""
    wrapped = F.concat(F.lit('{"v":'), _col(text), F.lit("}"))
    return F.get_json_object(wrapped, "$.v")


# J2 ------------------------------------------------------------------------
def bracket_slice(text) -> Column:
    """Text from the first ``[`` to the last ``]``; empty when there is none."""
    return F.regexp_extract(_col(text), r"(?s)\[.*\]", 0)


def tail_cut(text) -> Column:
    """Text up to and including the last ``]`` (empty when there is none)."""
    t = _col(text)
    # length of the text after the last ']' = position of ']' in the reversed text - 1
    pos_rev = F.instr(F.reverse(t), "]")
    return F.when(pos_rev > 0, t.substr(F.lit(1), F.length(t) - pos_rev + 1)).otherwise(F.lit(""))


def parse_json(text, schema: str) -> Column:
    """``from_json`` that yields NULL unless the text is strictly valid."""
    t = _col(text)
    return F.when(json_valid(t), F.from_json(t, schema))


# J3 ------------------------------------------------------------------------
def parse_list_two_stage(text, element_schema: str, cut=None) -> Column:
    """Parse the whole text as a list; else the first '[' .. last ']' slice
    (a superset of the tail-only cut); else NULL (the caller drops it).
    ``cut`` may name a column already holding the slice."""
    schema = f"array<{element_schema}>"
    sliced = _col(cut) if cut is not None else bracket_slice(text)
    whole = F.when(_col(text).rlike(r"^\s*\["), parse_json(text, schema))     # a bare object is no list
    return F.coalesce(whole, parse_json(sliced, schema))


# J1 ------------------------------------------------------------------------
def _last_value(m: Column, key: str) -> Column:
    """Value of a key in a parsed map; of a repeated key the last, as ``json.loads`` has it."""
    own = F.filter(F.map_entries(m), lambda e: e["key"] == F.lit(key))
    return F.get(F.reverse(own), F.lit(0))["value"]


def parse_object_fields(text, keys: Sequence[str], prefix: str = "", valid=None, parsed=None) -> list[Column]:
    """Parse a JSON object into one string column per key, in order, plus
    ``error``. Keys are read one by one: a missing key sets the error and
    leaves it and all later keys NULL, while earlier keys stay filled. Invalid
    text or a non-object leaves every key NULL. The row is always kept.

    Returns ``[key columns..., error]``; non-string values keep their JSON
    text (``3`` -> ``"3"``), so a frequency of "many" survives for J10.
    """
    t = _col(text)
    valid = _col(valid) if valid is not None else json_valid(t)
    m = _col(parsed) if parsed is not None else F.when(valid, F.from_json(t, "map<string,string>"))
    present = [F.coalesce(F.map_contains_key(m, F.lit(k)), F.lit(False)) for k in keys]
    cols = []
    reached = m.isNotNull()
    for k, has in zip(keys, present):
        reached = reached & has
        cols.append(F.when(reached, _last_value(m, k)).alias(prefix + k))
    err = F.when(~valid, F.lit("invalid json")).when(m.isNull(), F.lit("not an object"))
    for k, has in zip(keys, present):
        err = err.when(~has, F.lit(f"missing key: {k}"))
    cols.append(err.alias("error"))
    return cols


# J8 ------------------------------------------------------------------------
def parse_score_map(text) -> Column:
    """``{"name": score, ...}`` -> ``map<string,string>``; a repeated key keeps
    the last value (Jackson map semantics), NULL for invalid text."""
    return parse_json(text, "map<string,string>")


_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


# J9 / J10 -------------------------------------------------------------------
def yes_to_bool(c) -> Column:
    """Exact ``== "Yes"``; NULL and other spellings are False."""
    return F.coalesce(_col(c) == F.lit("Yes"), F.lit(False))


def to_double(c) -> Column:
    """Numeric text -> finite double; anything else (NaN, Infinity, ``3d``, ``1e400``) -> NULL (never raises)."""
    x = F.when(_col(c).cast("string").rlike(_NUMBER), _try_cast(c, "double"))
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def to_int(c) -> Column:
    """Numeric text cut to a whole number, as ``int`` cuts a JSON number; anything else, or past an int -> NULL."""
    return to_double(c).try_cast("int")


def _try_cast(c, t: str) -> Column:
    return _col(c).cast("string").try_cast(t)
