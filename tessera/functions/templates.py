"""Prompt templates as column concatenation (operators A1-A6).

A template is plain text with ``{slot}`` markers. It is split once on the
driver into literal parts and slots, and rendered per row with ``concat``, so
no ``%`` or brace in the data is ever interpreted. Template wording is the
caller's input; the defaults below are neutral examples.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)\}|[^{}]+|[{}]", re.S)


def template_parts(template: str) -> list[tuple[str, str]]:
    """Split into ``[("lit", text) | ("slot", name)]`` in order; ``{{`` and
    ``}}`` stand for literal braces and are never part of a slot."""
    parts: list[tuple[str, str]] = []
    buf: list[str] = []
    for m in _TOKEN.finditer(template):
        tok = m.group(0)
        if tok == "{{":
            buf.append("{")
        elif tok == "}}":
            buf.append("}")
        elif m.group(1):
            if buf:
                parts.append(("lit", "".join(buf)))
                buf = []
            parts.append(("slot", m.group(1)))
        else:
            buf.append(tok)
    if buf:
        parts.append(("lit", "".join(buf)))
    return parts


def render(template: str, **slots) -> Column:
    """Render ``template`` with each slot bound to a column (or column name).
    A NULL slot renders as empty text so the prompt is never NULL."""
    cols = []
    for kind, val in template_parts(template):
        if kind == "lit":
            cols.append(F.lit(val))
        else:
            if val not in slots:
                raise KeyError(f"template slot {{{val}}} is not bound")
            c = slots[val]
            c = F.col(c) if isinstance(c, str) else c
            cols.append(F.coalesce(c.cast("string"), F.lit("")))
    return F.concat(*cols) if cols else F.lit("")


def render_sql(template: str, **slots: str) -> str:
    """The same rendering as a SQL expression (``||`` chain) for oracles."""
    out = []
    for kind, val in template_parts(template):
        if kind == "lit":
            out.append("'" + val.replace("'", "''") + "'")
        else:
            out.append(f"coalesce(CAST({slots[val]} AS VARCHAR), '')")
    return "(" + " || ".join(out) + ")" if out else "''"


# Default templates. Wording is ours; a deployment passes its own.
QUESTIONNAIRE_TEMPLATE = (
    "Read the post below and answer the five yes/no questions from the writer's point of view.\n"
    "Post:\n<<<\n{text}\n>>>\n"
    "Questions:\n{questions}\n"
    "Reply with JSON only: {{\"brief_reasoning\": str, \"answer1\"..\"answer5\": \"Yes\"|\"No\", "
    "\"frequency\": int 0-4}}\n"
)
PAIR_TEMPLATE = (
    "Compare the two posts and list the ways in which they differ.\n"
    "Post 1:\n{post1}\n\nPost 2:\n{post2}\n\n"
    "Reply with a JSON list of objects with keys \"Category\", \"Post 1\", \"Post 2\".\n"
)
DEFINITION_TEMPLATE = (
    "Define a small set of measurable features for the category '{category}'.\n"
    "Examples:\n{examples}\n"
    "Reply with a JSON list of objects with keys \"featurename\", \"short_description\", \"rating\".\n"
)
MERGE_TEMPLATE = (
    "Group the similar terms of this list into categories and keep the first {n} groups.\n"
    "Terms: {terms}\n"
    "Reply with JSON: {{\"categories\": [{{\"name\": str, \"terms\": [str]}}]}}\n"
)
RATING_TEMPLATE = (
    "Rate each feature below for the text.\nText: {text}\n\nFeatures:\n{features}\n"
    "Reply with a JSON list of objects with keys \"featureid\" and \"rating\" (int).\n"
)
SCORING_TEMPLATE = (
    "Rate the post on every feature in the table, using the scale in rating_options.\n"
    "Post:\n<<<\n{text}\n>>>\nFeatures (CSV):\n{features}\n"
    "Reply with a JSON object mapping feature_name to an integer rating.\n"
)
