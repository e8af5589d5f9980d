"""Fixture views derived from the test tables (FIXTURES.md section 4).

The model is not available in tests, so recorded responses are derived from
``documents`` with a portable md5 hash. Each view is written once as SQL
expression text in a small dialect layer, evaluated by Spark through
``selectExpr`` and by DuckDB in the oracle, so both engines see byte-equal
inputs. Everything is row-local (map-side); no view shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed fixture values (test-data definition, invented).
QUESTION_YES_PERCENT = (40, 30, 20, 12, 6)
LONG_POST_BONUS = 15
LONG_POST_CHARS = 1475
QUESTIONNAIRE_KEYS = ("brief_reasoning", "answer1", "answer2", "answer3", "answer4", "answer5",
                      "frequency")

PAIR_CATEGORY_NAMES = ("Taste", "taste", "Kitchen Gear", "kitchen gear", "Season", "Budget", "Storage", "Garnish",
                       "Heat Source", "Menu", "Allergens", "Plating")

SCALE_0_3 = "0 absent, 1 a hint, 2 clear, 3 strong"
# (category, featurename, short_description, rating scale): posts read as if they were about cooking
DEFINITIONS = (
    ("taste", "Sweetness", "Sugar, honey or ripe fruit in the dish", SCALE_0_3),
    ("taste", "Bitterness", "Dark greens, cocoa or char", SCALE_0_3),
    ("taste", "Slow-cooked", "Long braising comes through", SCALE_0_3),
    ("taste", "Smoky note", "Smoke, from a trace to dominant", SCALE_0_3),
    ("taste", "Saltiness", "Salt and brine", "low, medium (1-2)"),
    ("taste", "Umami-rich", "Mushroom, broth or soy depth", SCALE_0_3),
    ("menu", "Starter", "Served before the main course", SCALE_0_3),
    ("menu", "Side dish", "Goes along with something larger", SCALE_0_3),
    ("menu", "Family style", "Shared plates, \"help yourself\"", SCALE_0_3),
    ("menu", "Dessert", "Closes the meal", SCALE_0_3),
    ("menu", "Picnic", "Packed to eat outdoors", SCALE_0_3),
    ("menu", "Brunch", "Late morning food", SCALE_0_3),
    ("kitchen gear", "Oven", "Needs an oven", SCALE_0_3),
    ("kitchen gear", "Grill", "Open flame, grate, tongs", SCALE_0_3),
    ("kitchen gear", "Blender", "Something is pureed", SCALE_0_3),
    ("kitchen gear", "Wok", "High heat, quick tossing", SCALE_0_3),
    ("kitchen gear", "Scale", "Weighs ingredients, exact grams", SCALE_0_3),
    ("kitchen gear", "Thermometer", "Checks a core temperature", SCALE_0_3),
    ("heat source", "Charcoal", "Mentions charcoal or embers", SCALE_0_3),
    ("heat source", "Gas", "Mentions gas, burners or bottles", SCALE_0_3),
    ("heat source", "Induction", "Mentions an induction hob", SCALE_0_3),
    ("heat source", "Steam", "Describes steaming", SCALE_0_3),
    ("heat source", "Residual heat", "Finishes off the fire", SCALE_0_3),
    ("heat source", "No heat", "Nothing is cooked", SCALE_0_3),
)
SPARSE_FEATURES = ("menu_Picnic", "heatsource_Residual_heat")   # left out for 80 % of posts
CONSTANT_FEATURE = "taste_Saltiness"                             # always rated 2
TEXT_RATING_FEATURE = "kitchengear_Grill"                        # "high" for 1 post in 40
UNKNOWN_FEATURE = "taste_Mystery"                                # 1 post in 50
REPEATED_FEATURE = "taste_Sweetness"                             # repeated, rating 0, 1 post in 25

# (feature_name, cluster, description, rating_options) for the scoring app lookup
APP_FEATURES = (
    ("menu_Starter", 1, "Before the main course", "none (0), high (3)"),
    ("taste_Slow.cooked", 1, "Long braising", "none (0), low (1), medium (2), high (3)"),
    ("kitchengear_Oven", 1, "Needs an oven", "none (0), low (1), medium (2), high (3)"),
    ("heatsource_Charcoal", 1, "Embers, \"coals\", smoke", "none (0), low (1), medium (2), high (3)"),
    ("taste_Slow.cooked", 2, "Long braising", "none (0), low (1), medium (2), high (3)"),
    ("menu_Side_dish", 2, "Goes along, never alone", "none (0), low (1), medium (2), high (3)"),
    ("kitchengear_Wok", 2, "Quick tossing", "none (0), low (1), medium (2), high (3)"),
    ("taste_Bitterness", 2, "Cocoa, char", "none (0), low (1), medium (2), high (3)"),
    ("heatsource_Steam", 3, "Steaming", "none (0), low (1), medium (2), high (3)"),
    ("menu_Side_dish", 3, "Goes along, never alone", "none (0), low (1), medium (2), high (3)"),
    ("taste_Umami.rich", 3, "Broth, soy", "none (0), low (1), medium (2), high (3)"),
    ("kitchengear_Scale", 3, "Exact grams", "none (0), low (1), medium (2), high (3)"),
)
APP_UNKNOWN_NAME = "taste_Unlisted"


def feature_ids() -> list[str]:
    return [(c.replace(" ", "") + "_" + n).replace(" ", "_") for c, n, _, _ in DEFINITIONS]


def categories() -> list[str]:
    out = []
    for c, *_ in DEFINITIONS:
        if c not in out:
            out.append(c)
    return out


def app_feature_names() -> list[str]:
    out = []
    for n, *_ in APP_FEATURES:
        if n not in out:
            out.append(n)
    return out


# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Dialect:
    name: str   # "spark" | "duckdb"

    def h(self, key_sql: str, salt_sql: str, m: int) -> str:
        """Portable hash: first 6 hex digits of md5(key || '|' || salt) mod m."""
        digest = f"md5(concat(CAST({key_sql} AS STRING), '|', {salt_sql}))"
        if self.name == "spark":
            return f"(CAST(conv(substr({digest}, 1, 6), 16, 10) AS BIGINT) % {m})"
        return f"(CAST(('0x' || substr({digest}, 1, 6)) AS BIGINT) % {m})"

    def lit(self, s: str) -> str:
        """String literal: Spark SQL treats backslash as an escape, DuckDB does not."""
        if self.name == "spark":
            return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + s.replace("'", "''") + "'"

    def replace_all(self, text_sql: str, pattern: str, repl: str) -> str:
        if self.name == "spark":
            return f"regexp_replace({text_sql}, '{pattern}', '{repl}')"
        return f"regexp_replace({text_sql}, '{pattern}', '{repl}', 'g')"


SPARK = Dialect("spark")
DUCKDB = Dialect("duckdb")


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# fx_posts
def posts_exprs(d: Dialect) -> list[str]:
    label = "concat('l_', lang)"
    return ["doc_id", f"concat('ID', CAST(doc_id AS STRING), '_', {label}) AS id", f"{label} AS label",
            "text", "n_chars"]


# Each recorded reply is built in stages (lists of ``expr AS name``); every
# stage is one projection, so no hash or JSON text is evaluated twice.
Stages = list[list[str]]


def staged_sql(src: str, stages: Stages) -> str:
    """DuckDB: nest one ``SELECT *, ...`` per stage over ``src``."""
    sql = f"SELECT * FROM {src}"
    for st in stages:
        sql = f"SELECT *, {', '.join(st)} FROM ({sql})"
    return sql


def apply_stages(df: DataFrame, stages: Stages) -> DataFrame:
    for st in stages:
        df = df.selectExpr("*", *st)
    return df


# fx_questionnaire_responses
def questionnaire_stages(d: Dialect) -> Stages:
    bonus = f"(CASE WHEN n_chars > {LONG_POST_CHARS} THEN {LONG_POST_BONUS} ELSE 0 END)"
    s1 = [f"{d.h('doc_id', chr(39) + 'kind' + chr(39), 20)} AS _kind", f"{d.h('doc_id', q('f'), 5)} AS _fh"]
    s1 += [f"({d.h('doc_id', q('a' + str(k)), 100)} < {pct} + {bonus}) AS _y{k}"
           for k, pct in enumerate(QUESTION_YES_PERCENT, start=1)]
    s2 = [f"(CASE WHEN _kind = 3 THEN (CASE WHEN _y{k} THEN 'yes' ELSE 'no' END) "
          f"ELSE (CASE WHEN _y{k} THEN 'Yes' ELSE 'No' END) END) AS _a{k}" for k in range(1, 6)]
    s2.append("(CASE WHEN _kind = 4 THEN '\"many\"' ELSE CAST(_fh AS STRING) END) AS _freq")
    parts = ["'{\"brief_reasoning\": \"post ', CAST(doc_id AS STRING), ' reads as ', label, '\", '"]
    for k in range(1, 6):
        seg = f"concat('\"answer{k}\": \"', _a{k}, '\", ')"
        if k == 4:
            seg = f"(CASE WHEN _kind = 2 THEN '' ELSE {seg} END)"
        parts.append(seg)
    parts.append("'\"frequency\": ', _freq, '}'")
    s3 = ["concat(" + ", ".join(parts) + ") AS _body"]
    s4 = ["(CASE WHEN _kind = 0 THEN concat('Sure, here is my answer: ', _body) "
          "WHEN _kind = 1 THEN substr(_body, 1, length(_body) - 1) ELSE _body END) AS response"]
    return [s1, s2, s3, s4]


# fx_rating_responses: one reply per (post, category)
def rating_stages(d: Dialect) -> Stages:
    fids = feature_ids()
    s1 = [f"{d.h('doc_id', q('seg'), 4)} AS _seg", f"{d.h('doc_id', q('sparse'), 5)} AS _sparse",
          f"{d.h('doc_id', q('prose'), 10)} AS _prose"]
    s2, s3 = [], []
    for ci, category in enumerate(categories()):
        entries = []
        for f, ((cat, _, _, _), fid) in enumerate(zip(DEFINITIONS, fids)):
            if cat != category:
                continue
            base = f"(CASE WHEN {f % 4} = _seg THEN 3 ELSE 1 END)"
            rating = f"greatest(0, least(3, {base} + {d.h('doc_id', q(fid), 3)} - 1))"
            rating_txt = f"CAST({rating} AS STRING)"
            omitted = f"({d.h('doc_id', q('m' + fid), 17)} = 0)"
            if fid in SPARSE_FEATURES:
                omitted = f"({omitted} OR _sparse <> 0)"
            if fid == CONSTANT_FEATURE:
                rating_txt, omitted = "'2'", "FALSE"
            if fid == TEXT_RATING_FEATURE:
                rating_txt = f"(CASE WHEN {d.h('doc_id', q('txt'), 40)} = 0 THEN '\"high\"' ELSE {rating_txt} END)"
            entry = f"concat('{{\"featureid\": \"{fid}\", \"rating\": ', {rating_txt}, '}}')"
            entries.append(f"(CASE WHEN {omitted} THEN NULL ELSE {entry} END)")
        if ci == 0:
            entries.append(f"(CASE WHEN {d.h('doc_id', q('unk'), 50)} = 0 THEN "
                           f"'{{\"featureid\": \"{UNKNOWN_FEATURE}\", \"rating\": 1}}' END)")
            entries.append(f"(CASE WHEN {d.h('doc_id', q('rep'), 25)} = 0 THEN "
                           f"'{{\"featureid\": \"{REPEATED_FEATURE}\", \"rating\": 0}}' END)")
        s2.append("concat('[', concat_ws(', ', " + ", ".join(entries) + f"), ']') AS _list{ci}")
        bad = d.h("doc_id", q("bad" + category), 50)
        s3.append(f"(CASE WHEN {bad} = 0 THEN substr(_list{ci}, 1, greatest(length(_list{ci}) - 12, 1)) "
                  f"WHEN _prose = 0 THEN concat('Here are the ratings: ', _list{ci}, "
                  f"' Let me know if you need more.') ELSE _list{ci} END) AS _resp{ci}")
    return [s1, s2, s3]


# fx_pair_responses: one reply per pair (pair_id, text1, text2)
def pair_stages(d: Dialect) -> Stages:
    s1 = [f"substr({d.replace_all('text1', '[^A-Za-z ]', '')}, 1, 40) AS _s1",
          f"substr({d.replace_all('text2', '[^A-Za-z ]', '')}, 1, 40) AS _s2",
          f"{d.h('pair_id', q('pk'), 10)} AS _pk"]
    for j in range(3):
        hv = d.h("pair_id", q("c" + str(j)), len(PAIR_CATEGORY_NAMES))
        whens = " ".join(f"WHEN {i} THEN {q(n)}" for i, n in enumerate(PAIR_CATEGORY_NAMES))
        s1.append(f"(CASE {hv} {whens} END) AS _c{j}")
    objs = [f"concat('{{\"Category\": \"', _c{j}, '\", \"Post 1\": \"', _s1, '\", \"Post 2\": \"', _s2, '\"}}')"
            for j in range(3)]
    s2 = ["concat('[', " + ", ', ', ".join(objs) + ", ']') AS _list"]
    s3 = ["(CASE WHEN _pk = 0 THEN concat(_list, ' Hope this helps.') "
          "WHEN _pk = 1 THEN substr(_list, 1, 30) ELSE _list END) AS response"]
    return [s1, s2, s3]


# ---------------------------------------------------------------------------
# Spark views
def fx_posts(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(*posts_exprs(SPARK))


def fx_questionnaire_responses(posts: DataFrame) -> DataFrame:
    """(doc_id, id, label, text, response) with the recorded questionnaire reply; posts may come without their text."""
    return apply_stages(posts, questionnaire_stages(SPARK)).select("doc_id", "id", "label", *[c for c in posts.columns if c == "text"], "response")


def fx_rating_responses(posts: DataFrame) -> DataFrame:
    """(id, category, cat_pos, response): one recorded rating reply per post and category."""
    staged = apply_stages(posts.select("id", "doc_id"), rating_stages(SPARK))
    arr = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(i).alias("cat_pos"), F.col(f"_resp{i}").alias("response"))
                    for i, c in enumerate(categories())])
    return staged.select("id", F.inline(arr))


def fx_pair_responses(pairs_with_text: DataFrame) -> DataFrame:
    """pairs (pair_id, text1, text2, ...) -> (pair_id, response)."""
    return apply_stages(pairs_with_text, pair_stages(SPARK)).select("pair_id", "response")


def app_features_df(spark) -> DataFrame:
    rows = [(i, n, c, desc, opts) for i, (n, c, desc, opts) in enumerate(APP_FEATURES)]
    return spark.createDataFrame(rows, "row_pos int, feature_name string, cluster int, "
                                       "description string, rating_options string")


# ---------------------------------------------------------------------------
# Category-merge reply and definition-list replies (data-derived)
GENERIC_SCALE = "absent, present (0-1)"


def definition_list_json(category: str) -> str | None:
    import json
    rows = [{"featurename": n, "short_description": d, "rating": s} for c, n, d, s in DEFINITIONS if c == category]
    return json.dumps(rows) if rows else None


def definition_stages(d: Dialect, name_col: str = "name") -> Stages:
    """Reply to the definition prompt of one group: the fixture list for known
    categories, two generic features otherwise; some wrapped in prose, some
    cut short (unparsable)."""
    whens = []
    for c in categories():
        whens.append(f"WHEN {d.lit(c)} THEN {d.lit(definition_list_json(c))}")
    generic = (f"concat('[{{\"featurename\": \"Intensity\", \"short_description\": \"How strongly ', {name_col}, "
               f"' shows\", \"rating\": \"{SCALE_0_3}\"}}, {{\"featurename\": \"Presence\", "
               f"\"short_description\": \"Whether ', {name_col}, ' is present\", \"rating\": \"{GENERIC_SCALE}\"}}]')")
    lst = f"(CASE {name_col} {' '.join(whens)} ELSE {generic} END)"
    return [[f"{lst} AS _dlist"],
            [f"(CASE WHEN {d.h(name_col, q('dbad'), 7)} = 0 THEN substr(_dlist, 1, 25) "
             f"WHEN {d.h(name_col, q('dp'), 3)} = 0 THEN concat('Here are the features:', chr(10), _dlist, chr(10), "
             f"'Done.') ELSE _dlist END) AS response"]]


def fx_merge_response(comparisons: DataFrame) -> DataFrame:
    """One-row reply of the category-merge prompt: every distinct category as
    a group (by count desc, then name), dumped twice as a JSON string."""
    counts = comparisons.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    cat = F.col("category")
    item = F.concat(F.lit('{"name": "'), F.upper(F.substring(cat, 1, 1)), F.expr("substr(category, 2)"),
                    F.lit('", "terms": ["'), cat, F.lit('", "'), cat, F.lit(' detail"]}'))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg_n"), cat.alias("c"), item.alias("t"))))
    js = F.concat(F.lit('{"categories": ['), F.array_join(F.transform(items, lambda x: x["t"]), ", "), F.lit("]}"))
    dumped = F.concat(F.lit('"'), F.replace(F.replace(js, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                      F.lit('"'))
    return counts.agg(dumped.alias("response"))


def fx_definition_responses(groups: DataFrame) -> DataFrame:
    """groups (group_pos, name) -> (group_pos, category, response)."""
    return apply_stages(groups.select("group_pos", "name"), definition_stages(SPARK, "name")) \
        .select("group_pos", F.col("name").alias("category"), "response")


# ---------------------------------------------------------------------------
# Stand-in models: replies that both engines can derive from the md5 of a prompt
def stub_client() -> Callable[[list[dict]], str]:
    """Deterministic stand-in model for tests and benchmarks: a questionnaire
    reply derived from the md5 of the user turn (answer k is "Yes" when hex
    digit k is below 4; frequency = digit 6 mod 5)."""
    def call(messages: list[dict]) -> str:
        h = hashlib.md5(messages[0]["content"].encode("utf-8")).hexdigest()
        ans = ", ".join(f'"answer{k}": "{"Yes" if h[k - 1] < "4" else "No"}"' for k in range(1, 6))
        return f'{{"brief_reasoning": "stub {h[:8]}", {ans}, "frequency": {int(h[5], 16) % 5}}}'
    return call


def stub_scoring_client(names: Sequence[str]) -> Callable[[], Callable[[list[dict]], str]]:
    """Deterministic stand-in for the scoring model: ``{name: score}`` with
    score = hex digit i of md5(user turn) mod 4; digit 11 = '0' repeats the
    first name (last wins) with digit 12 mod 4, digit 13 = '0' adds an
    unlisted name."""
    names = list(names)

    def factory():
        def call(messages: list[dict]) -> str:
            h = hashlib.md5(messages[0]["content"].encode("utf-8")).hexdigest()
            items = [f'"{n}": {int(h[i], 16) % 4}' for i, n in enumerate(names)]
            if h[10] == "0":
                items.append(f'"{names[0]}": {int(h[11], 16) % 4}')
            if h[12] == "0":
                items.append('"unlisted_feature": 2')
            return "{" + ", ".join(items) + "}"
        return call
    return factory
