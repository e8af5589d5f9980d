"""Response tables -> typed rows (operators J1, J3-J8, J10, X6 applied)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.parsing import (bracket_slice, json_valid, parse_json, parse_list_two_stage,
                                       parse_object_fields, parse_score_map, to_double, unwrap_json_string)
from tessera.functions.scalars import any_equals, feature_id

QUESTIONNAIRE_KEYS = ("brief_reasoning", "answer1", "answer2", "answer3", "answer4", "answer5", "frequency")
ANSWER_COLS = ("answer1", "answer2", "answer3", "answer4", "answer5")


# J1 + X6 ---------------------------------------------------------------------
def parse_questionnaire(responses: DataFrame, text: str = "response", keep: Sequence[str] = ("id", "label"),
                        keys: Sequence[str] = QUESTIONNAIRE_KEYS) -> DataFrame:
    """One row per response, never dropped: the answers (raw strings), the raw
    frequency and its numeric value (NULL if not a number), the error text, and
    ``any_flag`` = 1 when an answer is exactly "Yes"."""
    staged = responses.select(*keep, F.col(text).alias("_t")).withColumn("_valid", json_valid("_t"))
    staged = staged.withColumn("_m", F.when(F.col("_valid"), F.from_json("_t", "map<string,string>")))
    parsed = staged.select(*keep, *parse_object_fields("_t", keys, valid="_valid", parsed="_m"))
    answers = [k for k in keys if k.startswith("answer")]
    return parsed.select("*", to_double("frequency").alias("freq_num"),
                         any_equals(answers, "Yes").alias("any_flag"))


# J3 + J4 -----------------------------------------------------------------------
COMPARISON_SCHEMA = "struct<Category:string, `Post 1`:string, `Post 2`:string>"


def parse_comparisons(responses: DataFrame, key: str = "pair_id", text: str = "response") -> DataFrame:
    """List-of-differences replies -> one row per difference with the category
    lower-cased; a reply that fails both parse attempts is dropped."""
    staged = responses.select(key, text).withColumn("_cut", bracket_slice(text))
    arr = parse_list_two_stage(F.col(text), COMPARISON_SCHEMA, cut="_cut")
    return (staged.select(key, F.posexplode(arr).alias("pos", "c"))
            .select(key, "pos", F.lower(F.col("c.Category")).alias("category"),
                    F.col("c.`Post 1`").alias("post1"), F.col("c.`Post 2`").alias("post2")))


# J5 -------------------------------------------------------------------------
GROUPS_SCHEMA = "struct<categories:array<struct<name:string, terms:array<string>>>>"


def parse_category_groups(responses: DataFrame, text: str = "response", first_n: int = 10) -> DataFrame:
    """Category-group reply (plain or dumped twice as a JSON string) -> the
    first ``first_n`` groups in reply order: (group_pos, name lower-cased, terms)."""
    staged = responses.select(unwrap_json_string(F.col(text)).alias("_doc"))
    doc = parse_json("_doc", GROUPS_SCHEMA)
    return (staged.select(F.posexplode(F.slice(doc["categories"], 1, first_n)).alias("group_pos", "g"))
            .select("group_pos", F.lower(F.col("g.name")).alias("name"), F.col("g.terms").alias("terms")))


# J6 + X1 --------------------------------------------------------------------
DEFINITION_SCHEMA = "struct<featurename:string, short_description:string, rating:string>"


def parse_definitions(responses: DataFrame, category: str = "category", text: str = "response") -> DataFrame:
    """Definition-list replies (one per category) -> one row per feature, in
    category then list order, with ``feature_id``. Unparsable replies drop."""
    staged = responses.select(category, bracket_slice(F.col(text)).alias("_clean"))
    arr = parse_json("_clean", f"array<{DEFINITION_SCHEMA}>")
    rows = staged.select(category, F.posexplode(arr).alias("pos", "d"))
    return rows.select(F.col(category).alias("category"), "pos", F.col("d.featurename").alias("featurename"),
                       F.col("d.short_description").alias("short_description"), F.col("d.rating").alias("rating"),
                       feature_id(F.col(category), F.col("d.featurename")).alias("feature_id"))


# J7 + J10 -------------------------------------------------------------------
RATING_SCHEMA = "struct<featureid:string, rating:string>"


def parse_ratings(responses: DataFrame, key: str = "id", order: str = "cat_pos", text: str = "response") -> DataFrame:
    """Rating-list replies (post x category) -> long (id, feature_id, rating).

    Later entries overwrite earlier ones for a repeated feature id, in category
    then list order (``max_by`` over (order, position), partially aggregated).
    Unknown ids are kept; entries without an id are dropped; a non-numeric
    rating becomes NULL. An unparsable reply contributes nothing.
    """
    staged = responses.select(key, order, bracket_slice(F.col(text)).alias("_clean"))
    arr = parse_json("_clean", f"array<{RATING_SCHEMA}>")
    entries = (staged.select(key, order, F.posexplode(arr).alias("pos", "e"))
               .where(F.col("e.featureid").isNotNull()))
    last = (entries.groupBy(key, F.col("e.featureid").alias("feature_id"))
            .agg(F.max_by(F.col("e.rating"), F.struct(order, "pos")).alias("rating_raw")))
    return last.select(key, "feature_id", "rating_raw", to_double("rating_raw").alias("rating"))


# J8 -------------------------------------------------------------------------
def parse_scores(responses: DataFrame, key: str = "id", text: str = "response") -> DataFrame:
    """``{"feature": score}`` replies -> (id, feature_name, score double);
    a repeated key keeps its last value; an unparsable reply drops."""
    staged = responses.select(key, text)
    entries = staged.select(key, F.posexplode(parse_score_map(F.col(text))).alias("pos", "feature_name", "score_raw"))
    # from_json keeps repeated keys in the map; the last occurrence wins (max_by over position)
    last = entries.groupBy(key, "feature_name").agg(F.max_by("score_raw", "pos").alias("score_raw"))
    return last.select(key, "feature_name", to_double("score_raw").alias("score"))
