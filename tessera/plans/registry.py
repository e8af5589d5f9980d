"""Registered queries (one per operator of SURVEY section 2) and their
DuckDB oracle SQL. Each query reads the test tables at ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import posts as P
from tessera.operators import responses as R
from tessera.operators import summaries as G
from tessera.plans import jobs as J
from tessera.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


# --------------------------------------------------------------------------- C1
@register("j1_parse_questionnaire", with_ctes(O.questionnaire_ctes(), """
SELECT id, label, brief_reasoning, answer1, answer2, answer3, answer4, answer5, frequency, error,
       freq_num, any_flag FROM fx_questionnaire"""))
def q_j1(spark, sf):
    return J.questionnaire(spark, sf).drop("doc_id")


@register("g1_label_summary", with_ctes(O.questionnaire_ctes(), """
SELECT label, count(*) AS n,
  CAST(sum(CASE WHEN answer1 = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS yes_answer1,
  CAST(sum(CASE WHEN answer2 = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS yes_answer2,
  CAST(sum(CASE WHEN answer3 = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS yes_answer3,
  CAST(sum(CASE WHEN answer4 = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS yes_answer4,
  CAST(sum(CASE WHEN answer5 = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS yes_answer5,
  avg(freq_num) AS freq_mean, min(freq_num) AS freq_min, max(freq_num) AS freq_max,
  CAST(sum(any_flag) AS BIGINT) AS any_count,
  CAST(100 AS DOUBLE) * sum(any_flag) / count(*) AS any_perc
FROM fx_questionnaire GROUP BY label"""))
def q_g1(spark, sf):
    return G.label_summary(J.questionnaire(spark, sf), J.ANSWERS)


@register("g2_label_flag_table", with_ctes(O.questionnaire_ctes(), """
SELECT label, CAST(sum(CASE WHEN any_flag = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_0,
       CAST(sum(CASE WHEN any_flag = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_1
FROM fx_questionnaire GROUP BY label"""))
def q_g2(spark, sf):
    return G.contingency(J.questionnaire(spark, sf), "label", "any_flag", [0, 1])


from tessera.functions import scalars as X  # noqa: E402
from tessera.functions.hashing import hash_mod, md5_key  # noqa: E402
from tessera.functions.parsing import bracket_slice, yes_to_bool, to_int  # noqa: E402
from tessera.functions.templates import (DEFINITION_TEMPLATE, MERGE_TEMPLATE, PAIR_TEMPLATE,  # noqa: E402
                                         QUESTIONNAIRE_TEMPLATE, RATING_TEMPLATE, render, render_sql)
from tessera.operators import annotate as A  # noqa: E402
from tessera.operators import linkage as L  # noqa: E402
from tessera.operators import stats as T  # noqa: E402
from tessera.operators import transfers  # noqa: E402
from tessera.plans import fixtures as fx  # noqa: E402
from tessera.plans.fixtures import DUCKDB, q  # noqa: E402

QC, FC, C2, MC, SC = (O.questionnaire_ctes(), O.flagged_ctes(), O.c2_ctes(), O.matrix_ctes(), O.spearman_ctes())
PC = O.pairs_ctes()
RC = O.rating_ctes()
QUESTIONS = "1. first question\n2. second question\n3. third question\n4. fourth question\n5. fifth question"


# --------------------------------------------------------------------------- T1 / T9
def _chisq_sql(src: str, r: str, c: str) -> str:
    return f"""
cells AS (SELECT {r} AS r, {c} AS c, count(*) AS o FROM {src} GROUP BY 1, 2),
rv AS (SELECT DISTINCT r FROM cells), cv AS (SELECT DISTINCT c FROM cells),
grid AS (SELECT rv.r, cv.c, coalesce(cells.o, 0) AS o FROM rv CROSS JOIN cv
  LEFT JOIN cells ON cells.r = rv.r AND cells.c = cv.c),
rt AS (SELECT r, sum(o) AS nr FROM grid GROUP BY r), ct AS (SELECT c, sum(o) AS nc FROM grid GROUP BY c),
tt AS (SELECT sum(o) AS n, (SELECT count(*) FROM rt) AS nrow, (SELECT count(*) FROM ct) AS ncol FROM grid),
ex AS (SELECT g.o, CAST(rt.nr AS DOUBLE) * ct.nc / tt.n AS e, tt.* FROM grid g JOIN rt USING (r) JOIN ct USING (c), tt)
SELECT sum(power(abs(o - e) - CASE WHEN nrow = 2 AND ncol = 2 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e)
  AS statistic, CAST((min(nrow) - 1) * (min(ncol) - 1) AS BIGINT) AS df, (min(nrow) = 2 AND min(ncol) = 2) AS yates,
  CAST(min(n) AS BIGINT) AS n FROM ex"""


@register("t1_chisq_label_flag", "WITH " + QC + "," + _chisq_sql("fx_questionnaire", "label", "any_flag"))
def q_t1a(spark, sf):
    return T.chisq_independence(J.questionnaire(spark, sf), "label", "any_flag")


@register("t1_chisq_quality_toxic", "WITH " + _chisq_sql("labels", "quality", "toxic").lstrip())
def q_t1b(spark, sf):
    from tessera.sources.tables import table
    return T.chisq_independence(table(spark, sf, "labels"), "quality", "toxic")


@register("t9_chisq_pvalue", f"SELECT *, {O.chisq_tail_sql('statistic', 'df')} AS p FROM ({ORACLE['t1_chisq_label_flag']})")
def q_t9a(spark, sf):
    return T.with_chisq_p(T.chisq_independence(J.questionnaire(spark, sf), "label", "any_flag"))


# --------------------------------------------------------------------------- P
@register("p1_post_ids", with_ctes(QC, "SELECT doc_id, id, label FROM fx_posts"))
def q_p1(spark, sf):
    from tessera.sources.tables import table
    d = table(spark, sf, "documents").withColumn("label", F.concat(F.lit("l_"), F.col("lang")))
    return P.with_post_id(d, "doc_id").select("doc_id", "id", "label")


@register("p2_sample_posts", with_ctes(QC, f"""
SELECT id, label FROM fx_posts ORDER BY md5(concat(id, '|', '7')), id LIMIT 300"""))
def q_p2(spark, sf):
    return P.sample_n(J.posts(spark, sf), 300, "id", "7").select("id", "label")


@register("p3_pairs", with_ctes(PC, "SELECT pair_id, id1, id2 FROM fx_pairs"))
def q_p3(spark, sf):
    return J.pairs(spark, sf)


@register("p4_pair_texts", with_ctes(PC, "SELECT pair_id, id1, id2, text1, text2 FROM fx_pair_texts"))
def q_p4(spark, sf):
    return J.pair_texts(spark, sf)


@register("p5_typed_columns", with_ctes(QC, """
SELECT id, label, CAST(NULL AS VARCHAR) AS output, CAST(NULL AS DOUBLE) AS score FROM fx_posts"""))
def q_p5(spark, sf):
    df = P.add_typed_columns(J.posts(spark, sf), {"output": "string", "score": "double"})
    return P.drop_columns(df, ["doc_id", "text", "n_chars"])


@register("p6_one_post_per_label", with_ctes(QC, """
SELECT label, arg_min(id, md5(concat(id, '|', '3'))) AS id, arg_min(doc_id, md5(concat(id, '|', '3'))) AS doc_id
FROM fx_posts GROUP BY label"""))
def q_p6(spark, sf):
    return P.one_per_group(J.posts(spark, sf).select("label", "id", "doc_id"), "label", "id", "3")


@register("p7_answer_columns", with_ctes(QC, "SELECT id, answer1, answer2, answer3, answer4, answer5 FROM fx_questionnaire"))
def q_p7(spark, sf):
    return P.select_prefix(J.questionnaire(spark, sf), "answer", keep=["id"])


# --------------------------------------------------------------------------- F
@register("f1_flagged_posts", with_ctes(FC, "SELECT id, label FROM fx_flagged"))
def q_f1(spark, sf):
    return J.flagged_posts(spark, sf).select("id", "label")


@register("f2_yes_no_answers", with_ctes(QC, """
SELECT id, question, value FROM (UNPIVOT (SELECT id, answer1, answer2, answer3, answer4, answer5 FROM fx_questionnaire)
  ON answer1, answer2, answer3, answer4, answer5 INTO NAME question VALUE value) WHERE value IN ('Yes', 'No')"""))
def q_f2(spark, sf):
    long = G.unpivot(J.questionnaire(spark, sf).select("id", *J.ANSWERS), ["id"], J.ANSWERS, "question", "value")
    return P.yes_no_only(long, "value")


@register("f3_frequency_range", with_ctes(QC, "SELECT id, freq_num FROM fx_questionnaire WHERE freq_num BETWEEN 0 AND 5"))
def q_f3(spark, sf):
    return P.in_range(J.questionnaire(spark, sf), "freq_num", 0, 5).select("id", "freq_num")


@register("f4_category_rows", with_ctes(PC, "SELECT pair_id, pos, post1, post2 FROM fx_comparisons WHERE category = 'taste'"))
def q_f4(spark, sf):
    return P.equals(J.comparisons(spark, sf), "category", "taste").select("pair_id", "pos", "post1", "post2")


@register("f5_kept_features", with_ctes(MC, "SELECT feature_id FROM fx_kept"))
def q_f5(spark, sf):
    return T.kept_features(J.ratings(spark, sf), J.flagged_posts(spark, sf), 0.5, value="rating")


@register("f7_positive_fold_change", with_ctes(MC, "SELECT feature, cluster, log2fc FROM fx_tests WHERE log2fc > 0"))
def q_f7(spark, sf):
    t = J.anova_segments(spark, sf).withColumn("log2fc", X.log2_ratio("mean_in_cluster", "mean_out_cluster"))
    return P.positive(t, "log2fc").select("feature", "cluster", "log2fc")


@register("f8_cluster_slice", with_ctes(MC, "SELECT feature, f, ges FROM fx_anova WHERE cluster = 3"))
def q_f8(spark, sf):
    return P.equals(J.anova_segments(spark, sf), "cluster", 3).select("feature", "f", "ges")


# --------------------------------------------------------------------------- A
@register("a1_questionnaire_prompts", with_ctes(QC, f"""
SELECT id, md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS prompt_len FROM (SELECT id,
  {render_sql(QUESTIONNAIRE_TEMPLATE, text='text', questions=q(QUESTIONS))} AS p FROM fx_posts)"""))
def q_a1(spark, sf):
    p = render(QUESTIONNAIRE_TEMPLATE, text="text", questions=F.lit(QUESTIONS))
    return J.posts(spark, sf).select("id", F.md5(p).alias("prompt_md5"), F.length(p).alias("prompt_len"))


@register("a2_pair_prompts", with_ctes(PC, f"""
SELECT pair_id, md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS prompt_len
FROM (SELECT pair_id, {render_sql(PAIR_TEMPLATE, post1='text1', post2='text2')} AS p FROM fx_pair_texts)"""))
def q_a2(spark, sf):
    p = render(PAIR_TEMPLATE, post1="text1", post2="text2")
    return J.pair_texts(spark, sf).select("pair_id", F.md5(p).alias("prompt_md5"), F.length(p).alias("prompt_len"))


_EX_SQL = """ex_rows AS (SELECT g.name AS category, c.pair_id, c.pos,
  coalesce(c.post1, '') || chr(10) || '------' || chr(10) || coalesce(c.post2, '') || chr(10) || '------' || chr(10) AS t
  FROM fx_groups g JOIN fx_comparisons c ON c.category = g.name),
fx_examples AS (SELECT category, string_agg(t, '' ORDER BY pair_id, pos) AS examples FROM ex_rows GROUP BY category)"""


@register("a8_examples_text", "WITH " + C2 + ",\n" + _EX_SQL + "\nSELECT category, examples FROM fx_examples")
def q_a8(spark, sf):
    groups = J.category_groups(spark, sf).select(F.col("name").alias("category"))
    return A.examples_text(J.comparisons(spark, sf), groups)


@register("a8_examples_by_terms", "WITH " + C2 + ",\n" + _EX_SQL.replace("FROM fx_groups g JOIN fx_comparisons c ON c.category = g.name",
    "FROM (SELECT DISTINCT name, lower(unnest(terms)) AS term FROM fx_groups) g JOIN fx_comparisons c ON c.category = g.term")
    + "\nSELECT category, examples FROM fx_examples")
def q_a8_terms(spark, sf):
    groups = J.category_groups(spark, sf).select(F.col("name").alias("category"), "terms")
    return A.examples_text(J.comparisons(spark, sf), groups, terms="terms")


@register("a3_definition_prompts", "WITH " + C2 + ",\n" + _EX_SQL + f"""
SELECT category, md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS prompt_len FROM (SELECT category,
  {render_sql(DEFINITION_TEMPLATE, category='category', examples='examples')} AS p FROM fx_examples)""")
def q_a3(spark, sf):
    groups = J.category_groups(spark, sf).select(F.col("name").alias("category"))
    ex = A.examples_text(J.comparisons(spark, sf), groups)
    p = render(DEFINITION_TEMPLATE, category="category", examples="examples")
    return ex.select("category", F.md5(p).alias("prompt_md5"), F.length(p).alias("prompt_len"))


_A10_SQL = """fx_terms AS (SELECT '[' || string_agg('''' || category || '''', ', ' ORDER BY n DESC, category) || ']' AS terms,
  count(*) AS n_terms FROM m_counts)"""


@register("a10_category_list_text", "WITH " + C2 + ",\n" + _A10_SQL + "\nSELECT terms, n_terms FROM fx_terms")
def q_a10(spark, sf):
    return A.ranked_list_text(J.comparisons(spark, sf), "category")


@register("a4_merge_prompt", "WITH " + C2 + ",\n" + _A10_SQL + f"""
SELECT md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS prompt_len FROM (SELECT
  {render_sql(MERGE_TEMPLATE, n="'10'", terms='terms')} AS p FROM fx_terms)""")
def q_a4(spark, sf):
    t = A.ranked_list_text(J.comparisons(spark, sf), "category")
    p = render(MERGE_TEMPLATE, n=F.lit("10"), terms="terms")
    return t.select(F.md5(p).alias("prompt_md5"), F.length(p).alias("prompt_len"))


_A7_SQL = """a7_rows AS (SELECT category, pos, 'featureid: ''' || feature_id || '''' || chr(10) || short_description
  || chr(10) || rating || chr(10) || '------' || chr(10) AS t FROM fx_definitions),
fx_ftext AS (SELECT category, string_agg(t, '' ORDER BY pos) AS features_text FROM a7_rows GROUP BY category)"""


@register("a7_features_text", "WITH " + C2 + ",\n" + _A7_SQL + "\nSELECT category, features_text FROM fx_ftext")
def q_a7(spark, sf):
    return A.features_text(J.definitions(spark, sf))


@register("a9_work_list", with_ctes(FC, "SELECT id, cat_pos, category FROM fx_flagged, (VALUES " + ", ".join(
    f"({i}, {q(c)})" for i, c in enumerate(fx.categories())) + ") t(cat_pos, category)"))
def q_a9(spark, sf):
    return A.work_list(J.flagged_posts(spark, sf).select("id"), fx.categories())


@register("a5_rating_prompts", "WITH " + C2 + ",\n" + _A7_SQL + f""",
wl AS (SELECT f.id, f.text, d.category FROM fx_flagged f, (SELECT DISTINCT category FROM fx_definitions) d)
SELECT w.id, w.category, md5(p) AS prompt_md5, CAST(length(p) AS INTEGER) AS prompt_len FROM (SELECT w.id, w.category,
  {render_sql(RATING_TEMPLATE, text='w.text', features='t.features_text')} AS p
  FROM wl w JOIN fx_ftext t ON t.category = w.category) w""")
def q_a5(spark, sf):
    ftext = A.features_text(J.definitions(spark, sf))
    cats = sorted(r[0] for r in ftext.select("category").collect())       # bounded: target categories
    wl = A.work_list(J.flagged_texts(spark, sf).select("id", "text"), cats)
    p = render(RATING_TEMPLATE, text="text", features="features_text")
    return (wl.join(ftext, "category")
            .select("id", "category", F.md5(p).alias("prompt_md5"), F.length(p).alias("prompt_len")))


@register("a6_scoring_prompts", "WITH " + QC + ",\n" + O.scoring_ctes("SELECT id, text FROM fx_posts") + """
SELECT id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INTEGER) AS prompt_len FROM sc_prompts""")
def q_a6(spark, sf):
    p = J.scoring_prompts(spark, J.posts(spark, sf))
    return p.select("id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_len"))


_STUB_SQL = ", ".join(
    f"""'"answer{k}": "' || CASE WHEN substr(h, {k}, 1) < '4' THEN 'Yes' ELSE 'No' END || '"'""" for k in range(1, 6))


@register("a12_annotate_stub", "WITH " + QC + ",\n" + f"""
a_p AS (SELECT id, {render_sql(QUESTIONNAIRE_TEMPLATE, text='text', questions=q(QUESTIONS))} AS p FROM fx_posts),
a_r AS (SELECT id, md5(p) AS prompt_md5, md5(p) AS h FROM a_p)
SELECT id, prompt_md5, '{{"brief_reasoning": "stub ' || substr(h, 1, 8) || '", ' || {" || ', ' || ".join(
    f'''('"answer{k}": "' || CASE WHEN substr(h, {k}, 1) < '4' THEN 'Yes' ELSE 'No' END || '"')''' for k in range(1, 6))}
  || ', "frequency": ' || CAST(('0x' || substr(h, 6, 1))::INTEGER % 5 AS VARCHAR) || '}}' AS response,
  CAST(NULL AS VARCHAR) AS error FROM a_r""")
def q_a12(spark, sf):
    p = J.posts(spark, sf).select("id", render(QUESTIONNAIRE_TEMPLATE, text="text",
                                               questions=F.lit(QUESTIONS)).alias("prompt"))
    return A.annotate(p, fx.stub_client, key="id", prefix="Here is my answer in the requested format:")


@register("a13_pending_prompts", "WITH " + QC + ",\n" + f"""
a_p AS (SELECT id, doc_id, {render_sql(QUESTIONNAIRE_TEMPLATE, text='text', questions=q(QUESTIONS))} AS p FROM fx_posts),
rec AS (SELECT md5(p) AS prompt_md5 FROM a_p WHERE {DUCKDB.h('doc_id', "'rec'", 3)} <> 0)
SELECT id, md5(p) AS prompt_md5 FROM a_p WHERE md5(p) NOT IN (SELECT prompt_md5 FROM rec)""")
def q_a13(spark, sf):
    p = J.posts(spark, sf).select("id", "doc_id", render(QUESTIONNAIRE_TEMPLATE, text="text",
                                                         questions=F.lit(QUESTIONS)).alias("prompt"))
    recorded = p.where(hash_mod("doc_id", "rec", 3) != 0).select(F.md5("prompt").alias("prompt_md5"))
    return A.pending(p, recorded).select("id", "prompt_md5")


# --------------------------------------------------------------------------- J
@register("j2_bracket_slice", with_ctes(RC, "SELECT id, cat_pos, clean FROM r_clean"))
def q_j2(spark, sf):
    return J.rating_responses(spark, sf).select("id", "cat_pos", bracket_slice("response").alias("clean"))


@register("j3_j4_comparisons", with_ctes(PC, "SELECT pair_id, pos, category, post1, post2 FROM fx_comparisons"))
def q_j34(spark, sf):
    return J.comparisons(spark, sf)


@register("j5_category_groups", with_ctes(C2, "SELECT group_pos, name, array_to_string(terms, '|') AS terms FROM fx_groups"))
def q_j5(spark, sf):
    return J.category_groups(spark, sf).select("group_pos", "name", F.array_join("terms", "|").alias("terms"))


@register("j6_x1_definitions", with_ctes(C2, """
SELECT category, pos, featurename, short_description, rating, feature_id FROM fx_definitions"""))
def q_j6(spark, sf):
    return J.definitions(spark, sf)


@register("j7_j10_ratings", with_ctes(RC, "SELECT id, feature_id, rating_raw, rating FROM fx_ratings"))
def q_j7(spark, sf):
    return J.ratings(spark, sf)


@register("j8_scores", "WITH " + QC + ",\n" + O.scoring_ctes("SELECT id, text FROM fx_posts") + """
SELECT id, feature_name, score FROM fx_scores""")
def q_j8(spark, sf):
    from tessera.operators.annotate import annotate
    prompts = J.scoring_prompts(spark, J.posts(spark, sf))
    return R.parse_scores(annotate(prompts, fx.stub_scoring_client(fx.app_feature_names())))


@register("j9_answer_booleans", with_ctes(QC, """
SELECT id, coalesce(answer1 = 'Yes', FALSE) AS answer1, coalesce(answer2 = 'Yes', FALSE) AS answer2,
  coalesce(answer3 = 'Yes', FALSE) AS answer3, coalesce(answer4 = 'Yes', FALSE) AS answer4,
  coalesce(answer5 = 'Yes', FALSE) AS answer5, TRY_CAST(trunc(TRY_CAST(frequency AS DOUBLE)) AS INTEGER) AS freq, error
FROM fx_questionnaire"""))
def q_j9(spark, sf):
    qn = J.questionnaire(spark, sf)
    return qn.select("id", *[yes_to_bool(a).alias(a) for a in J.ANSWERS], to_int("frequency").alias("freq"), "error")


# --------------------------------------------------------------------------- S5 / X
@register("s5_canonical_ids", with_ctes(RC, """
SELECT DISTINCT feature_id, regexp_replace(feature_id, '[^0-9A-Za-z_.]', '.', 'g') AS canonical_id FROM fx_ratings"""))
def q_s5(spark, sf):
    return J.ratings(spark, sf).select("feature_id", X.canonical_id("feature_id").alias("canonical_id")).distinct()


@register("x2_x3_x4_feature_text", with_ctes(RC, """
SELECT DISTINCT feature_id, split_part(feature_id, '_', 1) AS feature_group,
  CASE WHEN instr(feature_id, '_') > 0 THEN substr(feature_id, instr(feature_id, '_') + 1) ELSE feature_id END AS feature_label,
  replace(feature_id, '_', ' ') AS display_name FROM fx_ratings"""))
def q_x234(spark, sf):
    return J.ratings(spark, sf).select(
        "feature_id", X.before_first("feature_id").alias("feature_group"),
        X.after_first("feature_id").alias("feature_label"),
        X.underscores_to_spaces("feature_id").alias("display_name")).distinct()


@register("x3_post_label_from_id", with_ctes(QC, """
SELECT id, substr(id, instr(id, '_') + 1) AS group_label FROM fx_posts"""))
def q_x3(spark, sf):
    return J.posts(spark, sf).select("id", X.after_first("id").alias("group_label"))


@register("x5_x7_x8_x9_answer_codes", with_ctes(QC, """
SELECT id, a1, a2, a3, a4, a5, a1 + a2 + a3 + a4 + a5 AS sum_score,
  CASE WHEN freq_num > 0 THEN 1 ELSE 0 END AS freq_positive,
  'Cluster ' || CAST(CAST(('0x' || substr(md5(concat(CAST(doc_id AS VARCHAR), '|', 'seg')), 1, 6)) AS BIGINT) % 4 + 1
    AS VARCHAR) AS cluster_name
FROM (SELECT *, CASE answer1 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS a1, CASE answer2 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS a2,
  CASE answer3 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS a3, CASE answer4 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS a4,
  CASE answer5 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS a5 FROM fx_questionnaire)"""))
def q_x5789(spark, sf):
    qn = J.questionnaire(spark, sf)
    codes = [X.yes_no_code(a).alias(f"a{i}") for i, a in enumerate(J.ANSWERS, start=1)]
    c = qn.select("id", "doc_id", "freq_num", *codes)
    return c.select("id", "a1", "a2", "a3", "a4", "a5", X.row_sum([f"a{i}" for i in range(1, 6)]).alias("sum_score"),
                    X.positive_flag("freq_num").alias("freq_positive"),
                    X.cluster_label(hash_mod("doc_id", "seg", 4) + 1).alias("cluster_name"))


@register("x10_x11_log2fc", with_ctes(MC, """
SELECT feature, cluster, log2fc, CASE WHEN log2fc = '-inf'::DOUBLE THEN 0.0 ELSE log2fc END AS log2fc_plot FROM fx_tests"""))
def q_x1011(spark, sf):
    t = J.anova_segments(spark, sf).withColumn("log2fc", X.log2_ratio("mean_in_cluster", "mean_out_cluster"))
    return t.select("feature", "cluster", "log2fc", X.clamp_neg_inf("log2fc").alias("log2fc_plot"))


# --------------------------------------------------------------------------- G
@register("g3_category_counts", with_ctes(PC, "SELECT category, count(*) AS n FROM fx_comparisons GROUP BY category"))
def q_g3(spark, sf):
    return G.value_counts(J.comparisons(spark, sf), "category")


@register("g3_definitions_per_category", with_ctes(C2, "SELECT category, count(*) AS n FROM fx_definitions GROUP BY category"))
def q_g3b(spark, sf):
    return G.value_counts(J.definitions(spark, sf), "category")


@register("g4_median_definitions", with_ctes(C2, """
SELECT CAST(median(n) AS DOUBLE) AS median_n FROM (SELECT category, count(*) AS n FROM fx_definitions GROUP BY category)"""))
def q_g4(spark, sf):
    return G.median_group_size(J.definitions(spark, sf), "category")


@register("g5_answer_counts", with_ctes(QC, """
SELECT question, value, label, count(*) AS n FROM (UNPIVOT (SELECT label, answer1, answer2, answer3, answer4, answer5
  FROM fx_questionnaire) ON answer1, answer2, answer3, answer4, answer5 INTO NAME question VALUE value)
WHERE value IN ('Yes', 'No') GROUP BY question, value, label"""))
def q_g5(spark, sf):
    return G.answer_counts(J.questionnaire(spark, sf), J.ANSWERS, "label")


@register("g6_frequency_counts", with_ctes(QC, """
SELECT label, freq_num AS freq, count(*) AS n FROM fx_questionnaire WHERE freq_num BETWEEN 0 AND 5 GROUP BY label, freq_num"""))
def q_g6(spark, sf):
    return G.frequency_counts(J.questionnaire(spark, sf))


@register("g7_x12_cluster_means", "WITH " + QC + ",\n" + O.scoring_ctes("SELECT id, text FROM fx_posts") + """
SELECT id, cluster, mean_score FROM fx_cluster_means""")
def q_g7(spark, sf):
    return J.score_posts(spark, J.posts(spark, sf))


@register("g8_feature_score_map", "WITH " + QC + ",\n" + O.scoring_ctes("SELECT id, text FROM fx_posts") + """
SELECT id, feature_name, score FROM fx_scores WHERE feature_name IN (""" + ", ".join(
    f"'{n}'" for n in fx.app_feature_names()) + """)""")
def q_g8(spark, sf):
    from tessera.operators.annotate import annotate
    prompts = J.scoring_prompts(spark, J.posts(spark, sf))
    replies = annotate(prompts, fx.stub_scoring_client(fx.app_feature_names()))
    entries = replies.select("id", F.posexplode(F.from_json("response", "map<string,string>")).alias("pos", "k", "v"))
    maps = G.collapse_to_map(entries.withColumn("score", F.col("v").try_cast("double")), "id", "k", "score",
                             order="pos")
    lookup = fx.app_features_df(spark).select("feature_name").distinct()        # a name that the lookup lacks has no place in the map
    return maps.select("id", F.explode("m").alias("feature_name", "score")).join(lookup, "feature_name", "left_semi")


@register("g9_cluster_label_composition", with_ctes(MC, """
SELECT cluster, label, n, n * 1.0 / sum(n) OVER (PARTITION BY cluster) AS prop FROM
 (SELECT s.cluster, f.label, count(*) AS n FROM fx_seg s JOIN fx_flagged f ON f.id = s.id GROUP BY s.cluster, f.label)"""))
def q_g9(spark, sf):
    df = J.segments(spark, sf).join(J.flagged_posts(spark, sf).select("id", "label"), "id")
    return G.composition(df, "cluster", "label")


@register("g10_answer_proportions", with_ctes(MC + """,
g10_src AS (SELECT s.cluster, CASE q.answer1 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS answer1,
  CASE q.answer2 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS answer2, CASE q.answer3 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS answer3,
  CASE q.answer4 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS answer4, CASE q.answer5 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS answer5
  FROM fx_seg s JOIN fx_questionnaire q ON q.id = s.id),
g10_long AS (SELECT * FROM g10_src UNPIVOT INCLUDE NULLS (value FOR question IN (answer1, answer2, answer3, answer4,
  answer5)))""", """
SELECT question, cluster, value, n, n * 1.0 / sum(n) OVER (PARTITION BY question, cluster) AS prop FROM (
 SELECT question, cluster, coalesce(CAST(value AS VARCHAR), 'NA') AS value, count(*) AS n FROM g10_long
 GROUP BY question, cluster, coalesce(CAST(value AS VARCHAR), 'NA'))"""))
def q_g10(spark, sf):
    qn = G.yes_no_recode(J.questionnaire(spark, sf).select("id", *J.ANSWERS), J.ANSWERS)
    df = J.segments(spark, sf).join(qn, "id")
    return G.answer_proportions(df, J.ANSWERS, "cluster")


_SUM_SQL = """sums AS (SELECT s.cluster, a1 + a2 + a3 + a4 + a5 AS sum_score FROM fx_seg s JOIN (SELECT id,
  CASE answer1 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS a1, CASE answer2 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS a2,
  CASE answer3 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS a3, CASE answer4 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS a4,
  CASE answer5 WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS a5 FROM fx_questionnaire) q ON q.id = s.id)"""


def _sum_scores(spark, sf):
    qn = G.yes_no_recode(J.questionnaire(spark, sf).select("id", *J.ANSWERS), J.ANSWERS)
    return G.sum_score(J.segments(spark, sf).join(qn, "id"), J.ANSWERS)


@register("g11_sum_score_distribution", "WITH " + MC + ",\n" + _SUM_SQL + """
SELECT cluster, count(*) AS n, avg(sum_score) AS mean, stddev_samp(sum_score) / sqrt(count(*)) AS se,
  CAST(median(sum_score) AS DOUBLE) AS median FROM sums WHERE sum_score IS NOT NULL GROUP BY cluster""")
def q_g11(spark, sf):
    return G.score_distribution(_sum_scores(spark, sf), "cluster", "sum_score")


@register("g11_sum_score_histogram", "WITH " + MC + ",\n" + _SUM_SQL + """
SELECT cluster, sum_score AS score, count(*) AS n, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY cluster) AS density
FROM sums WHERE sum_score IS NOT NULL GROUP BY cluster, sum_score""")
def q_g11b(spark, sf):
    return G.score_histogram(_sum_scores(spark, sf), "cluster", "sum_score")


@register("g12_missing_counts", with_ctes(MC, """
SELECT feature_id, n_posts, n_rated, n_posts - n_rated AS n_missing FROM f_rated, n_posts"""))
def q_g12(spark, sf):
    return G.missing_counts(J.ratings(spark, sf), J.flagged_posts(spark, sf), value="rating")


@register("g13_t5_group_means", with_ctes(MC, "SELECT feature, cluster, mean_in_cluster, mean_out_cluster FROM fx_anova"))
def q_g13(spark, sf):
    return J.anova_segments(spark, sf).select("feature", "cluster", "mean_in_cluster", "mean_out_cluster")


@register("g14_distinct_clusters", with_ctes(MC, "SELECT DISTINCT cluster FROM fx_anova"))
def q_g14(spark, sf):
    return G.distinct_values(J.anova_segments(spark, sf), "cluster")


# --------------------------------------------------------------------------- W
@register("w1_top_categories", with_ctes(PC, """
SELECT category, n, rank FROM (SELECT category, n, CAST(rank() OVER (ORDER BY n DESC) AS INTEGER) AS rank
  FROM (SELECT category, count(*) AS n FROM fx_comparisons GROUP BY category)) WHERE rank <= 5"""))
def q_w1(spark, sf):
    return G.top_k_with_ties(G.value_counts(J.comparisons(spark, sf), "category"), 5, "n")


@register("w2_top_markers_by_f", with_ctes(MC, """
SELECT feature, cluster, f, rank FROM (SELECT feature, cluster, f,
  CAST(rank() OVER (PARTITION BY cluster ORDER BY f_raw DESC NULLS LAST) AS INTEGER) AS rank FROM fx_anova) WHERE rank <= 15"""))
def q_w2(spark, sf):
    return T.top_by_f(J.anova_segments(spark, sf), 15).select("feature", "cluster", "f", "rank")


@register("w3_order_by_fold_change", with_ctes(MC, """
SELECT feature, cluster, log2fc, CAST(row_number() OVER (PARTITION BY cluster ORDER BY log2fc, feature) AS INTEGER) AS "order"
FROM fx_tests"""))
def q_w3(spark, sf):
    t = J.anova_segments(spark, sf).withColumn("log2fc", X.log2_ratio("mean_in_cluster", "mean_out_cluster"))
    return G.order_within(t.select("feature", "cluster", "log2fc"), "cluster", "log2fc")


@register("w4_question_order", with_ctes(QC, """
SELECT question, value, n, CAST(list_position(['answer5', 'answer4', 'answer3', 'answer2', 'answer1'], question) AS BIGINT)
  AS level_pos FROM (SELECT question, value, count(*) AS n FROM (UNPIVOT (SELECT answer1, answer2, answer3, answer4, answer5
  FROM fx_questionnaire) ON answer1, answer2, answer3, answer4, answer5 INTO NAME question VALUE value)
  WHERE value IN ('Yes', 'No') GROUP BY question, value)"""))
def q_w4(spark, sf):
    counts = G.answer_counts(J.questionnaire(spark, sf).withColumn("all", F.lit(1)), J.ANSWERS, "all").drop("all")
    return G.with_explicit_order(counts, "question", list(reversed(J.ANSWERS)))


@register("w5_category_first", with_ctes(C2, """
SELECT category, featurename, short_description, rating FROM fx_definitions"""))
def q_w5(spark, sf):
    d = J.definitions(spark, sf).select("featurename", "short_description", "rating", "category")
    return G.reorder_first(d, "category")


# --------------------------------------------------------------------------- H
_FIDS = fx.feature_ids() + [fx.UNKNOWN_FEATURE]


@register("h1_t2_imputed_long", with_ctes(MC, "SELECT id, feature_id, value FROM fx_imputed"))
def q_h1(spark, sf):
    return J.imputed_long(spark, sf)


@register("h2_mean_by_cluster_wide", with_ctes(MC, "SELECT feature, " + ", ".join(
    f"max(CASE WHEN cluster = {k} THEN mean_in_cluster END) AS mean_{k}" for k in range(1, 5))
    + " FROM fx_anova GROUP BY feature"))
def q_h2(spark, sf):
    w = G.pivot_known(J.anova_segments(spark, sf), "feature", "cluster", [1, 2, 3, 4], "mean_in_cluster")
    return w.select("feature", *[F.col(f"`{k}`").alias(f"mean_{k}") for k in range(1, 5)])


@register("h3_ratings_wide", with_ctes(RC, "SELECT id, " + ", ".join(
    f"max(CASE WHEN feature_id = {q(f)} THEN rating END) AS \"{f}\"" for f in _FIDS) + " FROM fx_ratings GROUP BY id"))
def q_h3(spark, sf):
    return G.pivot_known(J.ratings(spark, sf), "id", "feature_id", _FIDS, "rating")


@register("h3_discovered_wide", with_ctes(RC, "SELECT * FROM (PIVOT fx_ratings ON feature_id USING max(rating) GROUP BY id)"))
def q_h3_discovered(spark, sf):
    """Ratings with whatever columns came back."""
    return G.pivot_discovered(J.ratings(spark, sf), "id", "feature_id", "rating")


@register("h4_stack_frames", with_ctes(RC, """
SELECT id, feature_id, rating, NULL::VARCHAR AS source FROM fx_ratings
UNION ALL SELECT id, 'answer1' AS feature_id, CASE answer1 WHEN 'Yes' THEN 1.0 WHEN 'No' THEN 0.0 END AS rating,
  'questionnaire' AS source FROM fx_questionnaire"""))
def q_h4(spark, sf):
    a = J.ratings(spark, sf).select("id", "feature_id", "rating")
    b = J.questionnaire(spark, sf).select("id", F.lit("answer1").alias("feature_id"),
                                          X.yes_no_code("answer1").cast("double").alias("rating"),
                                          F.lit("questionnaire").alias("source"))
    return G.stack([a, b])


# --------------------------------------------------------------------------- S1-S4 / H5 round trips
def _scratch(spark, name: str) -> str:
    import uuid
    from tessera.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex}"


@register("s2_s3_csv_roundtrip", with_ctes(QC, "SELECT id, label, text FROM fx_posts"))
def q_s23(spark, sf):
    from tessera.sources.tables import read_csv, write_table
    path = _scratch(spark, "posts-csv")
    write_table(J.posts(spark, sf).select("id", "label", "text"), path, fmt="csv")
    return read_csv(spark, path, "id string, label string, text string")


@register("s1_posts_jsonl_roundtrip", with_ctes(QC, "SELECT text, label FROM fx_posts"))
def q_s1(spark, sf):
    from tessera.sources.tables import read_posts_jsonl, write_json
    path = _scratch(spark, "posts-jsonl")
    write_json(J.posts(spark, sf).select("text", "label"), path)
    return read_posts_jsonl(spark, path)


@register("s4_groups_file_roundtrip", with_ctes(C2, """
SELECT group_pos, name FROM fx_groups"""))
def q_s4(spark, sf):
    from tessera.sources.tables import read_text_documents
    path = _scratch(spark, "groups-json")
    J.merge_response(spark, sf).coalesce(1).write.text(path)     # one reply, one file
    return R.parse_category_groups(read_text_documents(spark, path).withColumnRenamed("text", "response"),
                                   first_n=10).select("group_pos", "name")


@register("h5_partitioned_by_category", with_ctes(C2, "SELECT category, feature_id, featurename FROM fx_definitions"))
def q_h5(spark, sf):
    from tessera.sources.tables import write_table
    path = _scratch(spark, "definitions-by-category")
    write_table(J.definitions(spark, sf).select("category", "feature_id", "featurename"), path,
                partition_by=["category"])
    schema = "feature_id string, featurename string, category string"      # else "01" would be read as a number
    return spark.read.schema(schema).parquet(path).select("category", "feature_id", "featurename")


# --------------------------------------------------------------------------- K
@register("k1_clusters_join_questionnaire", with_ctes(MC, """
SELECT s.id, s.cluster, q.any_flag, q.freq_num FROM fx_seg s JOIN fx_questionnaire q ON q.id = s.id"""))
def q_k1(spark, sf):
    return J.segments(spark, sf).join(J.questionnaire(spark, sf).select("id", "any_flag", "freq_num"), "id")


@register("k2_semi_clustered", with_ctes(MC, """
SELECT id, label FROM fx_questionnaire WHERE id IN (SELECT id FROM fx_seg)"""))
def q_k2(spark, sf):
    return G.semi(J.questionnaire(spark, sf).select("id", "label"), J.segments(spark, sf), "id")


@register("k3_left_join_tests", with_ctes(MC, """
SELECT k.feature_id, a.f, a.mean_in_cluster FROM fx_kept k LEFT JOIN (SELECT * FROM fx_anova WHERE cluster = 1) a
  ON a.feature = k.feature_id"""))
def q_k3(spark, sf):
    kept = T.kept_features(J.ratings(spark, sf), J.flagged_posts(spark, sf), 0.5, value="rating")
    a = J.anova_segments(spark, sf).where("cluster = 1").select(F.col("feature").alias("feature_id"), "f",
                                                                 "mean_in_cluster")
    return kept.join(a, "feature_id", "left")


@register("k4_lookup_fanout", "WITH " + QC + ",\n" + O.scoring_ctes("SELECT id, text FROM fx_posts") + """
SELECT s.id, s.feature_name, f.cluster, s.score FROM fx_scores s JOIN app_features f ON f.feature_name = s.feature_name""")
def q_k4(spark, sf):
    from tessera.operators.annotate import annotate
    replies = annotate(J.scoring_prompts(spark, J.posts(spark, sf)), fx.stub_scoring_client(fx.app_feature_names()))
    lookup = fx.app_features_df(spark).select("feature_name", "cluster")
    return G.lookup_join(R.parse_scores(replies), lookup, "feature_name").select("id", "feature_name", "cluster", "score")


@register("k6_attach_cluster", with_ctes(MC, """
SELECT i.id, i.feature_id, i.value, s.cluster FROM fx_imputed i JOIN fx_seg s ON s.id = i.id"""))
def q_k6(spark, sf):
    return J.imputed_long(spark, sf).join(J.segments(spark, sf), "id")


# --------------------------------------------------------------------------- T
@register("t3_zscore_long", with_ctes(MC, "SELECT id, feature_id, value FROM fx_z"))
def q_t3(spark, sf):
    z, _dropped = T.zscore(J.imputed_wide(spark, sf))
    return T.to_long(z)


@register("t5_one_vs_rest_anova", with_ctes(MC, """
SELECT feature, cluster, mean_in_cluster, mean_out_cluster, dfn, dfd, f, ges FROM fx_anova"""))
def q_t5(spark, sf):
    return J.anova_segments(spark, sf).drop("f_raw")


@register("t6_bonferroni", with_ctes(MC, """
SELECT feature, cluster, 0.05 / count(*) OVER (PARTITION BY cluster) AS bonferroni_threshold FROM fx_anova"""))
def q_t6(spark, sf):
    return T.bonferroni(J.anova_segments(spark, sf)).select("feature", "cluster", "bonferroni_threshold")


PM = O.marker_ctes()


@register("t9_f_pvalues", with_ctes(PM, "SELECT feature, cluster, f, dfn, dfd, p FROM m_p"))
def q_t9(spark, sf):
    return T.with_p(J.anova_segments(spark, sf)).select("feature", "cluster", "f", "dfn", "dfd", "p")


@register("t10_spearman_pairwise", with_ctes(SC, "SELECT f1, f2, rho, n_complete FROM fx_spearman"))
def q_t10(spark, sf):
    kept = J.kept(spark, sf)
    return T.spearman_pairwise(J.ratings(spark, sf).where(F.col("feature_id").isin(kept)), value="rating")


@register("t12_fold_change_table", with_ctes(MC, "SELECT feature, " + ", ".join(
    f"max(CASE WHEN cluster = {k} THEN log2fc END) AS fc_{k}" for k in range(1, 5)) + ", " + ", ".join(
    f"max(CASE WHEN cluster = {k} THEN (CASE WHEN log2fc = '-inf'::DOUBLE THEN 0.0 ELSE log2fc END) END) AS fcp_{k}"
    for k in range(1, 5)) + " FROM fx_tests GROUP BY feature"))
def q_t12(spark, sf):
    return T.fold_change_table(J.anova_segments(spark, sf), [1, 2, 3, 4])


@register("k5_align_to_matrix_order", with_ctes(MC, "SELECT feature, " + ", ".join(
    f"max(CASE WHEN cluster = {k} THEN log2fc END) AS fc_{k}" for k in range(1, 5))
    + ", CAST(row_number() OVER (ORDER BY feature) AS INTEGER) AS matrix_pos FROM fx_tests GROUP BY feature"))
def q_k5(spark, sf):
    fc = T.fold_change_table(J.anova_segments(spark, sf), [1, 2, 3, 4], clamp_cluster=False)
    return fc.withColumn("matrix_pos", F.row_number().over(Window.orderBy("feature")))      # a row a feature


_MARKERS_SQL = """SELECT feature, cluster, mean_in_cluster, mean_out_cluster, dfn, dfd, f, ges, bonferroni_threshold, p, TRUE AS p_adj_sig,
  log2fc, rank, split_part(feature, '_', 1) AS "group", 'Cluster ' || CAST(cluster AS VARCHAR) AS cluster_name,
  replace(feature, '_', ' ') AS feature_name FROM (
 SELECT *, CAST(rank() OVER (PARTITION BY cluster ORDER BY f_raw DESC) AS INTEGER) AS rank FROM m_p
 WHERE p < bonferroni_threshold AND log2fc > 0) WHERE rank <= 15"""


@register("t13_marker_table_segments", with_ctes(PM, _MARKERS_SQL))
def q_t13(spark, sf):
    return T.marker_table(J.anova_segments(spark, sf), 15).drop("f_raw")


def _pca_inputs(spark, sf):
    z, _ = T.zscore(J.imputed_wide(spark, sf))
    return T.assemble(z)


def _all_pcs(spark, sf) -> DataFrame:
    """(id, label, pc1 .. pcp)."""
    scores, var = T.pca_scores(_pca_inputs(spark, sf))
    named = scores.select("id", *[F.col("pcs")[j].alias(f"pc{j + 1}") for j in range(len(var))])
    return J.flagged_posts(spark, sf).select("id", "label").join(named, "id")


@register("t4_pca_scores")
def q_t4(spark, sf):
    return _all_pcs(spark, sf)


@register("t4_pca_variances", with_ctes(MC, """
SELECT CAST(count(DISTINCT feature_id) AS BIGINT) AS n_components, round(CAST(count(DISTINCT feature_id) AS DOUBLE), 6) AS total_variance,
  CAST(0 AS DOUBLE) AS max_mean, CAST(0 AS DOUBLE) AS max_covariance, (SELECT count(*) FROM fx_flagged) AS n FROM fx_z"""))
def q_t4_var(spark, sf):
    """What scores of z-scored features must show: variances that sum to p, no mean, no covariance."""
    s = _all_pcs(spark, sf)
    pcs = [c for c in s.columns if c.startswith("pc")]
    total = sum((F.var_samp(c) for c in pcs[1:]), F.var_samp(pcs[0]))
    covs = [F.abs(F.covar_samp(a, b)) for i, a in enumerate(pcs) for b in pcs[i + 1:]]
    most = lambda cols: F.round(F.array_max(F.array(*cols)), 6)
    return s.agg(F.lit(len(pcs)).cast("long").alias("n_components"), F.round(total, 6).alias("total_variance"),
                 most([F.abs(F.avg(c)) for c in pcs]).alias("max_mean"), most(covs).alias("max_covariance"),
                 F.count(F.lit(1)).alias("n"))


@register("t7_kmeans_clusters")
def q_t7(spark, sf):
    clusters, _cost = T.kmeans_clusters(_pca_inputs(spark, sf), k=4, seed=1)
    return clusters


@register("t8_elbow")
def q_t8(spark, sf):
    from pyspark.ml.functions import array_to_vector
    scores, _ = T.pca_scores(_pca_inputs(spark, sf))
    top = scores.select("id", array_to_vector(F.slice("pcs", 1, 10)).alias("features"))
    return T.elbow(top, range(1, 11), seed=1)


@register("t8_total_ss", with_ctes(MC, """
SELECT CAST(1 AS INTEGER) AS k, round(CAST(count(DISTINCT feature_id) AS DOUBLE) * (count(DISTINCT id) - 1), 5) AS wss FROM fx_z"""))
def q_t8_total(spark, sf):
    """The row k = 1 on z-scores: p (n - 1)."""
    return T.elbow(_pca_inputs(spark, sf), [1]).withColumn("wss", F.round("wss", 5))


@register("t7_hartigan_wong", with_ctes(MC, """
SELECT (SELECT count(*) FROM fx_flagged) AS n, CAST(4 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS improving"""))
def q_t7_cert(spark, sf):
    """What clusters by optimal transfers must show: every post in one of four, and no single move that lowers the sum of squares."""
    return transfers.certificate(J.scaled_vectors(spark, sf), J.fitted_clusters(spark, sf))


LC = O.linkage_ctes()


@register("t11_merge_table", with_ctes(LC, "SELECT m.d AS height, m.a AS \"left\", m.b AS \"right\" FROM l_step WHERE step > 0"))
def q_t11_merges(spark, sf):
    return J.feature_merges(spark, sf)


_BLOCKS_SQL = """
SELECT unnest(q.leaves) AS feature, CAST(dense_rank() OVER (ORDER BY q.c) AS INTEGER) AS block
FROM (SELECT unnest(cl) AS q FROM l_step WHERE step = greatest((SELECT count(*) FROM l_names) - 4, 0))"""


@register("t11_feature_blocks", with_ctes(LC, _BLOCKS_SQL))
def q_t11(spark, sf):
    """Four blocks of features by complete linkage of their correlation rows."""
    names = J.feature_correlation(spark, sf).select(F.col("f1").alias("feature"))
    return L.cut(J.feature_merges(spark, sf), names, 4)


@register("t11_leaf_order", with_ctes(LC, """
SELECT leaf AS feature, CAST(pos AS INTEGER) AS position FROM (SELECT unnest(q.leaves) AS leaf, unnest(range(1, len(q.leaves) + 1)) AS pos
  FROM (SELECT unnest(cl) AS q FROM l_step WHERE step = (SELECT max(step) FROM l_step)))"""))
def q_t11_order(spark, sf):
    """Features as the tree displays them."""
    return L.leaf_order(J.feature_merges(spark, sf), L.row_means(J.feature_correlation(spark, sf)))


@register("bisecting_feature_blocks")
def q_bisecting(spark, sf):
    return T.feature_blocks(J.feature_correlation(spark, sf), k=4)


@register("g11_density", "WITH " + MC + ",\n" + _SUM_SQL + """,
d_c AS (SELECT cluster, CAST(sum_score AS DOUBLE) AS v FROM sums WHERE sum_score IS NOT NULL),
d_s AS (SELECT cluster, count(*) AS n, min(v) AS lo, max(v) AS hi, coalesce(stddev_samp(v), 0) AS sd,
  quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM d_c GROUP BY cluster),
d_h AS (SELECT *, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd WHEN abs(lo) > 0 THEN abs(lo) ELSE 1 END
  * power(n, -0.2) AS h FROM d_s),
d_g AS (SELECT DISTINCT d_h.*, lo + (hi - lo) * i / 511 AS x FROM d_h, unnest(range(512)) AS r(i))
SELECT g.cluster, round(g.x, 6) AS x, round(sum(exp(-((g.x - c.v) / g.h) * ((g.x - c.v) / g.h) / 2)) / (max(g.n) * max(g.h) * sqrt(2 * pi())), 6) AS density
FROM d_g g JOIN d_c c USING (cluster) GROUP BY g.cluster, g.x""")
def q_g11_density(spark, sf):
    d = G.score_density(_sum_scores(spark, sf), "cluster", "sum_score")
    return d.select("cluster", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@register("p1_keyless_jsonl", with_ctes(QC, """
SELECT 'ID' || CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR) || '_' || label AS id, label,
  brief_reasoning, answer1, answer2, answer3, answer4, answer5, frequency, error, freq_num, any_flag FROM fx_questionnaire"""))
def q_p1_keyless(spark, sf):
    """S1 -> P1 -> J1 on files without a key: the id is the row's number in the files."""
    from tessera.sources.tables import POSTS_SCHEMA, read_numbered_jsonl, write_json
    path = _scratch(spark, "keyless")
    write_json(fx.fx_questionnaire_responses(J.posts(spark, sf)).orderBy("doc_id").select("text", "label", "response"), path)
    posts = P.with_post_id(read_numbered_jsonl(spark, path, POSTS_SCHEMA + ", response string"), "row_index")
    return R.parse_questionnaire(posts.select("id", "label", "response"), keep=("id", "label"))


# --------------------------------------------------------------------------- scale: lineitem / events
_LI_VALS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _lineitem_long(spark, sf):
    from tessera.sources.tables import table
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_returnflag").alias("cluster"), *_LI_VALS)
    return li.unpivot(["id", "cluster"], list(_LI_VALS), "feature_id", "value")


def _anova_sql(src: str) -> str:
    return f"""a_grp AS (SELECT feature_id, cluster, count(value) AS n, avg(value) AS mean FROM {src} GROUP BY feature_id, cluster),
a_tot AS (SELECT feature_id, count(value) AS nn, sum(value) AS s, var_pop(value) * count(value) AS t FROM {src}
  GROUP BY feature_id),
a_ss AS (SELECT g.feature_id, g.cluster, g.n, g.mean, t.nn, t.t,
  CASE WHEN t.nn - g.n > 0 THEN (t.s - g.n * g.mean) / (t.nn - g.n) END AS mean_out
  FROM a_grp g JOIN a_tot t ON t.feature_id = g.feature_id),
a_ssb AS (SELECT *, n * (nn - n) / nn * (mean - mean_out) * (mean - mean_out) AS ssb FROM a_ss)
SELECT feature_id AS feature, cluster, mean AS mean_in_cluster, mean_out AS mean_out_cluster, 1 AS dfn,
  CAST(nn - 2 AS BIGINT) AS dfd, round(CASE WHEN t - ssb > 0 AND nn > 2 THEN ssb / ((t - ssb) / (nn - 2)) END, 3) AS f,
  round(CASE WHEN t > 0 THEN ssb / t END, 3) AS ges FROM a_ssb"""


@register("t5_lineitem_anova", f"""WITH li AS (SELECT l_orderkey || '-' || l_linenumber AS id, l_returnflag AS cluster,
  {", ".join(_LI_VALS)} FROM lineitem),
lv AS (SELECT id, cluster, feature_id, value FROM li UNPIVOT (value FOR feature_id IN ({", ".join(_LI_VALS)}))),
{_anova_sql("lv")}""")
def q_t5_li(spark, sf):
    return T.one_vs_rest_anova(_lineitem_long(spark, sf)).drop("f_raw")


@register("t5_events_anova", f"""WITH ev AS (SELECT event_id AS id, event_type AS cluster, 'value' AS feature_id, value
  FROM events),
{_anova_sql("ev")}""")
def q_t5_ev(spark, sf):
    from tessera.sources.tables import table
    ev = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("cluster"),
                                           F.lit("value").alias("feature_id"), "value")
    return T.one_vs_rest_anova(ev).drop("f_raw")


_LI_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS f1, '{b}' AS f2, {a} AS v1, {b} AS v2 FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
                               for a in sorted(_LI_VALS) for b in sorted(_LI_VALS) if a < b)


@register("t10_lineitem_spearman", f"""WITH s_pairs AS ({_LI_PAIRS}),
s_v AS (SELECT feature_id, value AS rating FROM (SELECT {", ".join(_LI_VALS)} FROM lineitem)
  UNPIVOT (value FOR feature_id IN ({", ".join(_LI_VALS)}))),
s_rank AS (SELECT f1, f2,
  rank() OVER (PARTITION BY f1, f2 ORDER BY v1) + (count(*) OVER (PARTITION BY f1, f2, v1) - 1) / 2.0 AS r1,
  rank() OVER (PARTITION BY f1, f2 ORDER BY v2) + (count(*) OVER (PARTITION BY f1, f2, v2) - 1) / 2.0 AS r2 FROM s_pairs),
s_upper AS (SELECT f1, f2, CASE WHEN var_pop(r1) > 0 AND var_pop(r2) > 0 THEN corr(r1, r2) END AS rho,
  count(*) AS n_complete FROM s_rank GROUP BY f1, f2)
SELECT * FROM s_upper UNION ALL SELECT f2 AS f1, f1 AS f2, rho, n_complete FROM s_upper
UNION ALL SELECT feature_id AS f1, feature_id AS f2, CASE WHEN min(rating) < max(rating) THEN 1.0 END AS rho,
  count(*) AS n_complete FROM s_v WHERE rating IS NOT NULL GROUP BY feature_id""")
def q_t10_li(spark, sf):
    """Wide source: pairs are generated inside each lineitem row (no shuffle of raw rows)."""
    from tessera.sources.tables import table
    return T.spearman_pairwise_wide(table(spark, sf, "lineitem"), list(_LI_VALS))


@register("g_lineitem_top_flags", """SELECT l_returnflag, n, rank FROM (SELECT l_returnflag, n,
  CAST(rank() OVER (ORDER BY n DESC) AS INTEGER) AS rank FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag))
WHERE rank <= 2""")
def q_g_li(spark, sf):
    from tessera.sources.tables import table
    return G.top_k_with_ties(G.value_counts(table(spark, sf, "lineitem"), "l_returnflag"), 2, "n")


# --------------------------------------------------------------------------- C jobs
_PROMPT_SQL = render_sql(QUESTIONNAIRE_TEMPLATE, text="text", questions=q(QUESTIONS))
#: The recorded replies by the hash of the rendered prompt: posts with equal texts share a prompt, and its reply.
_C1_SQL = ORACLE["g1_label_summary"].replace("fx_qresp AS (", "fx_raw AS (", 1).replace("\nq_valid AS (", f"""
c1_store AS (SELECT md5({_PROMPT_SQL}) AS prompt_md5, arg_min(response, doc_id) AS response FROM fx_raw GROUP BY ALL),
fx_qresp AS (SELECT p.doc_id, p.id, p.label, p.text, s.response FROM fx_posts p LEFT JOIN c1_store s ON s.prompt_md5 = md5({_PROMPT_SQL})),
q_valid AS (""", 1)


@register("c1_questionnaire_summary", _C1_SQL)
def q_c1(spark, sf):
    """Render every prompt, attach the stored reply by prompt hash, parse, summarise; no text is shuffled."""
    from tessera.operators.annotate import with_recorded
    from tessera.session import materialize
    prompt = render(QUESTIONNAIRE_TEMPLATE, text="text", questions=F.lit(QUESTIONS)).alias("prompt")
    replies = fx.fx_questionnaire_responses(J.posts(spark, sf))
    store = materialize(replies.groupBy(F.md5(prompt).alias("prompt_md5")).agg(F.min_by("response", "doc_id").alias("response")),
                        spark, "reply-store")
    prompts = J.posts(spark, sf).select("doc_id", "id", "label", prompt)
    parsed = R.parse_questionnaire(with_recorded(prompts, store).select("doc_id", "id", "label", "response"), keep=("doc_id", "id", "label"))
    return G.label_summary(parsed, J.ANSWERS)


_PAIR_PROMPT_SQL = render_sql(PAIR_TEMPLATE, post1="text1", post2="text2")
_DEF_PROMPT_SQL = render_sql(DEFINITION_TEMPLATE, category="category", examples="examples")
#: The same prompts in SQL; a reply belongs to the hash of its prompt.
_C2_SQL = ORACLE["j6_x1_definitions"].replace("fx_presp AS (", "fx_praw AS (", 1).replace("\nc_try AS (", f"""
c2_p AS (SELECT pair_id, md5({_PAIR_PROMPT_SQL}) AS pm FROM fx_pair_texts),
c2_store AS (SELECT pm, arg_min(response, pair_id) AS response FROM c2_p JOIN fx_praw USING (pair_id) GROUP BY pm),
fx_presp AS (SELECT pair_id, response FROM c2_p LEFT JOIN c2_store USING (pm)),
c_try AS (""", 1).replace("fx_dresp AS (", _EX_SQL + ",\nfx_draw AS (", 1).replace("\nd_arr AS (", f"""
c2_d AS (SELECT category, md5({_DEF_PROMPT_SQL}) AS pm FROM fx_examples),
c2_dstore AS (SELECT pm, arg_min(response, category) AS response FROM c2_d JOIN fx_draw USING (category) GROUP BY pm),
fx_dresp AS (SELECT group_pos, category, response FROM c2_d LEFT JOIN c2_dstore USING (pm) LEFT JOIN (SELECT group_pos, category FROM fx_draw) USING (category)),
d_arr AS (""", 1)


@register("c2_feature_discovery", _C2_SQL)
def q_c2(spark, sf):
    return J.discovery(spark, sf)


_C3_RATINGS = RC[len(FC):].replace("fx_flagged", "c3_sample").replace("fx_rresp AS (", "fx_rraw AS (", 1).replace("\nr_clean AS (", f"""
c3_p AS (SELECT f.id, f.doc_id, t.category, dense_rank() OVER (ORDER BY t.category) - 1 AS cat_pos,
  md5({render_sql(RATING_TEMPLATE, text='f.text', features='t.features_text')}) AS pm FROM c3_sample f, fx_ftext t),
c3_store AS (SELECT pm, arg_min(response, id) AS response FROM c3_p JOIN fx_rraw USING (id, category) GROUP BY pm),
fx_rresp AS (SELECT id, doc_id, category, cat_pos, response FROM c3_p LEFT JOIN c3_store USING (pm)),
r_clean AS (""", 1)


@register("c3_feature_rating_sample", "WITH " + C2 + ",\n" + _A7_SQL + """,
c3_sample AS (SELECT * FROM fx_flagged ORDER BY md5(concat(id, '|', '1k')), id LIMIT 500)""" + _C3_RATINGS + """
SELECT id, feature_id, rating FROM fx_ratings""")
def q_c3(spark, sf):
    return J.rated_sample(spark, sf)


@register("c4_subtypes_markers")
def q_c4(spark, sf):
    """F5 -> T2 -> T3 -> T7 (optimal transfers on z-scores, fitted once) -> K6 -> T5 -> T13."""
    tests = T.one_vs_rest_anova(T.clustered_long(J.imputed_wide(spark, sf), J.fitted_clusters(spark, sf)))
    return T.marker_table(tests, 15)


@register("c5_feature_correlation", with_ctes(LC, "SELECT b.*, o.position, t.* EXCLUDE (feature) FROM (" + _BLOCKS_SQL + ") b JOIN ("
          + ORACLE["t11_leaf_order"][len(with_ctes(LC, "")):] + ") o USING (feature) LEFT JOIN (" + ORACLE["t12_fold_change_table"][len(with_ctes(MC, "")):] + ") t USING (feature)"))
def q_c5(spark, sf):
    """T10 -> T11 -> T12: every feature's block and place in the heatmap, and its fold changes."""
    merges, corr = J.feature_merges(spark, sf), J.feature_correlation(spark, sf)
    blocks = L.cut(merges, corr.select(F.col("f1").alias("feature")), 4).join(L.leaf_order(merges, L.row_means(corr)), "feature")
    fc = T.fold_change_table(J.anova_segments(spark, sf), [1, 2, 3, 4])
    return blocks.join(fc, "feature", "left")


_C6_BODY = f""",
c6_q AS (SELECT id, md5({_PROMPT_SQL}) AS h FROM sc_src),
c6 AS (SELECT id, {", ".join(f"substr(h, {k}, 1) < '4' AS answer{k}" for k in range(1, 6))},
  CAST(('0x' || substr(h, 6, 1))::INTEGER % 5 AS INTEGER) AS freq FROM c6_q)
SELECT c6.*, cluster, mean_score, least(greatest(mean_score / 4.0 * 100.0, 0.0), 100.0) AS percent, CAST(NULL AS VARCHAR) AS error
FROM c6 LEFT JOIN fx_cluster_means USING (id)"""


@register("c6_x13_batch_scoring", "WITH " + QC + ",\n" + O.scoring_ctes("SELECT id, text FROM fx_posts") + _C6_BODY)
def q_c6(spark, sf):
    return J.endpoint_replies(spark, J.posts(spark, sf), QUESTIONS).withColumn("percent", X.percent_of_max("mean_score", 4.0))


@register("c7_stream_scoring", "WITH " + O.scoring_ctes(
    "SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id, text FROM conversations") + _C6_BODY)
def q_c7(spark, sf):
    from tessera.sources.tables import table
    from tessera.streaming.scoring import run_available
    src = _scratch(spark, "stream-in")
    table(spark, sf, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), "text").write.json(src)
    stream = J.endpoint_replies(spark, spark.readStream.schema("id string, text string").json(src), QUESTIONS)
    sink = _scratch(spark, "stream-out")
    run_available(stream, sink, sink + "-checkpoint")
    return spark.read.parquet(sink).withColumn("percent", X.percent_of_max("mean_score", 4.0))


@register("c7_stream_with_store", ORACLE["c7_stream_scoring"])
def q_c7_store(spark, sf):
    """C7 over a reply store: a prompt is sent once however often it comes."""
    from tessera.sources.tables import table
    from tessera.streaming.scoring import run_with_store
    src, sink = _scratch(spark, "stream-in"), _scratch(spark, "stream-out")
    table(spark, sf, "conversations").select(F.concat_ws("_", "conv_id", "turn").alias("id"), "text").write.json(src)
    csv = A.csv_text(fx.app_features_df(spark), ["feature_name", "description", "rating_options"], "row_pos").first()[0]
    run_with_store(spark.readStream.schema("id string, text string").json(src), _scratch(spark, "stream-store"), sink, sink + "-checkpoint", QUESTIONS, csv,
                   [(n, c) for n, c, _, _ in fx.APP_FEATURES], fx.stub_client, fx.stub_scoring_client(fx.app_feature_names()))
    return spark.read.parquet(sink).drop("batch").withColumn("percent", X.percent_of_max("mean_score", 4.0))


@register("x13_display_segments", with_ctes(QC, """
SELECT id, least(greatest(CAST(round(freq_num) AS INTEGER), 0), 4) AS freq_segments,
  least(greatest(freq_num / 4.0 * 100.0, 0.0), 100.0) AS freq_percent FROM fx_questionnaire WHERE freq_num IS NOT NULL"""))
def q_x13(spark, sf):
    qn = J.questionnaire(spark, sf).where(F.col("freq_num").isNotNull())
    return qn.select("id", X.filled_segments("freq_num", 4).alias("freq_segments"),
                     X.percent_of_max("freq_num", 4.0).alias("freq_percent"))


@register("a12_a13_resumable_annotation", ORACLE["a12_annotate_stub"].replace(
    """,
  CAST(NULL AS VARCHAR) AS error FROM a_r""", " FROM a_r"))
def q_a12_a13(spark, sf):
    p = J.posts(spark, sf).select("id", render(QUESTIONNAIRE_TEMPLATE, text="text",
                                               questions=F.lit(QUESTIONS)).alias("prompt"))
    return A.annotate_resumable(p, fx.stub_client, _scratch(spark, "reply-store"), key="id",
                                prefix="Here is my answer in the requested format:")


def _fitted_clusters(spark, sf):
    """T3 -> T7: the staged clusters of the z-scored imputed matrix."""
    return J.fitted_clusters(spark, sf)


@register("c4_cluster_label_composition")
def q_c4_comp(spark, sf):
    """K1 + G9 on fitted clusters: label shares per cluster."""
    df = _fitted_clusters(spark, sf).join(J.questionnaire(spark, sf).select("id", "label"), "id")
    return G.composition(df, "cluster", "label")


@register("c4_cluster_sum_scores")
def q_c4_sum(spark, sf):
    """K1 + X8/X9 + G11 on fitted clusters: questionnaire sum-score distribution."""
    qn = G.yes_no_recode(J.questionnaire(spark, sf).select("id", *J.ANSWERS), J.ANSWERS)
    df = G.sum_score(_fitted_clusters(spark, sf).join(qn, "id"), J.ANSWERS)
    return G.score_distribution(df, "cluster", "sum_score")


@register("s4_pairs_json_roundtrip", with_ctes(PC, "SELECT pair_id, id1, id2 FROM fx_pairs"))
def q_s4_pairs(spark, sf):
    """The pair draw saved as a JSON artefact and read back with a schema."""
    from tessera.sources.tables import write_json
    path = _scratch(spark, "pairs-json")
    write_json(J.pairs(spark, sf), path)
    return spark.read.schema("pair_id int, id1 string, id2 string").json(path)


@register("f6_significant_tests", with_ctes(PM, """
SELECT feature, cluster, f, p, bonferroni_threshold FROM m_p WHERE p < bonferroni_threshold"""))
def q_f6(spark, sf):
    """tests whose (rounded) p is below the Bonferroni threshold."""
    t = T.with_p(T.bonferroni(J.anova_segments(spark, sf)))
    return P.significant(t, "p", "bonferroni_threshold").select("feature", "cluster", "f", "p", "bonferroni_threshold")
