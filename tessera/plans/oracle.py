"""DuckDB twins of the fixture views and derived tables, used to write the
oracle SQL for each registered query (CTE fragments, composed by name)."""

from __future__ import annotations

from tessera.plans import fixtures as fx
from tessera.plans.fixtures import DUCKDB as D
from tessera.plans.fixtures import q

Q_KEYS = fx.QUESTIONNAIRE_KEYS


def _questionnaire_parse(src: str) -> str:
    has = []
    for i, k in enumerate(Q_KEYS):
        has.append(f"CASE WHEN isobj THEN json_exists(response, '$.{k}') ELSE FALSE END AS h{i}")
    vals = []
    for i, k in enumerate(Q_KEYS):
        reached = " AND ".join(f"h{j}" for j in range(i + 1))
        vals.append(f"CASE WHEN {reached} THEN json_extract_string(response, '$.{k}') END AS {k}")
    err = "CASE WHEN NOT ok THEN 'invalid json' WHEN NOT isobj THEN 'not an object' " + " ".join(
        f"WHEN NOT h{i} THEN 'missing key: {k}'" for i, k in enumerate(Q_KEYS)) + " END AS error"
    return f"""
q_valid AS (SELECT *, coalesce(json_valid(response), FALSE) AS ok FROM {src}),
q_obj AS (SELECT *, CASE WHEN ok THEN json_type(response) = 'OBJECT' ELSE FALSE END AS isobj FROM q_valid),
q_has AS (SELECT *, {", ".join(has)} FROM q_obj),
q_vals AS (SELECT doc_id, id, label, text, {", ".join(vals)}, {err} FROM q_has),
fx_questionnaire AS (SELECT *, TRY_CAST(frequency AS DOUBLE) AS freq_num,
  CASE WHEN 'Yes' IN (coalesce(answer1, ''), coalesce(answer2, ''), coalesce(answer3, ''),
                      coalesce(answer4, ''), coalesce(answer5, '')) THEN 1 ELSE 0 END AS any_flag
  FROM q_vals)"""


def questionnaire_ctes() -> str:
    """fx_posts, fx_qresp, fx_questionnaire (J1 + X6 over every document)."""
    return f"""fx_posts AS (SELECT {", ".join(fx.posts_exprs(D))} FROM documents),
fx_qresp AS (SELECT doc_id, id, label, text, response FROM ({fx.staged_sql("fx_posts", fx.questionnaire_stages(D))})),
{_questionnaire_parse("fx_qresp")}"""


def flagged_ctes() -> str:
    return questionnaire_ctes() + """,
fx_flagged AS (SELECT doc_id, id, label, text FROM fx_questionnaire WHERE any_flag = 1)"""


def rating_ctes() -> str:
    """fx_flagged posts -> recorded rating replies -> parsed long ratings."""
    parts = []
    for i, c in enumerate(fx.categories()):
        parts.append(f"SELECT id, doc_id, {q(c)} AS category, {i} AS cat_pos, _resp{i} AS response FROM r_staged")
    union = "\nUNION ALL\n".join(parts)
    schema = '[{"featureid": "VARCHAR", "rating": "VARCHAR"}]'
    return flagged_ctes() + f""",
r_staged AS ({fx.staged_sql("(SELECT id, doc_id FROM fx_flagged)", fx.rating_stages(D))}),
fx_rresp AS ({union}),
r_clean AS (SELECT id, doc_id, cat_pos, regexp_extract(response, '(?s)\\[.*\\]', 0) AS clean FROM fx_rresp),
r_arr AS (SELECT id, doc_id, cat_pos,
  CASE WHEN coalesce(json_valid(clean), FALSE) THEN from_json(clean, '{schema}') END AS arr FROM r_clean),
r_items AS (SELECT id, doc_id, cat_pos, i AS pos, arr[i + 1] AS e
  FROM (SELECT *, unnest(range(len(arr))) AS i FROM r_arr WHERE arr IS NOT NULL)),
r_last AS (SELECT id, e.featureid AS feature_id, arg_max(e.rating, cat_pos * 100000 + pos) AS rating_raw
  FROM r_items WHERE e.featureid IS NOT NULL GROUP BY id, e.featureid),
fx_ratings AS (SELECT id, feature_id, rating_raw, TRY_CAST(rating_raw AS DOUBLE) AS rating FROM r_last)"""


def pairs_ctes(m: int = 100, seed: str = "pairs") -> str:
    """P3 + P4 + fixture pair replies + J3/J4 parse -> fx_comparisons."""
    key = f"md5(concat(id, '|', {q(seed)}))"
    schema = '[{"Category": "VARCHAR", "Post 1": "VARCHAR", "Post 2": "VARCHAR"}]'
    return flagged_ctes() + f""",
p_draws AS (SELECT id, row_number() OVER (ORDER BY {key}, id) AS rn
  FROM (SELECT id FROM fx_flagged ORDER BY {key}, id LIMIT {2 * m})),
p_half AS (SELECT floor(count(*) / 2) AS half FROM p_draws),
fx_pairs AS (SELECT CAST(a.rn AS INTEGER) AS pair_id, a.id AS id1, b.id AS id2
  FROM p_draws a, p_half h, p_draws b WHERE a.rn <= h.half AND b.rn = a.rn + h.half),
fx_pair_texts AS (SELECT p.pair_id, p.id1, p.id2, f1.text AS text1, f2.text AS text2
  FROM fx_pairs p JOIN fx_flagged f1 ON f1.id = p.id1 JOIN fx_flagged f2 ON f2.id = p.id2),
fx_presp AS (SELECT pair_id, response FROM ({fx.staged_sql("fx_pair_texts", fx.pair_stages(D))})),
c_try AS (SELECT pair_id, response,
  CASE WHEN coalesce(json_valid(response), FALSE) THEN from_json(response, '{schema}') END AS a1,
  regexp_extract(response, '(?s)\\[.*\\]', 0) AS cut FROM fx_presp),
c_arr AS (SELECT pair_id, coalesce(a1,
  CASE WHEN coalesce(json_valid(cut), FALSE) THEN from_json(cut, '{schema}') END) AS arr FROM c_try),
fx_comparisons AS (SELECT pair_id, CAST(i AS INTEGER) AS pos, lower(arr[i + 1]."Category") AS category,
  arr[i + 1]."Post 1" AS post1, arr[i + 1]."Post 2" AS post2
  FROM (SELECT *, unnest(range(len(arr))) AS i FROM c_arr WHERE arr IS NOT NULL))"""


def c2_ctes(first_n: int = 10, m: int = 100) -> str:
    """... -> category-merge reply -> groups (J5) -> definition replies -> definitions (J6 + X1)."""
    gschema = '{"categories": [{"name": "VARCHAR", "terms": ["VARCHAR"]}]}'
    dschema = '[{"featurename": "VARCHAR", "short_description": "VARCHAR", "rating": "VARCHAR"}]'
    item = ("'{\"name\": \"' || upper(substr(category, 1, 1)) || substr(category, 2) || '\", \"terms\": [\"' "
            "|| category || '\", \"' || category || ' detail\"]}'")
    return pairs_ctes(m) + f""",
m_counts AS (SELECT category, count(*) AS n FROM fx_comparisons GROUP BY category),
m_json AS (SELECT '{{"categories": [' || string_agg({item}, ', ' ORDER BY n DESC, category) || ']}}' AS j FROM m_counts),
fx_mresp AS (SELECT '"' || replace(replace(j, '\\', '\\\\'), '"', '\\"') || '"' AS response FROM m_json),
g_doc AS (SELECT json_extract_string('{{"v":' || response || '}}', '$.v') AS doc FROM fx_mresp),
g_arr AS (SELECT CASE WHEN coalesce(json_valid(doc), FALSE) THEN from_json(doc, '{gschema}') END AS s FROM g_doc),
fx_groups AS (SELECT CAST(i AS INTEGER) AS group_pos, lower(s.categories[i + 1]."name") AS name, s.categories[i + 1].terms AS terms
  FROM (SELECT s, unnest(range(least(len(s.categories), {first_n}))) AS i FROM g_arr WHERE s IS NOT NULL)),
fx_dresp AS (SELECT group_pos, name AS category, response FROM ({fx.staged_sql("fx_groups", fx.definition_stages(D, 'name'))})),
d_arr AS (SELECT group_pos, category,
  CASE WHEN coalesce(json_valid(clean), FALSE) THEN from_json(clean, '{dschema}') END AS arr
  FROM (SELECT *, regexp_extract(response, '(?s)\\[.*\\]', 0) AS clean FROM fx_dresp)),
fx_definitions AS (SELECT category, CAST(i AS INTEGER) AS pos, arr[i + 1].featurename AS featurename,
  arr[i + 1].short_description AS short_description, arr[i + 1].rating AS rating,
  replace(replace(category, ' ', '') || '_' || arr[i + 1].featurename, ' ', '_') AS feature_id, group_pos
  FROM (SELECT *, unnest(range(len(arr))) AS i FROM d_arr WHERE arr IS NOT NULL))"""


def log2fc_sql(a: str, b: str) -> str:
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} = 0 AND {b} = 0 THEN 'nan'::DOUBLE "
            f"WHEN {b} = 0 THEN (CASE WHEN {a} > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END) "
            f"WHEN {a} = 0 THEN '-inf'::DOUBLE ELSE log2({a} / {b}) END)")


def matrix_ctes(frac: float = 0.5) -> str:
    """ratings -> kept features (F5) -> median-imputed dense values (T2) ->
    z-scores (T3) -> segment clusters -> one-vs-rest ANOVA (T5)."""
    seg = D.h("doc_id", "'seg'", 4)
    return rating_ctes() + f""",
n_posts AS (SELECT count(DISTINCT id) AS n_posts FROM fx_flagged),
f_rated AS (SELECT feature_id, count(rating) AS n_rated FROM fx_ratings GROUP BY feature_id),
fx_kept AS (SELECT feature_id FROM f_rated, n_posts WHERE n_posts - n_rated < {frac} * n_posts),
meds AS (SELECT feature_id, median(rating) AS med FROM fx_ratings WHERE feature_id IN (SELECT feature_id FROM fx_kept)
  GROUP BY feature_id),
grid AS (SELECT p.id, k.feature_id FROM (SELECT DISTINCT id FROM fx_flagged) p CROSS JOIN fx_kept k),
fx_imputed AS (SELECT g.id, g.feature_id, coalesce(r.rating, m.med) AS value FROM grid g
  LEFT JOIN fx_ratings r ON r.id = g.id AND r.feature_id = g.feature_id JOIN meds m ON m.feature_id = g.feature_id),
z_stats AS (SELECT feature_id, avg(value) AS mu, stddev_samp(value) AS sd FROM fx_imputed GROUP BY feature_id),
fx_z AS (SELECT i.id, i.feature_id, (i.value - s.mu) / s.sd AS value FROM fx_imputed i JOIN z_stats s
  ON s.feature_id = i.feature_id WHERE s.sd > 0),
fx_seg AS (SELECT id, CAST({seg} + 1 AS INTEGER) AS cluster FROM fx_flagged),
a_vals AS (SELECT i.id, i.feature_id, i.value, s.cluster FROM fx_imputed i JOIN fx_seg s ON s.id = i.id),
a_grp AS (SELECT feature_id, cluster, count(value) AS n, avg(value) AS mean FROM a_vals GROUP BY feature_id, cluster),
a_tot AS (SELECT feature_id, count(value) AS nn, sum(value) AS s, var_pop(value) * count(value) AS t
  FROM a_vals GROUP BY feature_id),
a_ss AS (SELECT g.feature_id, g.cluster, g.n, g.mean, t.nn, t.t,
  CASE WHEN t.nn - g.n > 0 THEN (t.s - g.n * g.mean) / (t.nn - g.n) END AS mean_out
  FROM a_grp g JOIN a_tot t ON t.feature_id = g.feature_id),
a_ssb AS (SELECT *, n * (nn - n) / nn * (mean - mean_out) * (mean - mean_out) AS ssb FROM a_ss),
fx_anova AS (SELECT feature_id AS feature, cluster, mean AS mean_in_cluster, mean_out AS mean_out_cluster,
  1 AS dfn, CAST(nn - 2 AS BIGINT) AS dfd,
  CASE WHEN t - ssb > 0 AND nn > 2 THEN ssb / ((t - ssb) / (nn - 2)) END AS f_raw,
  round(CASE WHEN t - ssb > 0 AND nn > 2 THEN ssb / ((t - ssb) / (nn - 2)) END, 3) AS f,
  round(CASE WHEN t > 0 THEN ssb / t END, 3) AS ges FROM a_ssb),
fx_tests AS (SELECT *, {log2fc_sql('mean_in_cluster', 'mean_out_cluster')} AS log2fc FROM fx_anova)"""


def sig3_sql(p: str) -> str:
    """Three significant digits, the power in two steps as it may pass the range of doubles."""
    places = f"(2 - floor(log10({p})))"
    one, two = f"pow(10.0, floor({places} / 2))", f"pow(10.0, {places} - floor({places} / 2))"
    return f"(CASE WHEN {p} IS NULL THEN NULL WHEN {p} = 0 THEN 0.0 ELSE round({p} * {one} * {two}) / {one} / {two} END)"


def f_tail_sql(f: str, d: str) -> str:
    """Upper tail of F(1, d): the incomplete beta function I_x(d/2, 1/2) at x = d / (d + f), as its power series;
    for small f, where that is slow, one less the series of I_(1-x)(1/2, d/2)."""
    def series(x, rest, a, b, terms):
        head = f"{a} * ln({x}) + {b} * ln({rest}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})"
        term = (f"exp(lgamma({a} + {b} + n) - lgamma({a} + {b}) + lgamma({a} + 1) - lgamma({a} + 1 + n) + n * ln({x}))")
        return f"exp({head}) * list_sum(list_transform(range(0, {terms}), lambda n: {term}))"
    x, y, half = f"({d} / ({d} + {f}))", f"({f} / ({d} + {f}))", f"({d} / 2.0)"
    return (f"(CASE WHEN {f} IS NULL THEN NULL WHEN {f} <= 0 THEN 1.0 "
            f"WHEN {f} < 10 THEN 1 - {series(y, x, '0.5', half, '400')} "
            f"ELSE {series(x, y, half, '0.5', f'CAST(40 * ({d} + {f}) / {f} AS BIGINT) + 50')} END)")


def chisq_tail_sql(x: str, df: str) -> str:
    """Upper tail of chi-squared: one less the series of the lower incomplete gamma function."""
    half, a = f"({x} / 2.0)", f"({df} / 2.0)"
    term = f"exp(({a} + n) * ln({half}) - {half} - lgamma({a} + n + 1))"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN 1.0 "
            f"ELSE 1 - list_sum(list_transform(range(0, CAST(2 * {x} AS BIGINT) + 200), lambda n: {term})) END)")


def marker_ctes() -> str:
    """T6 threshold, T9 p (from the full F, three digits) and fold change of every test."""
    return matrix_ctes() + f""",
m_thr AS (SELECT *, 0.05 / count(*) OVER (PARTITION BY cluster) AS bonferroni_threshold, {f_tail_sql('f_raw', 'dfd')} AS p_raw FROM fx_tests),
m_p AS (SELECT * EXCLUDE (p_raw), {sig3_sql('p_raw')} AS p FROM m_thr)"""


def spearman_ctes() -> str:
    return matrix_ctes() + """,
s_v AS (SELECT id, feature_id, rating FROM fx_ratings WHERE rating IS NOT NULL
  AND feature_id IN (SELECT feature_id FROM fx_kept)),
s_pairs AS (SELECT a.feature_id AS f1, b.feature_id AS f2, a.rating AS v1, b.rating AS v2
  FROM s_v a JOIN s_v b ON a.id = b.id AND a.feature_id < b.feature_id),
s_rank AS (SELECT f1, f2,
  rank() OVER (PARTITION BY f1, f2 ORDER BY v1) + (count(*) OVER (PARTITION BY f1, f2, v1) - 1) / 2.0 AS r1,
  rank() OVER (PARTITION BY f1, f2 ORDER BY v2) + (count(*) OVER (PARTITION BY f1, f2, v2) - 1) / 2.0 AS r2
  FROM s_pairs),
s_upper AS (SELECT f1, f2, CASE WHEN var_pop(r1) > 0 AND var_pop(r2) > 0 THEN corr(r1, r2) END AS rho,
  count(*) AS n_complete FROM s_rank GROUP BY f1, f2),
fx_spearman AS (SELECT * FROM s_upper
  UNION ALL SELECT f2 AS f1, f1 AS f2, rho, n_complete FROM s_upper
  UNION ALL SELECT feature_id AS f1, feature_id AS f2, CASE WHEN min(rating) < max(rating) THEN 1.0 END AS rho,
    count(*) AS n_complete FROM s_v GROUP BY feature_id)"""


def linkage_ctes() -> str:
    """T11 one merge at a time: the least pair of clusters, then maxima; a state is one row with all distances and clusters."""
    return "RECURSIVE " + spearman_ctes() + """,
l_names AS (SELECT DISTINCT f1 AS f FROM fx_spearman),
l_cell AS (SELECT a.f AS f1, b.f AS f2, coalesce(s.rho, 0) AS r FROM l_names a CROSS JOIN l_names b
  LEFT JOIN fx_spearman s ON s.f1 = a.f AND s.f2 = b.f),
l_dist AS (SELECT x.f1 AS a, y.f1 AS b, round(sqrt(sum((x.r - y.r) * (x.r - y.r) ORDER BY x.f2)), 9) AS d
  FROM l_cell x JOIN l_cell y ON x.f2 = y.f2 AND x.f1 < y.f1 GROUP BY 1, 2),
l_mean AS (SELECT f1 AS f, round(avg(r), 9) AS m FROM l_cell GROUP BY 1),
l_step AS (
  SELECT 0 AS step, CAST(NULL AS STRUCT(d DOUBLE, a VARCHAR, b VARCHAR)) AS m,
    (SELECT list(struct_pack(d := d, a := a, b := b)) FROM l_dist) AS dist,
    (SELECT list(struct_pack(c := f, w := -m, leaves := [f])) FROM l_mean) AS cl
  UNION ALL
  SELECT step + 1, t,
    (SELECT list(struct_pack(d := d, a := a, b := b)) FROM (
      SELECT max(d) AS d, least(x, y) AS a, greatest(x, y) AS b FROM (
        SELECT e.d AS d, CASE WHEN e.a = t.b THEN t.a ELSE e.a END AS x, CASE WHEN e.b = t.b THEN t.a ELSE e.b END AS y
        FROM (SELECT unnest(dist) AS e)) WHERE x <> y GROUP BY 2, 3)),
    list_append(list_filter(cl, lambda q: q.c <> t.a AND q.c <> t.b), struct_pack(c := t.a, w := (l.w + r.w) / 2,
      leaves := CASE WHEN l.w <= r.w THEN l.leaves || r.leaves ELSE r.leaves || l.leaves END))
  FROM (SELECT *, list_filter(cl, lambda q: q.c = t.a)[1] AS l, list_filter(cl, lambda q: q.c = t.b)[1] AS r
        FROM (SELECT *, list_sort(dist)[1] AS t FROM l_step WHERE len(dist) > 0)))"""


def app_features_sql() -> str:
    rows = ", ".join(f"({i}, {q(n)}, {c}, {q(d)}, {q(o)})" for i, (n, c, d, o) in enumerate(fx.APP_FEATURES))
    return f"app_features AS (SELECT * FROM (VALUES {rows}) t(row_pos, feature_name, cluster, description, rating_options))"


def scoring_ctes(src_sql: str) -> str:
    """``src_sql`` yields (id, text). A6 prompt with A11 CSV text -> stub
    model reply from md5(prompt) -> J8 (last key wins) -> K4 -> G7."""
    from tessera.functions.templates import SCORING_TEMPLATE, render_sql
    names = fx.app_feature_names()

    def fld(c):
        return (f"CASE WHEN regexp_matches({c}, '[,\"\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' "
                f"ELSE {c} END")
    items = [f"'\"{n}\": ' || CAST(('0x' || substr(h, {i + 1}, 1))::INTEGER % 4 AS VARCHAR)"
             for i, n in enumerate(names)]
    dup = (f"CASE WHEN substr(h, 11, 1) = '0' THEN ', \"{names[0]}\": ' || "
           f"CAST(('0x' || substr(h, 12, 1))::INTEGER % 4 AS VARCHAR) ELSE '' END")
    unk = "CASE WHEN substr(h, 13, 1) = '0' THEN ', \"unlisted_feature\": 2' ELSE '' END"
    prompt = render_sql(SCORING_TEMPLATE, text="text", features="csv")
    return f"""{app_features_sql()},
app_csv AS (SELECT 'feature_name,description,rating_options' || chr(10) ||
  string_agg({fld('feature_name')} || ',' || {fld('description')} || ',' || {fld('rating_options')} || chr(10), ''
  ORDER BY row_pos) AS csv FROM app_features),
sc_src AS ({src_sql}),
sc_prompts AS (SELECT id, {prompt} AS prompt FROM sc_src, app_csv),
sc_replies AS (SELECT id, md5(prompt) AS prompt_md5, md5(prompt) AS h FROM sc_prompts),
sc_json AS (SELECT id, prompt_md5, '{{' || {" || ', ' || ".join(items)} || ({dup}) || ({unk}) || '}}' AS response
  FROM sc_replies),
sc_entries AS (SELECT s.id, e.key AS feature_name, e.value AS raw, e.id AS pos FROM sc_json s, json_each(s.response) e),
fx_scores AS (SELECT id, feature_name, TRY_CAST(arg_max(raw, pos) AS DOUBLE) AS score FROM sc_entries
  GROUP BY id, feature_name),
fx_cluster_means AS (SELECT s.id, f.cluster, round_even(avg(s.score), 2) AS mean_score FROM fx_scores s
  JOIN app_features f ON f.feature_name = s.feature_name GROUP BY s.id, f.cluster)"""
