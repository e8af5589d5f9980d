"""The registered queries opN_<name> and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, frames, jaccard, kneser_ney, licenses, middle, mixing, privacy, rules, sharding, simhash, suffix_dedup, whitening, window_dedup
from tessera.llm.common import read


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    return decontaminate.digest(decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every document: the best one, and all with their places."""
    found = licenses.scan(read(spark, sf_dir, "documents"))
    best = F.get(F.array_sort(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["template"].alias("t")))), F.lit(0))
    listed = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["first"].cast("string"), m["end"].cast("string")))
    return found.select("doc_id", "n_segments", F.size("matches").cast("long").alias("n_matches"), best["t"].alias("license"),
                        F.round(-best["d"], 6).alias("dice"), F.array_join(listed, ",").alias("matches"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken, for a budget of as many tokens as there are."""
    return mixing.mix(read(spark, sf_dir, "documents"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents labelled good and not toxic; without a toxic label (null) a document is not known to be clean."""
    return labels.where("quality = 1 and toxic = 0").select("doc_id")


def op4_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under a model of the documents labelled good and not toxic, and the verdict."""
    found = kneser_ney.classify(read(spark, sf_dir, "documents"), trusted_ids(read(spark, sf_dir, "labels")))
    return found.withColumns({c: F.round(c, 4) for c in ("perplexity", "threshold")})


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.shard(read(spark, sf_dir, "documents"), 40)


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality metrics and the cascade's verdict on every document."""
    return rules.judge(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without 50-byte strings that start in an earlier one."""
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), length=50)
    return found.select("doc_id", "n_bytes", "n_removed", F.expr("size(spans) div 2").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without 50-word windows that start in an earlier one."""
    found = window_dedup.remove_repeats(read(spark, sf_dir, "documents"), words=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = privacy.find(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in privacy.KINDS], F.sha2(privacy.listed(F.col("base")), 256).alias("base_sha256"),
                        privacy.listed(F.col("spans")).alias("spans"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four directions in which the distinct vectors spread most, scaled to unit deviation."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fill-in-the-middle form, and digests of its output and of the text rebuilt from it."""
    return middle.digests(middle.fill_in_middle(frames.framed(read(spark, sf_dir, "documents"))))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and component of every document's set of word shingles."""
    return jaccard.near_sets(read(spark, sf_dir, "documents"), words=3, percent=90)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_licenses, op3_mix, op4_perplexity, op5_shard, op6_rules, op7_suffix_dedup,
                                        op8_window_dedup, op9_privacy, op10_simhash, op11_whitening, op12_middle, op13_jaccard)}


# Oracles ---------------------------------------------------------------------
_SPACE = r"\x20\x09-\x0D"

_OP1 = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM doc_words, lens, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS r(i)),
hits AS (SELECT doc_id, item_id, i, places.n FROM places JOIN windows ON places.win = windows.win AND places.n = windows.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _case(column: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {w}.0" for k, w in sorted(weights.items())) + " ELSE 1.0 END" if weights else "1.0"


def _pour(nodes: str, parent: str, name: str, budget: str, weigh: str) -> str:
    return f"""SELECT *, least(CASE WHEN is_full THEN cap ELSE CAST(floor(
    (budget - sum(CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE 0 END) OVER (PARTITION BY {parent})) * w
    / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {parent})) AS BIGINT) END, cap) AS got
  FROM (SELECT *, cap * sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      <= (budget - coalesce(sum(CAST(cap AS DOUBLE)) OVER (PARTITION BY {parent} ORDER BY cap / w, {name}
                                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS is_full
    FROM (SELECT *, CAST({weigh} AS DOUBLE) AS w, {budget} AS budget, supply * {mixing.MAX_EPOCHS} AS cap FROM {nodes}))"""


_OP3 = f"""
WITH slim AS (
  SELECT doc_id, 'd' || CAST(('0x' || substr(md5(coalesce(source, '')), 1, 2))::BIGINT % 4 AS VARCHAR) AS domain, coalesce(lang, '') AS lang,
         coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM slim GROUP BY ALL),
lang AS (SELECT domain, lang, CAST(sum(supply) AS BIGINT) AS supply FROM leaf GROUP BY ALL),
dom AS (SELECT domain, CAST(sum(supply) AS BIGINT) AS supply, 0 AS root FROM lang GROUP BY ALL),
d AS ({_pour("dom", "root", "domain", "(SELECT CAST(sum(supply) AS BIGINT) FROM dom)", _case("domain", mixing.DOMAIN_WEIGHTS))}),
l AS ({_pour("(SELECT lang.*, d.got AS up FROM lang JOIN d USING (domain))", "domain", "lang", "up", _case("lang", mixing.LANG_WEIGHTS))}),
s AS ({_pour("(SELECT leaf.*, l.got AS up FROM leaf JOIN l USING (domain, lang))", "domain, lang", "source", "up", _case("source", mixing.SOURCE_WEIGHTS))}),
plan AS (SELECT domain, lang, source, supply, got AS leaf_budget, CASE WHEN supply > 0 THEN got // supply ELSE 0 END AS whole FROM s),
keyed AS (
  SELECT slim.*, leaf_budget, whole, leaf_budget - whole * supply AS rest,
         ('0x' || substr(md5('{mixing.SEED}|' || whole || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS k
  FROM slim JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget,
       CAST(whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k RANGE UNBOUNDED PRECEDING) <= rest
                         THEN 1 ELSE 0 END AS INTEGER) AS copies FROM keyed
"""

_OP6_SYMBOLS = "len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))"
_OP6 = f"""
WITH base AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{_SPACE}]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines FROM base),
grams AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 0) + 1)) AS r(i)),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT j) AS n FROM twice, unnest(range(i, i + 5)) AS r(j) GROUP BY rid),
m AS (
  SELECT doc_id, t, w, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST({_OP6_SYMBOLS} AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeats USING (rid)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             len(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper, len(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters,
             len(regexp_replace(t, '[^!]+', '', 'g')) AS n_marks,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_upper >= 20 AND 2 * n_upper > n_letters) OR 10 * n_marks > 3 * n_words
            OR 10 * n_stutter > 3 * n_words OR 2 * n_dup_lines > len(lines) OR word_chars > 30 * n_words) AS kept FROM v
"""

_OP8 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM w, unnest(range(1, greatest(len(w) - 49, 0) + 1)) AS r(i)),
late AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM late, unnest(range(i, i + 50)) AS r(j) GROUP BY doc_id),
words AS (SELECT doc_id, i, w[i] AS word FROM w, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM words LEFT JOIN (SELECT doc_id, unnest(js) AS i FROM gone) AS g USING (doc_id, i)
         WHERE g.doc_id IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{middle.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {middle.PLAIN_FROM} THEN 'plain'
                  WHEN h4 % 100 < {middle.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t
                  WHEN 'psm' THEN '<P>' || substr(t, 1, low) || '<S>' || substr(t, high + 1) || '<M>' || substr(t, low + 1, high - low)
                  ELSE '<S>' || substr(t, high + 1) || '<P>' || substr(t, 1, low) || '<M>' || substr(t, low + 1, high - low) END AS out FROM f),
m AS (SELECT *, strpos(out, '<P>') AS p, strpos(out, '<S>') AS s, strpos(out, '<M>') AS m FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(out) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN out
                WHEN 'psm' THEN substr(out, 4, s - 4) || substr(out, m + 3) || substr(out, s + 3, m - s - 3)
                ELSE substr(out, p + 3, m - p - 3) || substr(out, m + 3) || substr(out, 4, p - 4) END) AS restored_sha256
FROM m
"""

ORACLE = {"op1_decontaminate": _OP1, "op3_mix": _OP3, "op6_rules": _OP6, "op8_window_dedup": _OP8, "op12_middle": _OP12}
