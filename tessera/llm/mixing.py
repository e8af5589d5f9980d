"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves' rows of a tree domain - language - source. A token budget
flows down from the root by weights. A node takes at most what its leaves can
give in ``max_epochs`` passes; what it cannot take goes to its siblings by
weight, and only what no sibling can take is left to the parent's siblings. Each
leaf then takes whole passes over its documents and a prefix of one more, in an
order seeded by pass and id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialize, require, ship_package, unwrapped, whole_row

#: Weights of the registered query; any other language or source weighs 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}
SEED = 20
MAX_EPOCHS = 4
#: Order keys are 60-bit; their upper 10 bits part a leaf, so that no task sums up a whole leaf row by row.
KEY_BITS, PART_BITS = 60, 10

_NODE = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """One of four domains by the first byte of the source's md5."""
    return F.concat(F.lit("d"), F.pmod(F.conv(F.substring(F.md5(source), 1, 2), 16, 10).cast("int"), F.lit(4)).cast("string"))


def tokens_of(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """60-bit place of a document in a pass; a null id has the key of the text ``null``."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def weight(column: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(column) == name, F.lit(int(w))).otherwise(out)
    return out.cast("double")


def pour(nodes: DataFrame, parent: list[str], name: str, budget: str, cap: str, weigh: str, out: str) -> DataFrame:
    """Share each parent's ``budget`` among its nodes by weight, none over its ``cap``.

    Nodes in rising order of cap per weight fill up one after the other; a node is full if the level reached by then
    covers it. All others share what is left. Whole tokens, rounded down.
    """
    w = Window.partitionBy(*parent).orderBy(F.col(cap) / F.col(weigh), F.col(name))
    full_before = F.coalesce(F.sum(F.col(cap).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_from = F.sum(F.col(weigh)).over(w.rowsBetween(0, Window.unboundedFollowing))
    marked = nodes.withColumn("__full", F.col(cap) * weight_from <= (F.col(budget) - full_before) * F.col(weigh))
    every = Window.partitionBy(*parent)
    left = F.col(budget) - F.sum(F.when(F.col("__full"), F.col(cap).cast("double")).otherwise(0.0)).over(every)
    share = F.sum(F.when(F.col("__full"), 0.0).otherwise(F.col(weigh))).over(every)
    got = F.when(F.col("__full"), F.col(cap)).otherwise(F.floor(left * F.col(weigh) / share))
    return marked.withColumn(out, F.least(got, F.col(cap)).cast("long")).drop("__full")


def _slim(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    source = F.coalesce(F.col(source_col), F.lit(""))
    return docs.select(F.col(id_col).alias("__id"), domain_of(source).alias("domain"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"),
                       source.alias("source"), tokens_of(F.col(text_col)).alias("n_tokens"))


def budgets(supply: DataFrame, target: Column, max_epochs: int, domain_weights: Mapping[str, int], lang_weights: Mapping[str, int],
            source_weights: Mapping[str, int]) -> DataFrame:
    """Leaves (domain, lang, source, supply) with their whole-token ``leaf_budget``; ``target`` is over the sum of supplies."""
    leaves = supply.withColumn("__cap", F.col("supply") * max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("supply").alias("supply"), F.sum("__cap").alias("__cap"))
    domains = langs.groupBy("domain").agg(F.sum("supply").alias("supply"), F.sum("__cap").alias("__cap"))
    root = domains.agg(F.floor(target).cast("long").alias("__target"))
    d = domains.crossJoin(F.broadcast(root)).withColumn("__w", weight("domain", domain_weights)).withColumn("__root", F.lit(0))   # one row
    d = pour(d, ["__root"], "domain", "__target", "__cap", "__w", "__budget").select("domain", "__budget")
    lo = langs.join(d, "domain").withColumn("__w", weight("lang", lang_weights))
    lo = pour(lo, ["domain"], "lang", "__budget", "__cap", "__w", "__lang_budget").select("domain", "lang", "__lang_budget")
    so = leaves.join(lo, ["domain", "lang"]).withColumn("__w", weight("source", source_weights))
    return pour(so, ["domain", "lang"], "source", "__lang_budget", "__cap", "__w", "leaf_budget").select(*_NODE, "supply", "leaf_budget")


def plan(slim: DataFrame, budget_ratio: float, max_epochs: int, seed: int, weights: tuple[Mapping[str, int], ...]) -> DataFrame:
    """Leaves with ``leaf_budget``, ``__whole`` passes and ``__last``: the greatest key that the next pass still takes
    (null: none). A row of the plan is a leaf; the table is written, so that its size is known to the planner."""
    spark = slim.sparkSession
    supply = slim.groupBy(*_NODE).agg(F.sum("n_tokens").alias("supply"))
    leaves = budgets(supply, F.lit(float(budget_ratio)) * F.sum("supply"), max_epochs, *weights)
    whole = F.when(F.col("supply") > 0, F.floor(F.col("leaf_budget") / F.col("supply"))).otherwise(0).cast("long")
    leaves = leaves.withColumn("__whole", whole).withColumn("__rest", F.col("leaf_budget") - F.col("__whole") * F.col("supply"))
    leaves = materialize(leaves, spark, "leaves")
    keyed = slim.join(leaves.where("__rest > 0"), _NODE).withColumn("__key", order_key(seed, F.col("__whole"), F.col("__id")))
    keyed = materialize(keyed.select(*_NODE, "__rest", "__key", "n_tokens").withColumn("__part", F.shiftright("__key", KEY_BITS - PART_BITS)), spark, "keyed")
    sums = keyed.groupBy(*_NODE, "__rest", "__part").agg(F.sum("n_tokens").alias("__sum"))
    w = Window.partitionBy(*_NODE).orderBy("__part")
    sums = sums.withColumn("__upto", F.sum("__sum").over(w)).withColumn("__before", F.col("__upto") - F.col("__sum"))
    # the part in which the rest runs out is summed row by row; all earlier parts are taken whole
    edge = sums.where((F.col("__upto") > F.col("__rest")) & (F.col("__before") <= F.col("__rest"))).select(*_NODE, "__part", "__before")
    within = keyed.join(edge, [*_NODE, "__part"]).withColumn("__upto", F.col("__before") + F.sum("n_tokens").over(
        Window.partitionBy(*_NODE, "__part").orderBy("__key").rangeBetween(Window.unboundedPreceding, 0)))
    taken = within.where("__upto <= __rest").groupBy(*_NODE).agg(F.max("__key").alias("__in"))
    before = sums.where("__upto <= __rest").groupBy(*_NODE).agg(((F.max("__part") + 1) * F.lit(1 << (KEY_BITS - PART_BITS)) - 1).alias("__parts"))
    out = leaves.join(taken, _NODE, "left").join(before, _NODE, "left").withColumn("__last", F.greatest("__in", "__parts"))
    return materialize(out.select(*_NODE, "supply", "leaf_budget", "__whole", "__last"), spark, "plan")


def _copies(seed: int, doc_id: Column) -> Column:
    more = F.coalesce(order_key(seed, F.col("__whole"), doc_id) <= F.col("__last"), F.lit(False))
    return (F.col("__whole") + more.cast("long")).cast("int")


def mix(docs: DataFrame, *, budget_ratio: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
        lang_weights: Mapping[str, int] = LANG_WEIGHTS, source_weights: Mapping[str, int] = SOURCE_WEIGHTS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, domain, lang, source, n_tokens long, leaf_budget long, copies int) of every row; ``copies`` may be 0.

    ``budget_ratio`` sets the budget in parts of all tokens. Null languages and sources are the leaf value ''. A null
    or empty text has no tokens and is taken where its place in the order is. Rows with one id have one place and are
    taken together or not at all, so repeated rows never split; an empty table gives an empty result. Other columns
    are not read.
    """
    require(docs, id_col, text_col, lang_col, source_col)
    ship_package(docs.sparkSession)
    slim = materialize(_slim(docs, id_col, text_col, lang_col, source_col), docs.sparkSession, "slim")
    leaves = plan(slim, budget_ratio, max_epochs, seed, (domain_weights, lang_weights, source_weights))
    return slim.join(leaves, _NODE).select(F.col("__id").alias(id_col), *_NODE, "n_tokens", "leaf_budget", _copies(seed, F.col("__id")).alias("copies"))


def mixed(docs: DataFrame, *, budget_ratio: float = 1.0, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
          lang_weights: Mapping[str, int] = LANG_WEIGHTS, source_weights: Mapping[str, int] = SOURCE_WEIGHTS, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, with all columns, each as often as ``mix`` says. Texts are not shuffled while the plan,
    a row a leaf, is below the broadcast threshold; beyond it Spark joins by leaf.

    Null languages and sources are the leaf value ''; a null or empty text has no tokens and is taken where its place in the
    order is. Rows with one id are taken together or not at all, so ties and repeated rows never split. An empty table gives an
    empty result. A row travels as one value, so its columns may have any names, those of this function's own included.
    """
    require(docs, id_col, text_col, lang_col, source_col)
    ship_package(docs.sparkSession)
    slim = materialize(_slim(docs, id_col, text_col, lang_col, source_col), docs.sparkSession, "slim")
    leaves = plan(slim, budget_ratio, max_epochs, seed, (domain_weights, lang_weights, source_weights)).select(*_NODE, "__whole", "__last")
    source = F.coalesce(F.col(source_col), F.lit(""))
    row = free_name(docs, "row")
    tagged = docs.select(whole_row(docs).alias(row), F.col(id_col).alias("id"), domain_of(source).alias("domain"),
                         F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), source.alias("source"))
    out = tagged.join(leaves, _NODE).select(row, _copies(seed, F.col("id")).alias("n")).where("n > 0")
    if max_epochs > 1:
        out = out.select(row, F.explode(F.sequence(F.lit(1), F.col("n"))))
    return out.select(*unwrapped(row, docs.columns))
