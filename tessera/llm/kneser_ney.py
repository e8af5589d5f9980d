"""Verdicts on documents by perplexity: the limit of a language from its trusted documents, and what the models share.

The interpolated modified Kneser-Ney models themselves are in ``word_grams``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, texts

#: Shards are keys modulo this prime, modulo their number.
PRIME = 1_000_003
#: A document stays if its perplexity is not above this quantile of its language's trusted documents.
QUANTILE = 0.99
#: Documents that the trusted ones of all languages count for in each language's limit: the quantile leaves two of them out.
PRIOR = 200
#: Cells of log-perplexity in which quantiles are counted.
CELLS = 1000

_U = np.uint64


def _by_shard(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by shard and key, where each shard begins)."""
    shard = keys % _U(PRIME) % _U(n)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(n + 1).astype(_U))


def _languages(batch: pa.RecordBatch):
    """(language, rows, bytes, offsets) for each language of a chunk (id, lang, text); a null language is ''."""
    lang = np.array(batch.column(1).fill_null("").to_pylist(), object)
    for name in sorted(set(lang)):
        rows = np.flatnonzero(lang == name)
        yield name, rows, *texts(batch.column(2).take(pa.array(rows)))


def classify(docs: DataFrame, trusted: DataFrame, *, quantile: float = QUANTILE, prior: int = PRIOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id long, lang, n_bytes long, perplexity double, threshold double, kept boolean) of every row.

    ``perplexity`` is that of a word in ``word_grams``. ``threshold`` is the ``quantile`` of the language's trusted documents that
    have text, counted in cells of a thousandth of log-perplexity, so no task holds a language's documents. To them are added, with
    the weight of ``prior`` documents at every size, the trusted documents of all languages, each by how far it lies from its own language's
    median and set around this language's: a language of few documents is led by what holds elsewhere, one of many by its own. With a
    ``prior`` of 0 the limit is the language's own quantile. Null and empty texts and languages without trusted text have no
    perplexity and are kept: nothing speaks against them. A null language is a language of its own; repeated rows are scored each; rows
    that share an id are trusted together; an empty table gives an empty result; other columns are not read.
    """
    from tessera.llm import word_grams
    spark = docs.sparkSession
    scored = materialize(word_grams.perplexities(docs, trusted, id_col=id_col, text_col=text_col, lang_col=lang_col)
                         .withColumn("cell", F.ceil(F.col("nll") * CELLS)), spark, "scored")
    good = trusted.select(F.col(id_col).cast("long").alias(id_col)).distinct()
    lang = F.coalesce("lang", F.lit("")).alias("__lang")
    cells = materialize(scored.where("cell is not null").join(good, id_col, "left_semi").groupBy(lang, "cell").agg(F.count("*").alias("n")), spark, "cells")
    w = Window.partitionBy("__lang")
    upto = cells.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("all", F.sum("n").over(w))
    middle = upto.where(F.col("upto") * 2 >= F.col("all")).groupBy("__lang").agg(F.min("cell").alias("middle"))
    own = cells.select("__lang", "cell", "n", F.lit(0).cast("long").alias("m"))
    if prior:
        around = cells.join(middle, "__lang").groupBy((F.col("cell") - F.col("middle")).alias("off")).agg(F.sum("n").alias("m"))
        pool = around.agg(F.collect_list(F.struct("off", "m")).alias("pool"))       # one entry a cell that log-perplexities differ by, however many documents
        every = middle.withColumn("pool", pool.scalar()).select("__lang", "middle", F.explode("pool").alias("p"))
        own = own.unionByName(every.select("__lang", (F.col("middle") + F.col("p.off")).alias("cell"), F.lit(0).cast("long").alias("n"), F.col("p.m").alias("m")))
    both = own.groupBy("__lang", "cell").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    share = lambda over: F.sum("n").over(over) + prior * F.coalesce(F.try_divide(F.sum("m").over(over), F.sum("m").over(w)), F.lit(0.0))
    limits = materialize(both.withColumn("share", share(w.orderBy("cell")) / share(w)).where(F.col("share") >= quantile)
                         .groupBy("__lang").agg(F.min("cell").alias("limit")), spark, "limits")
    out = scored.join(limits, F.coalesce(scored["lang"], F.lit("")) == limits["__lang"], "left")
    return out.select(id_col, "lang", "n_bytes", F.exp("nll").alias("perplexity"), F.exp(F.col("limit") / CELLS).alias("threshold"),
                      F.coalesce(F.col("cell") <= F.col("limit"), F.lit(True)).alias("kept"))
