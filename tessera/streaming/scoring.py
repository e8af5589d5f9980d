"""Score posts as they arrive (Structured Streaming).

The two request endpoints become one row-local job, for a table (C6) and for
an append-only stream alike: posts -> questionnaire and scoring prompts (A1, A6)
-> model calls in the partition (A12, ``mapInPandas``) -> answers (J1, J9) and
per-post cluster means, with higher-order functions over the bounded lookup
(J8, K4 + G7 without a shuffle or cross-row state). A stream goes to a parquet
sink with a checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.parsing import json_valid, parse_object_fields, parse_score_map, to_double, to_int, yes_to_bool
from tessera.functions.templates import QUESTIONNAIRE_TEMPLATE, SCORING_TEMPLATE, render
from tessera.operators.annotate import annotate_each, annotate_resumable
from tessera.operators.responses import ANSWER_COLS, QUESTIONNAIRE_KEYS


def _last_value(m: Column, name: str) -> Column:
    """Value of the last occurrence of ``name`` in a parsed reply map."""
    hits = F.filter(F.reverse(F.map_entries(m)), lambda e: e["key"] == F.lit(name))
    return F.try_element_at(hits, F.lit(1))["value"]      # absent name -> NULL, never an error


def row_cluster_means(replies: DataFrame, lookup: Sequence[tuple[str, int]], key: str = "id") -> DataFrame:
    """(key, response) -> (key, cluster, mean_score): for each cluster, the
    mean of the numeric scores of its listed features present in the reply,
    rounded half-even to 2 places; clusters with no listed feature present
    are omitted (the inner join of the batch form drops them too)."""
    staged = replies.select(key, parse_score_map(F.col("response")).alias("_m")).where(F.col("_m").isNotNull())
    return staged.select(key, F.inline(_means("_m", lookup)))


def _means(scores: str, lookup: Sequence[tuple[str, int]]) -> Column:
    """Array of (cluster, mean_score) of a parsed reply map."""
    rows = []
    for c in sorted({c for _, c in lookup}):
        names = [n for n, k in lookup if k == c]
        listed = F.arrays_overlap(F.map_keys(F.col(scores)), F.array(*[F.lit(n) for n in names]))
        vals = F.filter(F.array(*[to_double(_last_value(F.col(scores), n)) for n in names]), lambda v: v.isNotNull())
        mean = F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, v: a + v) / F.size(vals))
        rows.append(F.when(listed, F.struct(F.lit(c).alias("cluster"), F.bround(mean, 2).alias("mean_score"))))
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def both_endpoints(posts: DataFrame, questions: str, features_csv: str, lookup: Sequence[tuple[str, int]],
                   questionnaire_client, scoring_client, key: str = "id", prefix: str | None = None) -> DataFrame:
    """(key, answer1..5 boolean, freq int, cluster, mean_score, error): a row per post and cluster of its scored
    features; a post without any has one row without a cluster. Every post is kept: ``error`` tells what failed,
    the call or the reading of its reply, by endpoint."""
    asked = _calls(questions, features_csv, questionnaire_client, scoring_client, prefix)
    return endpoint_rows(annotate_each(posts, asked, key), lookup, key)


def _calls(questions: str, features_csv: str, questionnaire_client, scoring_client, prefix: str | None) -> dict:
    return {"q": (render(QUESTIONNAIRE_TEMPLATE, text="text", questions=F.lit(questions)), questionnaire_client, prefix),
            "f": (render(SCORING_TEMPLATE, text="text", features=F.lit(features_csv)), scoring_client, None)}


def endpoint_rows(replies: DataFrame, lookup: Sequence[tuple[str, int]], key: str = "id") -> DataFrame:
    """The result rows of replies (key, q_reply, q_error, f_reply, f_error)."""
    read = replies.withColumn("_valid", F.coalesce(json_valid("q_reply"), F.lit(False))).withColumn("_m", parse_score_map("f_reply"))
    read = read.select(key, "q_error", "f_error", "_m", *parse_object_fields("q_reply", QUESTIONNAIRE_KEYS, valid="_valid"))
    bad_q = F.concat(F.lit("questionnaire: "), F.coalesce("q_error", "error"))
    bad_f = F.concat(F.lit("features: "), F.coalesce("f_error", F.when(F.col("_m").isNull(), F.lit("invalid json"))))
    told = F.concat_ws("; ", bad_q, bad_f)
    return (read.select(key, *[yes_to_bool(a).alias(a) for a in ANSWER_COLS], to_int("frequency").alias("freq"),
                        F.when(told != "", told).alias("error"), _means("_m", lookup).alias("_means"))
            .select(key, *ANSWER_COLS, "freq", "error", F.inline_outer("_means")))


def run_available(stream: DataFrame, sink_dir: str, checkpoint_dir: str) -> None:
    """Process everything available now into a parquet sink (append), then stop."""
    q = (stream.writeStream.format("parquet").outputMode("append").option("path", sink_dir)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()


def run_with_store(stream: DataFrame, store_dir: str, sink_dir: str, checkpoint_dir: str, questions: str, features_csv: str,
                   lookup: Sequence[tuple[str, int]], questionnaire_client, scoring_client, key: str = "id", prefix: str | None = None) -> None:
    """As ``both_endpoints`` into a parquet sink, over a store of replies (A13): everything available now, then stop.

    A micro-batch sends each distinct prompt that the store lacks once, and appends the replies before it reads
    them; so a prompt that came before in the stream, or in an earlier run, is not sent again. A batch that is repeated
    after a stop finds its replies in the store and replaces its own folder of the sink (``batch=<number>``). Failed calls
    are not stored: their posts carry the error, and the prompt is sent again when it comes again.
    """
    calls = _calls(questions, features_csv, questionnaire_client, scoring_client, prefix)

    def score(batch: DataFrame, number: int) -> None:
        from tessera.session import materialize
        posts = materialize(batch.select(key, *[prompt.alias(n) for n, (prompt, *_) in calls.items()]), batch.sparkSession, "micro-batch")
        replies = posts.select(key)
        for n, (_, client, lead) in calls.items():
            got = annotate_resumable(posts.select(key, F.col(n).alias("prompt")), client, f"{store_dir.rstrip('/')}/{n}", key=key, prefix=lead)
            told = F.when(F.col("prompt_md5").isNull(), F.lit("no prompt")).when(F.col("response").isNull(), F.lit("no reply"))
            replies = replies.join(got.select(key, F.col("response").alias(f"{n}_reply"), told.alias(f"{n}_error")), key)
        endpoint_rows(replies, lookup, key).write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={number}")

    stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination()
