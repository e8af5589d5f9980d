"""Model annotation as Spark jobs (operators A7-A13).

Prompts are columns (``tessera.functions.templates``); the model is called
inside ``mapInPandas`` with one client per partition (A12). Replies are
keyed by ``md5(prompt)`` so a re-run or a retried task reuses recorded
replies instead of re-sending (A13), and they should be materialised
(written table / reliable checkpoint) before any other use.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A7 -------------------------------------------------------------------------
def features_text(defs: DataFrame, category: str = "category", order: str = "pos",
                  fid: str = "feature_id", desc: str = "short_description", scale: str = "rating") -> DataFrame:
    """One text per category: for each definition in order, a quoted id line,
    the description, the scale and a ``------`` line. Bounded by the number
    of definitions in a category."""
    block = F.concat(F.lit("featureid: '"), F.col(fid), F.lit("'\n"), F.col(desc), F.lit("\n"), F.col(scale),
                     F.lit("\n------\n"))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("t"))))
    return defs.groupBy(category).agg(F.array_join(F.transform(items, lambda x: x["t"]), "").alias("features_text"))


# A8 -------------------------------------------------------------------------
def examples_text(comparisons: DataFrame, categories: DataFrame, on: str = "category",
                  order: Sequence[str] = ("pair_id", "pos"), terms: str | None = None) -> DataFrame:
    """Per target category, its comparison rows' two posts with ``------``
    separators, in row order. The comparison table is bounded by the pair
    sample (m pairs x items per reply), so one category's list is too. A row
    belongs to the category of its name, or with ``terms``, an array column of
    ``categories``, to each category that lists it among its terms."""
    if terms is None:
        rows = comparisons.join(categories.select(on), on)
    else:
        lists = categories.select(F.col(on).alias("_name"), F.explode(F.array_distinct(F.transform(terms, F.lower))).alias(on))
        rows = comparisons.join(lists, on).drop(on).withColumnRenamed("_name", on)
    block = F.concat(F.coalesce("post1", F.lit("")), F.lit("\n------\n"), F.coalesce("post2", F.lit("")),
                     F.lit("\n------\n"))
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], block.alias("t"))))
    return rows.groupBy(on).agg(F.array_join(F.transform(items, lambda x: x["t"]), "").alias("examples"))


# A9 -------------------------------------------------------------------------
def work_list(posts: DataFrame, categories: Sequence[str], key: str = "id") -> DataFrame:
    """Every post x every category, by exploding a literal array (map-side:
    no join, no shuffle). ``cat_pos`` keeps the category order."""
    arr = F.array(*[F.struct(F.lit(i).alias("cat_pos"), F.lit(c).alias("category")) for i, c in enumerate(categories)])
    return posts.select("*", F.inline(arr))


# A10 ------------------------------------------------------------------------
def text_literal(c: Column) -> Column:
    """A text as Python writes it in a list: in double quotes where it holds single ones only, else in single ones; backslash,
    tab, line feed and carriage return are escaped."""
    body = c
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def ranked_list_text(df: DataFrame, col: str = "category") -> DataFrame:
    """One row: the distinct values by descending count (ties by value) as a
    list literal ``['a', 'b']``; NULL is no value. Bounded by the number of distinct values."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg_n"), F.col(col).alias("v"))))
    txt = F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: text_literal(x["v"])), ", "), F.lit("]"))
    return counts.agg(txt.alias("terms"), F.count(F.lit(1)).alias("n_terms"))


# A11 ------------------------------------------------------------------------
def csv_field(c) -> F.Column:
    """Minimal CSV quoting: quote when the value has a comma, quote or line
    break; double any inner quote."""
    x = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    needs = x.rlike('[,"\\r\\n]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_text(df: DataFrame, cols: Sequence[str], order: str) -> DataFrame:
    """One row: header + one CSV line per row in ``order`` (bounded lookup)."""
    line = F.concat_ws(",", *[csv_field(c) for c in cols])
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    header = ",".join(cols) + "\n"
    return df.agg(F.concat(F.lit(header), F.array_join(F.transform(items, lambda x: F.concat(x["t"], F.lit("\n"))), ""))
                  .alias("csv"))


# A12 ------------------------------------------------------------------------
ClientFactory = Callable[[], Callable[[list[dict]], str]]

#: What an Arrow batch of prompts holds at most where the session keeps Spark's defaults (10,000 rows, 64 MB), as a worker
#: has a batch in several forms at a time: name of the setting -> (Spark's default, ours).
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
                "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow batches; limits that the session has set itself stay."""
    for name, (default, ours) in ARROW_LIMITS.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, ours)


def annotate(prompts: DataFrame, client_factory: ClientFactory, key: str = "id", prompt: str = "prompt",
             prefix: str | None = None, partitions: int | None = None, model: str | None = None,
             max_tokens: int | None = None, concurrency: int = 8, attempts: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """Call the model once per row inside the executors.

    ``client_factory(**options)`` runs once per partition and returns ``call(messages)
    -> text``; ``model`` and ``max_tokens`` are its options, where given. Messages are a
    user turn and an optional assistant prefix. A task has up to ``concurrency`` calls
    open at a time over bounded batches (``small_batches``), and a call is tried ``attempts`` times; the last exception goes to
    ``error`` and the row is kept. ``partitions`` spreads the rows (one shuffle, keyed by
    prompt hash). A NULL prompt is not sent: NULL reply, error ``no prompt``.
    Returns (key, prompt_md5, response, error) and the string columns named in ``keep``.
    """
    small_batches(prompts.sparkSession)
    options = {k: v for k, v in (("model", model), ("max_tokens", max_tokens)) if v is not None}
    src = prompts.select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt"), *keep)
    if partitions:
        src = src.repartition(partitions, F.md5("prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor
        one = _sender(client_factory(**options), prefix, attempts)
        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for b in batches:
                rows = list(pool.map(one, b["prompt"]))                 # in the order of the rows
                yield pd.DataFrame({"key": b["key"], **{n: pd.Series([r[k] for r in rows], index=b.index, dtype=object)
                                                        for k, n in enumerate(("prompt_md5", "response", "error"))},
                                    **{c: b[c] for c in keep}})

    res = src.mapInPandas(run, ", ".join(f"`{c}` string" for c in ("key", "prompt_md5", "response", "error", *keep)))
    return res.withColumnRenamed("key", key)


def _sender(call, prefix: str | None, attempts: int):
    """prompt -> (prompt_md5, reply, error): ``attempts`` calls at most, the last exception becomes the error."""
    def one(p: str | None) -> tuple[str | None, str | None, str | None]:
        if p is None:
            return None, None, "no prompt"
        msgs = [{"role": "user", "content": p}]
        if prefix:
            msgs.append({"role": "assistant", "content": prefix})
        error = None
        for _ in range(attempts):
            try:
                return hashlib.md5(p.encode("utf-8")).hexdigest(), call(msgs), None
            except Exception as e:  # noqa: BLE001 - recorded per row
                error = f"{type(e).__name__}: {e}"
        return hashlib.md5(p.encode("utf-8")).hexdigest(), None, error
    return one


def annotate_each(rows: DataFrame, calls: dict[str, tuple[Column, ClientFactory, str | None]], key: str = "id", concurrency: int = 8,
                  attempts: int = 3) -> DataFrame:
    """Several model calls for every row in one pass: (key, <name>_reply, <name>_error) for each name in ``calls``, which holds
    the prompt, the client factory and the assistant prefix. Texts go to the workers once, and only replies come back.
    Everything else is as in ``annotate``."""
    small_batches(rows.sparkSession)
    names = list(calls)
    src = rows.select(F.col(key).cast("string").alias("key"), *[calls[n][0].alias(n) for n in names])
    asked = {n: calls[n][1:] for n in names}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from concurrent.futures import ThreadPoolExecutor
        send = {n: _sender(factory(), prefix, attempts) for n, (factory, prefix) in asked.items()}

        def each(prompts: tuple) -> list:
            return [send[n](p) for n, p in zip(names, prompts)]

        with ThreadPoolExecutor(max_workers=concurrency) as pool:
            for b in batches:
                got = list(pool.map(each, zip(*(b[n] for n in names))))
                yield pd.DataFrame({"key": b["key"], **{f"{n}_{what}": pd.Series([r[i][k] for r in got], index=b.index, dtype=object)
                                                        for i, n in enumerate(names) for k, what in ((1, "reply"), (2, "error"))}})

    schema = ", ".join(["key string", *(f"`{n}_{what}` string" for n in names for what in ("reply", "error"))])
    return src.mapInPandas(run, schema).withColumnRenamed("key", key)


# A13 ------------------------------------------------------------------------
def with_recorded(prompts: DataFrame, recorded: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Attach recorded replies by prompt hash (left join, NULL = not yet sent)."""
    p = prompts.withColumn("prompt_md5", F.md5(prompt))
    return p.join(recorded.select("prompt_md5", "response"), "prompt_md5", "left")


def pending(prompts: DataFrame, recorded: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Prompts without a recorded reply (left anti join on the prompt hash)."""
    p = prompts.withColumn("prompt_md5", F.md5(prompt))
    return p.join(recorded.select("prompt_md5"), "prompt_md5", "left_anti")


def annotate_resumable(prompts: DataFrame, client_factory: ClientFactory, store_path: str, key: str = "id",
                       prompt: str = "prompt", prefix: str | None = None, partitions: int | None = None, **calls) -> DataFrame:
    """A12 + A13 as a resumable job over a reply store (parquet, keyed by md5(prompt)).

    Only prompts without a stored reply are sent, each distinct one once;
    successful replies are appended to the store before anything else reads them
    (the commit protocol keeps one attempt per task), and failed calls are left
    out so a re-run retries them. The store is missing only if its path is: any
    other fault in reading it is raised, and nothing is sent. Of several stored
    replies to a prompt the least counts. ``calls`` go to ``annotate``. Returns
    every prompt with its stored reply (NULL if still missing): (key, prompt_md5,
    response).
    """
    from pyspark.errors import AnalysisException
    spark = prompts.sparkSession
    p = prompts.select(key, prompt).withColumn("prompt_md5", F.md5(prompt))
    distinct = p.where(F.col(prompt).isNotNull()).groupBy("prompt_md5").agg(F.first(prompt).alias(prompt))
    try:
        done = spark.read.parquet(store_path).select("prompt_md5")
        todo = distinct.join(done, "prompt_md5", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        todo = distinct                  # no store yet: everything is pending
    new = annotate(todo.withColumnRenamed("prompt_md5", "hash"), client_factory, key="hash", prompt=prompt,
                   prefix=prefix, partitions=partitions, **calls)
    new.where(F.col("error").isNull()).select("prompt_md5", "response").write.mode("append").parquet(store_path)
    store = spark.read.parquet(store_path).groupBy("prompt_md5").agg(F.min("response").alias("response"))
    return p.select(key, "prompt_md5").join(store, "prompt_md5", "left")
