"""Input tables: the driver's parquet test tables and the reference's file
formats (S1-S4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst prunes columns and pushes filters into the scan."""
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# S1 ------------------------------------------------------------------------
POSTS_SCHEMA = "text string, label string"


def read_posts_jsonl(spark: SparkSession, path: str, schema: str = POSTS_SCHEMA) -> DataFrame:
    """JSON-lines posts with an explicit schema (no inference pass); a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_numbered_jsonl(spark: SparkSession, path: str, schema: str = POSTS_SCHEMA, index: str = "row_index") -> DataFrame:
    """JSON-lines rows with ``index``, the number of the row from 0 over all files in the order of their names.

    For files without a key. The rows are written once with their file, split and place in the task; the rows of a split are
    neighbours there, so the counts of the splits before it and a difference number them. Nothing but the splits is ordered,
    and the numbers are the same however the files are split. Blank lines are no rows; a broken line fails the read.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from tessera.session import materialize
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    where = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from")]
    placed = materialize(rows.select("*", *where, F.monotonically_increasing_id().alias("__place")), spark, "numbered")
    splits = placed.groupBy("__file", "__from").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file", "__from").rowsBetween(Window.unboundedPreceding, -1))      # a row a split
    splits = splits.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    number = (F.col("__before") + F.col("__place") - F.col("__first")).alias(index)
    return placed.join(splits, ["__file", "__from"]).select(number, *rows.columns)


#: The same on both sides, so that texts come back as they were written.
_CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "nullValue": "\\N"}


# S2 ------------------------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, quoted commas and line breaks inside quoted fields;
    a doubled quote inside a quoted field is a literal quote; outer spaces stay,
    ``\\N`` is NULL and an empty field is an empty text."""
    r = spark.read.options(**_CSV).option("multiLine", True)
    if schema:
        r = r.schema(schema)
    return r.csv(path)


# S3 ------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                mode: str = "overwrite") -> None:
    """Persist a stage's table; parquet by default, CSV with a header on request."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(**_CSV).csv(path)
    else:
        w.format(fmt).save(path)


# S4 ------------------------------------------------------------------------
def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one text value (``value``), e.g. a saved category-groups JSON."""
    return spark.read.option("wholetext", True).text(path).select(F.col("value").alias("text"))
