"""Helpers shared by the training-data operators.

Text-heavy operators work on *chunks*: runs of documents of bounded size,
packed as one compressed Arrow stream per row.  A chunk sends small sorted
arrays to shards, gets arrays back, and is joined with them by its number, so
no row per word or byte is ever shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir, materialize
from tessera.session import ship_package as _ship

__all__ = ["materialize", "ship_package", "read", "require", "n_shards", "chunks", "unpack", "texts", "sliced",
           "planes", "unplanes", "exchange", "components", "empty"]

#: Text bytes in one chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4_000_000


#: Rows in one Arrow batch, where the session keeps Spark's default of 10,000: texts are long, and a task holds a
#: batch in several forms at a time.
ARROW_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in Python workers and keep Arrow batches of texts small."""
    _ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def require(df: DataFrame, *names: str) -> None:
    """Raise a clear error if a needed column is absent."""
    gone = [n for n in names if n not in df.columns]
    if gone:
        raise ValueError(f"missing columns {gone}; there are {df.columns}")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one value, out of the way of other names; ``unwrapped`` brings them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as make it no column of ``df``."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def unwrapped(name: str, columns: list[str]) -> list[Column]:
    """The columns that ``whole_row`` put into ``name``."""
    return [F.col(name).getField(c).alias(c) for c in columns]


def n_shards(spark: SparkSession) -> int:
    """Shards follow the cluster's shuffle partitions, which its owner sizes with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def empty(df: DataFrame) -> bool:
    """Whether a small table has no row."""
    return not df.take(1)


# Arrow columns ---------------------------------------------------------------
def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets), without a Python object per text; a null text is empty."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    col = pc.cast(col, pa.large_binary())
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lens)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


# Chunks ----------------------------------------------------------------------
def _pack(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(batches).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.RecordBatch:
    """The documents of a chunk."""
    table = pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()
    return table.to_batches()[0]


def chunks(docs: DataFrame, *columns: str, text: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """(chunk long, blob binary): the named columns and the text of all rows, in chunks of at most ``limit`` text bytes.

    The chunk number is made of the task and the position in it.
    """
    columns = (*dict.fromkeys((*columns, text)),)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, k = TaskContext.get().partitionId() << 32, 0
        held, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([_pack(held)], pa.binary())], ["chunk", "blob"])

        for piece in sliced(batches, text, limit):
            n = int(pc.sum(pc.binary_length(piece.column(text))).as_py() or 0)
            if held and size + n > limit:
                yield out()
                held, size, k = [], 0, k + 1
            held.append(piece)
            size += n
        if held:
            yield out()

    return docs.select(*columns).mapInArrow(pack, "chunk long, blob binary")


def planes(a: np.ndarray) -> bytes:
    """A sorted integer array by byte planes, highest first: the high planes of sorted values compress to almost nothing."""
    return np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(-1, a.dtype.itemsize).T).tobytes()


def unplanes(b: bytes, dtype=np.uint64) -> np.ndarray:
    """Inverse of ``planes``."""
    dtype = np.dtype(dtype)
    raw = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(dtype.itemsize, -1).T)
    return raw.view(dtype.newbyteorder(">")).ravel().astype(dtype)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """In this block, each query's shuffle files go when it ends, not when the driver happens to collect its garbage. Queries that
    share a part make it anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def discard(table: DataFrame) -> None:
    """Drop a ``bucketed`` table and the files of it; nothing may read it any more."""
    spark = table.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table._bucketed}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{table._bucketed}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """``df`` written once to the checkpoint folder in ``n`` buckets by ``key``: later groupings by it need no shuffle.

    The rows lie under a table of a fresh name in the session's catalog, which holds just the path and the buckets.
    """
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{table}"
    df.write.bucketBy(n, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._bucketed = table
    return out


@contextmanager
def in_buckets(df: DataFrame, key: str, n: int, name: str) -> Iterator[DataFrame]:
    """``bucketed`` for the length of a block: at its end the table's name leaves the catalog, its files stay. What is built
    on it must be written before."""
    table = bucketed(df, key, n, name)
    try:
        yield table
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table._bucketed}")


def exchange(sent: DataFrame, answer: Callable[[list[bytes]], list[bytes]], n: int) -> DataFrame:
    """Answer (shard int, chunk long, blob binary): ``answer`` gets all blobs of a shard and returns one for each.

    A shard holds what hashes to it, about one part in ``n`` of what all chunks send.
    """
    def shard(pdf):
        import pandas as pd
        pdf = pdf.sort_values("chunk")
        out = answer(list(pdf["blob"]))
        return pd.DataFrame({"shard": pdf["shard"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "blob": out})

    return sent.repartition(n, "shard").groupBy("shard").applyInPandas(shard, "shard int, chunk long, blob binary")


# Connected components ---------------------------------------------------------
def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of the edges (a long, b long): label is the least node reachable.

    Alternating large-star and small-star rounds; each is two joins and two
    partial aggregations of the edge list, written to the checkpoint folder.
    Nothing is collected but one count and one hash sum a round.
    """
    spark = edges.sparkSession
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, spark, "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        sides = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = sides.join(least, "u")
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else \
            near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def sign(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = sign(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        e = materialize(star(star(e, True), False), spark, "edges")
        now = sign(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def sha_hex(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def with_fields(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` with further nullable fields."""
    return T.StructType([*schema.fields, *(T.StructField(n, t, True) for n, t in fields)])
