"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults a cluster deployment overrides through spark-defaults / submit flags.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera") -> SparkSession:
    """Return the active session or build one with tessera's defaults.

    ``master`` and ``shuffle_partitions`` are only applied when a new local
    session is built (tests, bench); a cluster session keeps its own settings.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        ship_package(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
    if os.environ.get("TESSERA_EVENT_LOG_DIR"):          # bench: per-stage metrics from the event log
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", os.environ["TESSERA_EVENT_LOG_DIR"])
                   .config("spark.eventLog.compress", "false"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``."""
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only when it is unset
    (local tests) create a private scratch folder for it."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


def materialize(df, spark: SparkSession | None = None, name: str = "stage"):
    """Cut lineage by writing the table as parquet into the shared folder
    named by ``spark.checkpoint.dir`` and reading it back.

    Unlike an eager ``checkpoint()`` of an unpersisted plan (computed once for
    the count and again for the write), the plan runs once; later readers get
    column pruning and filter pushdown on the stage table, and a lost
    executor re-reads files instead of recomputing upstream work.
    """
    import uuid
    spark = spark or df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def spread(df):
    """Rows dealt evenly over all cores, for costly work on narrow rows: a file of one row group, or a few small ones, is read
    by one task or a few, however many cores there are."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def fingerprint(spark: SparkSession, paths: list[str], *parameters: object) -> str:
    """Hash of the names, sizes and times of the files under ``paths``, of ``parameters``, and of this package's code."""
    import hashlib
    h = hashlib.sha256(repr((parameters, _code_digest())).encode())
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(conf).listFiles(at, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        h.update(repr(sorted(found)).encode())
    return h.hexdigest()[:24]


def resumed(spark: SparkSession, name: str, key: str, build):
    """A stage table under ``key``, which says what it is made of: read where a run has finished it, else built and written.

    The commit mark is the file that Spark writes last; a table without it was torn and is written anew. So a job that
    was stopped goes on, in any later session, after the last stage that it finished.
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{name}-{key}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _package_files() -> list[str]:
    pkg = os.path.dirname(os.path.abspath(__file__))
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(pkg) for f in fs if f.endswith(".py"))


def _code_digest() -> str:
    import hashlib
    return hashlib.md5(b"".join(open(f, "rb").read() for f in _package_files())).hexdigest()[:12]


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tessera`` importable in every Python worker (mapInPandas
    model calls, pandas UDFs): zip the package once per application and
    register it with ``addPyFile``, as ``spark-submit --py-files`` would.
    The zip goes under ``spark.checkpoint.dir`` when that is a local or
    mounted path; Spark then serves it to the executors."""
    import zipfile
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    pkg, files, digest = os.path.dirname(os.path.abspath(__file__)), _package_files(), _code_digest()
    base = ensure_checkpoint_dir(spark)
    if "://" in base and not base.startswith("file://"):
        base = tempfile.mkdtemp(prefix="tessera-code-")      # non-POSIX store: ship from the driver
    base = base.replace("file://", "")
    os.makedirs(os.path.join(base, "code"), exist_ok=True)
    target = os.path.join(base, "code", f"tessera-{digest}.zip")
    if not os.path.exists(target):
        tmp = f"{target}.{os.getpid()}.part"
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            for f in files:
                z.write(f, os.path.join("tessera", os.path.relpath(f, pkg)))
        os.replace(tmp, target)
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
