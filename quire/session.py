"""Session construction and shared scratch storage.

Everything that must survive executor loss (materialised token tables, token
files, stream ledgers) is written under the folder the cluster names in
``spark.checkpoint.dir``.  A private folder is only created when that setting is
unset *and* Spark runs in local mode (tests, benchmarks).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "quire", master: str | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the library is tuned for.

    The master comes from ``master``, else from ``spark-submit`` / the Spark
    config, else ``local[$BENCH_CPUS]`` (tests and benchmarks).
    """
    from pyspark import SparkConf

    cpus = os.environ.get("BENCH_CPUS", "8")
    configured = SparkConf().get("spark.master", None)
    builder = SparkSession.builder.appName(app)
    if master or not configured:
        builder = builder.master(master or f"local[{cpus}]")
    parts = shuffle_partitions or (int(cpus) if not configured else 200)
    spark = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one only in local mode."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a shared folder is required on a cluster")
    root = tempfile.mkdtemp(prefix="quire-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet in shared storage and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing the
    tokenizer) and, unlike ``checkpoint()``, keeps column pruning and filter
    push-down for later readers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


# Bytes that go to a Python worker at a time (one row may be longer).
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession, rows: int) -> None:
    """Let at most ``rows`` rows or ``BATCH_BYTES`` go to a Python worker at a time, from now on.

    Operators that send whole texts or groups call this before their first job, so that
    a batch stays at some megabytes; a smaller number of rows is left alone, and so is a
    bound on bytes that the session has set.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def trim_memory() -> None:
    """Give what this Python worker has freed back to the system.

    Spark keeps idle workers for later tasks; without this each goes on holding the
    most that any of its batches took.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``quire`` importable in Python workers (once per SparkContext).

    Same mechanism as ``spark-submit --py-files``: the package is zipped on the
    driver and distributed by Spark with ``addPyFile``.
    """
    import hashlib
    import zipfile

    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    files = []
    for root, _dirs, names in os.walk(pkg_dir):
        for name in sorted(names):
            if name.endswith(".py"):
                files.append(os.path.join(root, name))
    digest = hashlib.sha1()
    for f in sorted(files):
        with open(f, "rb") as fh:
            digest.update(f.encode() + fh.read())
    out_dir = tempfile.mkdtemp(prefix="quire-pyfiles-")
    zpath = os.path.join(out_dir, f"quire-{digest.hexdigest()[:12]}.zip")
    with zipfile.ZipFile(zpath, "w") as zf:
        for f in sorted(files):
            zf.write(f, os.path.relpath(f, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
