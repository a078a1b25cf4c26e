"""Spark session defaults and lineage helpers.

The library never creates a session on its own inside an operator; callers
(tests, bench, the driver entry point) use :func:`get_session` or bring their
own. Cluster settings such as ``spark.checkpoint.dir`` are read from the
session and only filled in when they are unset (local tests).
"""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC wall clock (the usage logs carry
# timestamp_ntz), adaptive execution for runtime join/skew re-planning, Arrow
# for the pandas paths.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "metercast",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` is only applied when given; on a cluster the launcher sets it.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        # a local session binds to loopback only and serves no web UI
        b = (b.config("spark.driver.host", "127.0.0.1")
              .config("spark.driver.bindAddress", "127.0.0.1")
              .config("spark.ui.enabled", "false")
              .config("spark.ui.showConsoleProgress", "false"))
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in _DEFAULTS.items():
        spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; it is used as is. Only a session
    whose tasks run in the driver's own process (tests) may leave it unset and
    then checkpoints beside its warehouse; elsewhere a missing setting is an
    error, because a machine-local folder would not survive the loss of that
    machine. Called where something is checkpointed, not for every session.
    """
    d = checkpoint_base(spark)
    spark.sparkContext.setCheckpointDir(d)
    return d


def checkpoint_base(spark: SparkSession) -> str:
    """The folder of :func:`ensure_checkpoint_dir`, for tables written there; no checkpoint folder is made in it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder "
                               "(HDFS / object store) for checkpoints")
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application.

    Functions that run in workers are pickled by reference to their module,
    so the workers have to import the package wherever the driver was
    started from. Nothing happens if it is installed with the interpreter.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_metercast_shipped", False) or "site-packages" in root:
        return
    folder = tempfile.mkdtemp(prefix="metercast-ship-")  # read by the driver only, which serves it
    try:
        path = os.path.join(folder, "metercast_package.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for d, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        f = os.path.join(d, n)
                        z.write(f, os.path.join("metercast", os.path.relpath(f, root)))
        sc.addPyFile(path)
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise
    sc._metercast_shipped = True


def tune_for_input(spark: SparkSession, input_bytes: int, split_bytes: int = 256 << 20,
                   shuffle_bytes: int = 128 << 20, min_partitions: int = 200) -> int:
    """Size scan splits and the initial shuffle partition count for an input
    of ``input_bytes`` (e.g. 100 TB on a 1000-executor cluster).

    Scans read ``split_bytes`` per task (``spark.sql.files.maxPartitionBytes``);
    shuffles start with about one partition per ``shuffle_bytes`` of input
    (aggregations shrink data, so this over-provisions) and adaptive
    execution coalesces small partitions to its advisory size and splits
    skewed ones. Returns the shuffle partition count set.
    """
    n = max(min_partitions, -(-int(input_bytes) // int(shuffle_bytes)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(int(split_bytes)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(int(shuffle_bytes)))
    return n


@contextlib.contextmanager
def task_sizes(spark: SparkSession, shuffle_bytes: int, split_bytes: int | None = None):
    """While it lasts, adaptive execution merges shuffle partitions up to ``shuffle_bytes`` and scans read at most
    ``split_bytes`` per task, for jobs whose sorts and hash tables are several times their compressed input. Smaller
    settings of the session stay."""
    as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    wanted = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": shuffle_bytes, "spark.sql.files.maxPartitionBytes": split_bytes}
    old = {k: spark.conf.get(k) for k, v in wanted.items() if v}
    try:
        for k, v in old.items():
            spark.conf.set(k, str(min(int(wanted[k]), as_bytes(v))))
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder.

    Used after expensive, non-deterministic or Python-side stages (the batch
    scorer) so lost executors recompute from the checkpoint, not from the
    model calls. ``localCheckpoint`` is never used: it dies with an executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
