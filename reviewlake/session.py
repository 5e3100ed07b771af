"""Spark session helpers.

The library never creates its own cluster configuration beyond what a job
needs to be correct: UTC session time (API times are UTC), AQE on, UI off.
Checkpoint and landing folders come from ``spark.checkpoint.dir`` as set by
the cluster; a local folder is chosen only for local-mode runs that left it
unset (tests, benchmarks).
"""

from __future__ import annotations

import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

CORRECTNESS_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "reviewlake", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in CORRECTNESS_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    prepare(spark)
    return spark


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings every job depends on for correct results."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


#: rows and bytes of a shuffle that one task takes in jobs run under ``sized_shuffles``
TASK_ROWS = 250_000
TASK_BYTES = "16m"


@contextlib.contextmanager
def sized_shuffles(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside shuffle ``rows`` rows to tasks that sort in memory, however many rows there are.

    The partitions grow with the rows (never below the session's number), and adaptive execution
    joins small ones up to ``TASK_BYTES`` only, so a task's sorts don't outgrow it and spill.
    """
    named = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {k: spark.conf.get(k) for k in named}
    spark.conf.set(named[0], str(max(int(before[named[0]]), -(-rows // TASK_ROWS))))
    spark.conf.set(named[1], TASK_BYTES)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@contextlib.contextmanager
def held_setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session setting ``name`` is ``value`` for jobs started inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def use_rocksdb(spark: SparkSession) -> None:
    """State of ``transformWithState`` queries lives in RocksDB; Spark takes no other store for them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (pandas UDFs, state functions).

    The package is zipped on the driver once per application and added with
    ``addPyFile``, as ``--py-files`` would: executors fetch it from the driver, so
    the scheme of the checkpoint folder does not matter.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="reviewlake-py-"), "reviewlake")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(pkg), os.path.basename(pkg)))
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    A folder that the context already has is used as it is: setting it again would
    nest one more folder below it each time. Otherwise it is read from the session
    setting; only a local-mode session without one gets a fresh folder of its own
    (never on a cluster).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="reviewlake-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for a written table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
