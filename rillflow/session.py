"""Session building and the shared scratch area."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import SparkSession

# Settings for long-running jobs. RocksDB keeps streaming state off the heap;
# local session merging shrinks session rows before their shuffle.
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "rillflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with ``JOB_CONF``; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in JOB_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would lose state with the executor that wrote it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="rillflow-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared root, removed when the driver exits."""
    path = f"{shared_root(spark).rstrip('/')}/rillflow/{label}-{uuid.uuid4().hex}"
    fs, hadoop = _fs(spark, path)
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def is_directory(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop) and fs.getFileStatus(hadoop).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; none if there is no such folder."""
    fs, hadoop = _fs(spark, path)
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _fs(spark, path)
    return fs.exists(hadoop)


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _fs(spark, path)
    fs.delete(hadoop, True)


def new_writer() -> str:
    """An id for whoever writes; later ones sort after earlier ones."""
    return f"{time.time_ns() // 1_000_000:014d}-{uuid.uuid4().hex[:8]}"


def writer_of(spark: SparkSession, checkpoint: str) -> str:
    """The writer a checkpoint stands for: the same after a restart, another one for a fresh checkpoint."""
    known = [name.removeprefix("writer-") for name in names(spark, checkpoint) if name.startswith("writer-")]
    if known:
        return known[0]
    writer = new_writer()
    fs, hadoop = _fs(spark, f"{checkpoint}/writer-{writer}")
    fs.mkdirs(hadoop)
    return writer
