"""Session set-up and the shared folder that written intermediates go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "hearsay", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library assumes.

    Times are UTC, JSON keys keep their case (feeds carry keys that differ only by
    case) and adaptive execution re-plans joins and splits skewed partitions. Shuffle
    width is left to the cluster; pass it through ``conf`` for local runs.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.caseSensitive", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster.

    Only a local master may fall back to a machine-local folder; on a cluster the
    setting must be there, since executors on other hosts could not read such a folder.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="hearsay-")
        spark.conf.set(CHECKPOINT_CONF, root)
        return root
    raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable with the shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(spark))


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{checkpoint_root(spark)}/hearsay/{label}-{uuid.uuid4().hex}"
