"""Spark session settings the library relies on.

Everything here is plain Spark configuration. On a cluster the session is
created by the platform; ``configure`` only adds the SQL settings the
operators need and never overrides a checkpoint directory that is already set.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# SQL settings every operator assumes.
REQUIRED_CONF = {
    # Hours, days and heatmap weeks are computed in an explicit zone (UTC default).
    "spark.sql.session.timeZone": "UTC",
    # base64() must not insert line breaks every 76 characters.
    "spark.sql.chunkBase64String.enabled": "false",
    # A JSON key given twice means its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Runtime re-planning: coalesce small shuffles, split skewed join partitions,
    # and demote/promote join strategies from real shuffle sizes.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the library needs to an existing session."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int | None = None,
                  app_name: str = "cmdlens") -> SparkSession:
    """A local session for tests and the benchmark (UI off, no servers)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", os.environ.get("CMDLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the platform (a shared filesystem); it is read,
    never replaced. Only when it is unset and the master is local (tests) a
    scratch folder is created and registered; elsewhere its absence is an error.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint directory
        sc = None
    active = sc.getCheckpointDir() if sc is not None else None
    if active:
        return active
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if sc is None or not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="cmdlens-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint directory (streams, tables)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


# Scratch tables made by this process, for release_scratch.
_SCRATCH: list[str] = []


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables this process made in the shared folder; returns their number.

    Call it when no DataFrame that reads them is needed any more: results are
    lazy, so a query cannot delete what its own result still reads.
    """
    n = 0
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
