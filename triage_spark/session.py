"""Session helpers.

The library itself never creates a session: every operator is a pure
``DataFrame -> DataFrame`` function.  These helpers are for tests, the bench
and command-line runs.  On a cluster the session (and ``spark.checkpoint.dir``,
a shared folder) comes from the deployment; we only fill the gap locally.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CHECKPOINT_ROOT: str | None = None


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "triage_spark") -> SparkSession:
    """A local session tuned like the cluster one (AQE on, UTC, no UI)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TRIAGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        # Python call-site capture for error messages costs several driver
        # round trips per column function; it is a debugging aid, off here.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3, ...)
    and is left alone.  Only when it is missing in a local session (tests) do we
    point it at a fresh folder under the system temp directory; executors of a
    cluster would not share such a folder, so there it must be set.
    """
    global _LOCAL_CHECKPOINT_ROOT
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL_CHECKPOINT_ROOT is None:
        _LOCAL_CHECKPOINT_ROOT = tempfile.mkdtemp(prefix="triage-ckpt-")
    spark.conf.set("spark.checkpoint.dir", _LOCAL_CHECKPOINT_ROOT)
    spark.sparkContext.setCheckpointDir(_LOCAL_CHECKPOINT_ROOT)
    return _LOCAL_CHECKPOINT_ROOT


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one job run."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"
