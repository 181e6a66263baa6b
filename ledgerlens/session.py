"""Spark session settings the metric layer relies on.

Only three things are load-bearing for correctness: the session time zone
(calendar dates are UTC dates), ANSI mode (divisions go through
``try_divide``), and a checkpoint directory for the snapshot layer.
Everything else is throughput tuning that a cluster deployment overrides.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session needs, whatever the cluster.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE turns a shuffle join into a broadcast join only when the measured
    # size of the finished shuffle stage is under this bound.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
}


def cluster_conf(total_cores: int) -> dict[str, str]:
    """Suggested settings for a large cluster run (pass to ``SparkSession.builder.config``).

    Shuffle partitions start high (a few per core) and AQE coalesces them to
    ~256 MB each; scans split files at 256 MB; skewed shuffle partitions over
    5x the median and 512 MB are split; fact-to-fact joins get runtime bloom
    filters from their small, filtered side.
    """
    return {
        **REQUIRED_CONF,
        "spark.sql.shuffle.partitions": str(max(200, 3 * total_cores)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": "32m",
        "spark.sql.parquet.filterPushdown": "true",
    }


def configure(spark: SparkSession) -> SparkSession:
    """Apply the required settings to an existing session (idempotent)."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir, creating a local one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is. A local scratch folder is made only for tests and local runs.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session has no SparkContext
        sc = None
    current = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if current:
        if sc is not None and not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if sc is not None and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # Local runs and tests only: one stable scratch folder per user, so bound
    # test tables (keyed by data set and code version) are reused across runs.
    local = os.path.join(tempfile.gettempdir(), f"ledgerlens-ckpt-{os.getuid()}")
    os.makedirs(local, exist_ok=True)
    if sc is not None:
        sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlens") -> SparkSession:
    """Session for tests and the local benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
