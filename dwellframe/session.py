"""Spark session helpers.

The library never owns the cluster configuration: on a cluster the caller's
session is used as is.  ``local_session`` exists for tests and the bench.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "dwellframe", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings used by tests and ``bench.py``.

    AQE is on (coalesces small shuffles, splits skewed join partitions), the
    UI is off, timestamps are UTC so results compare with DuckDB.
    """
    parts = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    builder = SparkSession.builder
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (HDFS/object store) folder and is
    used unchanged; a cluster session without it is refused.  Only a local
    session (tests) gets a fresh scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="dwellframe-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    spark = spark or df.sparkSession
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def cluster_settings(total_input_bytes: int, executor_cores: int = 4, executors: int = 1000,
                     target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Suggested settings for a large cluster (the caller applies them; nothing is set here).

    Shuffle partitions are sized so a partition holds ~``target_partition_bytes``
    of input and there are at least two waves of tasks; AQE coalesces small
    partitions and splits skewed ones at runtime.
    """
    slots = executor_cores * executors
    parts = max(2 * slots, total_input_bytes // target_partition_bytes)
    return {
        "spark.sql.shuffle.partitions": str(int(parts)),
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(32 << 20),
    }
