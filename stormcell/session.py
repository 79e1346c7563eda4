"""Session helpers: build a session for tests/bench, find the shared checkpoint folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "stormcell", cpus: int | str = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "16g") -> SparkSession:
    """Local session used by tests and bench.  On a cluster use the cluster's session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # local runs on small inputs: keep some parallelism after AQE coalescing
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call sites: plans of many columns build faster
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # checkpoints go with the frames that hold them
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins; a folder of our own is set only where
    the session has none: with a local master a folder under /tmp, otherwise the call fails
    (a machine-local folder would be lost with its machine).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local") and not (fallback or os.environ.get("STORMCELL_CHECKPOINT_DIR")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not conf_dir:
        conf_dir = fallback or os.environ.get("STORMCELL_CHECKPOINT_DIR") or "/tmp/stormcell-checkpoints"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).  The columns are named anew, so that the
    result can be joined with frames that were made from the same ones."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True).toDF(*df.columns)
