"""Session construction and cluster-shared folders."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "tidewatch",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the session the platform gives you."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    # pandas in Python workers warns on every empty state batch; keep logs readable.
    os.environ.setdefault("PYTHONWARNINGS", "ignore::FutureWarning")
    b = (SparkSession.builder
         .master(master or f"local[{cpus}]")
         .appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         # checkpoint files of lineage cuts are deleted once their RDD is unreachable
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (it must be a
    shared file system). Only when nothing is configured and the master is local (tests)
    do we make a scratch folder of our own: on a cluster it would scatter checkpoints over
    machines, so that is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tidewatch-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cluster_settings(input_bytes: int, total_cores: int, executor_memory_gb: float = 16.0,
                     cores_per_executor: int = 4) -> dict[str, str]:
    """Settings for a cluster run sized from the input volume, to pass to the builder or
    ``spark.conf.set`` (this module never changes a running cluster on its own).

    * input splits of at most 256 MB, fewer when a task's memory share is small;
    * shuffle partitions so each holds ~200 MB before AQE coalescing, at least 3 waves
      of tasks, so sorts and window buffers fit and spill rarely;
    * AQE coalescing to 256 MB targets and skew-join splitting (5x median, > 512 MB);
    * RocksDB state store for streaming state that outgrows executor heaps.
    """
    mb = 1024 * 1024
    per_task_mem = executor_memory_gb * 1024 * mb / max(1, cores_per_executor)
    split = int(min(256 * mb, max(32 * mb, per_task_mem / 8)))
    shuffle = max(3 * total_cores, int(input_bytes / (200 * mb)))
    return {
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mb),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * mb),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * mb),
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
