"""SparkSession construction and cluster-safe scratch locations."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

# Target bytes per shuffle partition / file split on a cluster: large enough
# to keep task overhead small, small enough to sort and join in executor
# memory without heavy spilling.
TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def cluster_conf(largest_shuffle_bytes: int, target_bytes: int = TARGET_PARTITION_BYTES) -> dict[str, str]:
    """Session settings for a large cluster, sized from the largest shuffle.

    `largest_shuffle_bytes` is the size of the biggest exchange (here
    attendance ⋈ activities after column pruning). Shuffle partitions are
    set for that stage at `target_bytes` each; AQE coalesces the smaller
    stages by size (not by core count) and splits skewed partitions.
    """
    parts = max(200, math.ceil(largest_shuffle_bytes / target_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_bytes),
        "spark.sql.session.timeZone": "UTC",
    }


def cluster_session(largest_shuffle_bytes: int, app_name: str = "ridgeline") -> SparkSession:
    """Session for spark-submit on a cluster: the master and the shared
    `spark.checkpoint.dir` come from the submission; only SQL settings are set."""
    builder = SparkSession.builder.appName(app_name)
    for k, v in cluster_conf(largest_shuffle_bytes).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        raise RuntimeError("submit with spark.checkpoint.dir set to a folder on shared storage")
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "ridgeline", extra_conf: dict[str, str] | None = None) -> SparkSession:
    """Session for tests, benchmarks and local runs.

    On a cluster, submit with the cluster's own master and keep these settings:
    AQE re-plans joins from runtime sizes (broadcast conversion, partition
    coalescing, skew splitting), so shuffle partitions can be sized for the
    largest stage and AQE shrinks the small ones.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RIDGELINE_DRIVER_MEMORY", "8g"))
    )
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that driver and executors share; it is removed when the application ends.

    It comes from the session: ``spark.checkpoint.dir``, and where that is
    unset the warehouse folder, but only with a local master (tests, local
    runs): elsewhere that may be a folder of one machine, so it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{folder.toString()}/data"


def scratch_table(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it from there.

    This computes `df` and cuts its lineage: later stages read columnar files
    that every executor sees, so a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
