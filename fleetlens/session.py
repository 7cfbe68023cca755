"""Session set-up shared by the library, the tests and the benchmark.

The library never hard-codes cluster sizing. On a real cluster the
session already exists (spark-submit / notebook) and only the few
settings that change results are read here; the local defaults below
apply only when this module builds the session itself.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Execution settings for sessions this module creates (tests, bench).
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "fleetlens") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        spark = active
    else:
        builder = SparkSession.builder.appName(app)
        if master:
            builder = builder.master(master)
        for k, v in LOCAL_CONF.items():
            builder = builder.config(k, v)
        if shuffle_partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        spark = builder.getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    On a cluster ``spark.checkpoint.dir`` names a shared, durable folder
    and is used as is. Only a local-mode session (tests) with the setting
    unset gets a private temporary folder; on a cluster an unset setting
    is an error, since a machine-local folder would not survive the loss
    of that machine.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    if not path:
        try:
            path = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # not set in the SQL conf either
            path = None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or an object store)")
        path = tempfile.mkdtemp(prefix="fleetlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "fleetlens", kind, uuid.uuid4().hex)


def materialize(df: DataFrame, kind: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: the
    rows are computed once, however often they are used, and survive the loss
    of any executor."""
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scale_conf(input_bytes: int, executors: int = 1000, cores_per_executor: int = 8,
               target_partition_bytes: int = 256 * 1024 ** 2) -> dict[str, str]:
    """Settings to submit with a job over ``input_bytes`` of Parquet.

    - Shuffle partitions: enough that a partition is about
      ``target_partition_bytes`` even before AQE coalescing, and at least
      2x the cluster's task slots. AQE then merges small partitions and
      splits skewed ones (a key with a third of the rows).
    - Scan splits of ``target_partition_bytes``, so one task's input fits
      in its share of executor memory.
    - Broadcasts: the planner may broadcast on its own estimate only below
      10 MiB; between 10 and 64 MiB a side is broadcast only after AQE
      has materialized it and knows its exact size. Larger sides are
      shuffled (sort-merge, with AQE skew splitting).
    - RocksDB state for streams (state off the JVM heap, incremental
      changelog checkpoints).
    - Executor loss: decommissioning migrates shuffle and cached blocks
      off a leaving executor, and failed tasks are retried.
    """
    slots = executors * cores_per_executor
    partitions = max(2 * slots, -(-input_bytes // target_partition_bytes))
    mib = target_partition_bytes // (1024 ** 2)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{mib}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{2 * mib}m",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": f"{mib}m",
        "spark.sql.autoBroadcastJoinThreshold": "10m",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # merge session windows inside each partition before the shuffle (hot hosts)
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
        "spark.decommission.enabled": "true",
        "spark.storage.decommission.enabled": "true",
        "spark.storage.decommission.shuffleBlocks.enabled": "true",
        "spark.storage.decommission.rddBlocks.enabled": "true",
        "spark.task.maxFailures": "8",
        "spark.ui.enabled": "false",
    }
