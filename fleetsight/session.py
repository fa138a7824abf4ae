"""Session settings the library needs, all changeable by the caller."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pin_utc(spark: SparkSession) -> SparkSession:
    """Telemetry times are UTC; zone-free columns are read as such."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_keyed_state(spark: SparkSession) -> SparkSession:
    """Arbitrary keyed state in streams needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a session in one process may do without one.

    On a cluster a folder of the driver's machine would be of no use to executors, so it is an error
    there to name none.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not shared and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    chosen = shared or tempfile.mkdtemp(prefix="fleetsight-checkpoint-")
    spark.sparkContext.setCheckpointDir(chosen)
    return chosen
