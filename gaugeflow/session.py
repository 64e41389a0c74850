"""Session settings the library is designed around."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(master: str = "local[*]", app: str = "gaugeflow", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time.

    On a cluster ``shuffle_partitions`` stays unset: adaptive execution then
    coalesces from ``spark.sql.adaptive.coalescePartitions.initialPartitionNum``.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master.startswith("local"):
        builder = builder.config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, str] = {}


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    The shared folder is the one named by ``spark.checkpoint.dir``. Only where
    it is unset (local runs and tests) a local temporary folder is made, once
    per application; a cluster without it is refused, as its executors would
    each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="gaugeflow-")
        base = _LOCAL_FOLDERS[app]
    return f"{base.rstrip('/')}/{purpose}-{os.urandom(6).hex()}"
