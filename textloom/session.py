"""Session for tests and local runs; a cluster brings its own."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_folder() -> str:
    """A folder for sessions whose driver and executors are one process."""
    return tempfile.mkdtemp(prefix="textloom-")


#: Bytes that a Python worker is sent at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Send Python workers BATCH_BYTES and one row more at most at a time, for this session; a smaller setting stays.

    A worker holds a batch several times (as Arrow, as Python objects, its results), a task has a worker per kind of
    function, and an executor a task per core. The limit is read when a query runs, so it cannot be taken back before.
    """
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("textloom")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .getOrCreate()
    )
