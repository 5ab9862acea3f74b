"""Run a chain on files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def run_on_files(
    spark: SparkSession,
    source: str,
    schema: str,
    stage: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    max_files: int = 1_000,
) -> StreamingQuery:
    """Append ``stage`` of all new parquet files in ``source`` to ``target``, then stop.

    The stage must be row-local; it sees the whole row of a document, so the token map, chunks
    and insights of a row need no state. Each file counts once, also after a restart, by the
    checkpoint. Statistics of a corpus have to come from a stored table.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    return (
        stage(arriving)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_batches(
    spark: SparkSession,
    source: str,
    schema: str,
    stage: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    max_files: int = 1_000,
) -> StreamingQuery:
    """As ``run_on_files`` for stages that group or join within the arriving batch.

    Every batch replaces its own folder, so one that runs twice is stored once.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        arriving.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
