"""Answers that arrive later: personal data put back from the stored token maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.privacy import TOKEN_PREFIX
from textloom.operators.lookup import fits_broadcast
from textloom.operators.privacy import attach_token_map, restore


def restore_stored(replies: DataFrame, maps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Values put back into ``replies``, with ``state``: ``restored``, or ``quarantine`` for tokens that no map explains.

    ``maps`` is the table of ``privacy.explode_token_map``, entries of repeated runs included. A reply without any token needs
    no map. A quarantined reply keeps its text, has an ``error`` and may be handed in again when its map is there. A NULL
    text or key is quarantined too. Only the entries of the keys that arrive are grouped: where the keys are few enough to be
    broadcast, which is checked, the table of maps does not move.
    """
    needs = F.coalesce(F.col(text).rlike(TOKEN_PREFIX + "[0-9]"), F.lit(False))
    keys = replies.where(needs & F.col(key).isNotNull()).select(key).distinct()
    met = maps.select(key, "token", "value", "type").join(F.broadcast(keys) if fits_broadcast(keys) else keys, key, "left_semi")
    plain = replies.drop("error", "state")
    joined = attach_token_map(plain, met.distinct(), key)
    lost = F.col(text).isNull() | F.col(key).isNull() | (needs & F.col("token_map").isNull())
    why = (
        F.when(F.col(text).isNull(), "no text to restore")
        .when(F.col(key).isNull(), "no key")
        .when(F.col("_lost"), "token map is missing")
    )
    kept = restore(joined.withColumn("_lost", lost)).withColumn("error", why)
    return kept.withColumn("state", F.when(F.col("_lost"), "quarantine").otherwise("restored")).drop("_lost", "token_map")


def restore_arriving(
    spark: SparkSession,
    source: str,
    schema: str,
    maps: str,
    target: str,
    checkpoint: str,
    key: str = "doc_id",
    text: str = "text",
    max_files: int = 1_000,
) -> StreamingQuery:
    """Restore all new parquet files of replies in ``source`` into ``target``, then stop.

    The token maps are read anew for each batch from the folder ``maps``, so maps that arrive meanwhile count. Each batch
    replaces its own folder ``batch=<n>``, with one folder per ``state`` below it: a batch that runs twice, after a lost
    driver or executor, is stored once, and each file counts once by the checkpoint. The schema must hold key and text.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        done = restore_stored(batch, batch.sparkSession.read.parquet(maps), key, text)
        done.write.mode("overwrite").partitionBy("state").parquet(f"{target}/batch={number}")

    return (
        arriving.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
