"""Helpers of the operators: shared checkpoints, joins with hot keys, tasks over Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Keys that a join broadcasts; a key left over holds at most 1 in HEAVY_KEYS of all weight.
HEAVY_KEYS = 1_000
SPREAD = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a local one only on a local master without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: the rows are computed once and kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_of(column: Column | str) -> Column:
    """A text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def hot_join(left: DataFrame, right: DataFrame, on: list[str], weight: str, columns: list[str]) -> DataFrame:
    """Left join with ``right``, which has one row per key and its ``weight``: the rows it meets on the left.

    The heaviest keys, HEAVY_KEYS at most, are broadcast. All others are joined by shuffle, where none
    holds more than 1 in HEAVY_KEYS of the weight. Rows that are served already, and rows with a null
    in the key, are spread over all tasks. ``right`` is read twice, so it should be stored.
    """
    heavy = right.orderBy(F.desc(weight), *on).limit(HEAVY_KEYS)
    heavy = heavy.select(*on, F.struct(*columns).alias("_heavy"))
    narrow = [c for c, kind in left.dtypes if kind in ("bigint", "int", "string", "binary")]
    waits = F.col("_heavy").isNull()
    for c in on:
        waits = waits & F.col(c).isNotNull()
    spread = F.pmod(F.xxhash64(*narrow, F.spark_partition_id()), F.lit(SPREAD)).cast("int") + 1
    met = left.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.when(waits, F.lit(0)).otherwise(spread))
    rest = right.select(*on, F.struct(*columns).alias("_light"), F.lit(0).alias("_salt"))
    found = F.coalesce("_heavy", "_light")
    return met.join(rest, [*on, "_salt"], "left").select(
        *[F.col(c) for c in left.columns], *[found[c].alias(c) for c in columns]
    )


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
