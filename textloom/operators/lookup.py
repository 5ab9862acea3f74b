"""Joins with lookup tables, broadcast only after their size was checked."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from textloom.session import local_folder

MAX_INLINE_ROWS = 2_000
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
#: Keys whose entries a join with a large table broadcasts.
HEAVY_KEYS = 1_000
SPREAD = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, ``spark.checkpoint.dir``. Only a local master may go without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or local_folder())
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def _size(df: DataFrame, max_rows: int) -> tuple[int, int]:
    """Rows and bytes as JSON, counted only up to one row past the limit."""
    size = F.octet_length(F.to_json(F.struct("*"))).alias("size")
    row = (
        df.select(size)
        .limit(max_rows + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
        .first()
    )
    return row["n"], row["bytes"]


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    rows, size = _size(df, max_rows)
    return rows <= max_rows and size <= max_bytes


def rows_if_small(df: DataFrame, max_rows: int = MAX_INLINE_ROWS, max_bytes: int = 1 << 20) -> list[Row] | None:
    """The rows of a small table, or None when it is over the limits."""
    return df.collect() if fits_broadcast(df, max_rows, max_bytes) else None


def lookup_join(
    left: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
    heavy_keys: int = HEAVY_KEYS,
) -> DataFrame:
    """Join with a lookup table that has at most one row per key.

    A table within the limits is broadcast. A larger one is joined by shuffle; of the keys that hold many left rows
    the HEAVY_KEYS heaviest, as counted in ``left``, are broadcast with their entries, and the rows that they serve stay out of
    the shuffle's groups. No other key holds more than 1 in HEAVY_KEYS of the rows. Rows with a null in the key meet nothing.
    """
    if fits_broadcast(table, max_rows):
        return left.join(F.broadcast(table), on, how)
    if how not in ("left", "inner"):
        raise ValueError(f"no {how} join with a large table")
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    counts = left.where(known).groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    frequent = materialize(counts.orderBy(F.desc("_n"), *on).limit(heavy_keys))
    others = [c for c in table.columns if c not in on]
    entry = F.struct(F.lit(True).alias("_met"), *others)
    heavy = materialize(table.join(F.broadcast(frequent.drop("_n")), on, "left_semi").select(*on, entry.alias("_heavy")))
    met = left.join(F.broadcast(heavy), on, "left")
    waits = known & F.col("_heavy").isNull()
    hashed = [c for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    # Rows that wait for nothing go anywhere; copies of one row differ by their partition, so a task that runs again agrees.
    spread = F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.lit(SPREAD)).cast("int") + 1
    met = met.withColumn("_salt", F.when(waits, F.lit(0)).otherwise(spread))
    rest = table.select(*on, entry.alias("_light"), F.lit(0).alias("_salt"))
    joined = met.join(rest, [*on, "_salt"], "left").withColumn("_entry", F.coalesce("_heavy", "_light"))
    if how == "inner":
        joined = joined.where(F.col("_entry").isNotNull())
    kept = [F.col(c) for c in left.columns if c not in on]
    return joined.select(*on, *kept, *[F.col("_entry")[c].alias(c) for c in others])
