"""A catalog of glossary terms that re-runs and concurrent writers leave with one copy of each term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PLACED = "glossary_id string, category string, name string, shortDescription string, status string"
SCHEMA = f"{PLACED}, term_id string, batch string"


def term_id(category: Column, name: Column, description: Column) -> Column:
    """Id of a term, the same on every run and for every writer; lengths keep the parts apart."""
    parts = [F.coalesce(p, F.lit("")) for p in (category, name, description)]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.concat(F.lit("term-"), F.md5(F.concat(*sized).cast("binary")))


def append_once(placed: DataFrame, folder: str, batch: str) -> None:
    """Write the terms of a batch, each once, to a folder of their own; rows without a name are skipped.

    The same batch written again, after a failure or by mistake, takes the place of its first run as a whole. Other batches
    are not touched, so writers of different batches never meet. ``batch`` names what is written, such as a date, not
    the run that writes it.
    """
    if not batch or "/" in batch:
        raise ValueError("a batch needs a name without slashes")
    named = placed.where(F.col("name").isNotNull())
    rows = named.withColumn("term_id", term_id(F.col("category"), F.col("name"), F.col("shortDescription")))
    fields = ["glossary_id", "category", "name", "shortDescription", "status"]
    one = rows.groupBy("term_id").agg(F.min(F.struct(*fields)).alias("r")).select("r.*", "term_id", F.lit(batch).alias("batch"))
    writer = one.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch").parquet(folder)


def read_catalog(spark: SparkSession, folder: str, existing: DataFrame | None = None) -> DataFrame:
    """Every term once, with the first batch that wrote it.

    A category has one glossary: that of ``existing(id, name)``, else the smallest id that any writer gave it, so writers
    that did not know of each other create it once.
    """
    rows = spark.read.schema(SCHEMA).parquet(folder)
    fields = F.struct("batch", "glossary_id", "category", "name", "shortDescription", "status")
    terms = rows.groupBy("term_id").agg(F.min(fields).alias("r")).select("r.*", "term_id")
    # Each category is a group of its distinct ids only; its terms are reduced in the tasks that read them.
    ids = rows.groupBy("category").agg(F.min("glossary_id").alias("_id"))
    if existing is not None:
        first = existing.groupBy(F.col("name").alias("category")).agg(F.min("id").alias("_known"))
        ids = ids.join(first, "category", "left").select("category", F.coalesce("_known", "_id").alias("_id"))
    mine = ids.withColumnRenamed("category", "_category")
    joined = terms.join(mine, F.col("category").eqNullSafe(F.col("_category")), "left")
    return joined.select(
        F.col("_id").alias("glossary_id"), "category", "name", "shortDescription", "status", "term_id", "batch"
    )


def compact(spark: SparkSession, folder: str, into: str, existing: DataFrame | None = None) -> None:
    """Write the catalog without its duplicates to a new folder; an existing one is refused."""
    read_catalog(spark, folder, existing).write.partitionBy("batch").parquet(into)
