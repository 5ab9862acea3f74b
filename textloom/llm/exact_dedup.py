"""Exact deduplication: 128-bit content hash, bytes compared inside a group, one stable id stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import hot_join, stored, text_of


def content_hash(text: Column) -> Column:
    """128 bits of a text."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are grouped by (hash, text): equal hashes bring texts together, and the grouping compares
    their bytes. The texts move once, already reduced to one per task and text. Only groups of two rows
    or more are joined back, by hash and SHA-256; hot groups are broadcast. Should two texts ever agree in
    both, the job ends with an error instead of joining them.

    Null texts count as empty. Rows that agree in id and text are alike: all are kept or none. A null id
    stays only where its group has no other; other columns are ignored.
    """
    best = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    keyed = rows.select(
        "_id", "_text", hashed(F.col("_text")).alias("_hash"), F.sha2(F.col("_text").cast("binary"), 256).alias("_sha")
    )
    texts = keyed.drop("_sha").groupBy("_hash", "_text").agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    groups = (
        texts.select("_hash", F.sha2(F.col("_text").cast("binary"), 256).alias("_sha"), "_keep", "_n")
        .groupBy("_hash", "_sha")
        .agg(F.first("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"))
        .where("_n > 1")
        .withColumn("_n", F.when(F.col("_texts") == 1, F.col("_n")).otherwise(F.raise_error(F.lit("texts collide"))))
        .drop("_texts")
    )
    joined = hot_join(keyed.drop("_text"), stored(groups), ["_hash", "_sha"], "_n", ["_keep", "_n"])
    keep_id = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """The input with one row per text: that with the largest (or smallest) id, with all its columns.

    Rows that agree in id and text become one as well. One shuffle, no join.
    """
    best = {"max": F.max_by, "min": F.min_by}[keep]
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_name, text_name = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    order = F.struct((F.col(id_name).isNotNull() == F.lit(keep == "max")).alias("known"), F.col(id_name).alias("id"))
    texts = plain.select(F.struct(*names).alias("_row"), order.alias("_order"), text_of(text_name).alias("_text"))
    kept = (
        texts.withColumn("_hash", hashed(F.col("_text")))
        .groupBy("_hash", "_text")
        .agg(best("_row", "_order").alias("_row"))
    )
    return kept.select("_row.*").toDF(*docs.columns)
