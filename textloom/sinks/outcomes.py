"""Texts written with an outcome per row: what cannot be written lands in a table beside the rest, in the same job."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

#: Charsets of the files that texts are meant for, with the signs that each can hold.
CHARSETS = {"utf-8": None, "iso-8859-1": "[^\\x00-\\xff]", "us-ascii": "[^\\x00-\\x7f]"}
#: Bytes that a name of a file may have on common file systems.
LONGEST_NAME = 255


def problem(path: Column, text: Column, charset: str = "utf-8") -> Column:
    """Why a row cannot be written; NULL if it can."""
    foreign = CHARSETS[charset.lower()]
    name = F.substring_index(path, "/", -1)
    found = (
        F.when(text.isNull(), "no text to write")
        .when(F.coalesce(path, F.lit("")) == "", "no path")
        .when(path.endswith("/") | name.isin(".", ".."), "path of a folder")
        .when(path.rlike(r"(^|/)\.\.(/|$)"), "path leaves its folder")
        .when(path.contains("\u0000"), "path with a null byte")
        .when(F.octet_length(name) > LONGEST_NAME, "name too long")
    )
    if foreign is None:
        return found
    sign = F.regexp_extract(text, foreign, 0)
    return F.when(found.isNotNull(), found).when(sign != "", F.concat(F.lit(f"not in {charset.lower()}: "), sign))


def write_outcomes(df: DataFrame, folder: str, path: str = "path", text: str = "text", charset: str = "utf-8") -> dict[str, int]:
    """Append all rows with ``status`` and ``error``; returns ``rows``, ``written``, ``failed`` as the job counted them.

    One job writes both kinds to folders of their own (``status=true`` and ``status=false``) and counts them, so nothing before
    it, such as a model call, runs a second time. An ``error`` from an earlier stage counts as a failure and stays.
    """
    before = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    judged = df.withColumn("error", F.coalesce(before, problem(F.col(path), F.col(text), charset)))
    judged = judged.withColumn("status", F.col("error").isNull())
    seen = Observation(f"outcomes-{uuid.uuid4().hex}")
    counted = judged.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.col("status"), 1)).alias("written"),
        F.count(F.when(~F.col("status"), 1)).alias("failed"),
    )
    counted.write.mode("append").partitionBy("status").parquet(folder)
    return seen.get


def read_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """All rows that were written, with ``status`` as a boolean."""
    return spark.read.parquet(folder).withColumn("status", F.col("status").cast("boolean"))


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """How often each error occurs among the rows that were not written."""
    rows = spark.read.parquet(folder).where(F.col("status") == "false")
    return rows.groupBy("error").agg(F.count(F.lit(1)).alias("n"))
