"""Text files and landed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """``files(path, content)``; one row per file, whole. Spark lists no row for an empty file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def local_text(content: Column) -> Column:
    """UTF-8 text with ``\\n`` line ends; bytes that are no UTF-8 give ``''``."""
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(content), F.lit("")), "\r\n?", "\n")


def object_text(content: Column) -> Column:
    """UTF-8 text as it is; bytes that are no UTF-8 fail."""
    return F.validate_utf8(content)


def read_local_texts(spark: SparkSession, path: str) -> DataFrame:
    return read_binary(spark, path).select("path", local_text(F.col("content")).alias("text"))


def read_object_texts(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Texts of an object store; not strict, bad bytes give a NULL text and an ``error``."""
    files = read_binary(spark, path)
    if strict:
        return files.select("path", object_text(F.col("content")).alias("text"))
    text = F.try_validate_utf8("content")
    return files.select("path", text.alias("text"), F.when(text.isNull(), "not UTF-8").alias("error"))


def attach_texts(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests (path, ...) with the text of their file; a file that is not there gives ``''``."""
    texts = files.select("path", F.col("text").alias("_text"))
    return requests.drop("text").join(texts, "path", "left").withColumn(
        "text", F.coalesce("_text", F.lit(""))
    ).drop("_text")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """``payloads(path, payload)``: one landed API reply per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload")
    )


def transcript_text(payload: Column) -> Column:
    """Text of the first transcript in the output of a speech job."""
    return F.get_json_object(payload, "$.results.transcripts[0].transcript")
