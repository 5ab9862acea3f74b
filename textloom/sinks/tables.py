"""Tables of texts, upload paths and form payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def with_status(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``status`` and ``error``: a row without text cannot be written."""
    missing = F.col(text).isNull()
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {"status": ~missing, "error": F.when(missing, F.coalesce(error, F.lit("no text to write"))).otherwise(error)}
    )


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    """Append all rows with their outcome, those with and without a text in folders of their own.

    One job writes both, so nothing before it, such as a model call, runs a second time.
    """
    with_status(df, text).write.mode("append").partitionBy("status").parquet(path)


def stored_rows(spark: SparkSession, path: str, status: bool = True) -> DataFrame:
    """The rows that were written, or with ``status=False`` the rejected ones."""
    rows = spark.read.parquet(path).where(F.col("status") == str(status).lower())
    return rows.withColumn("status", F.col("status").cast("boolean"))


def write_by_type(df: DataFrame, path: str, kind: str = "input_type") -> None:
    """Append, one folder per input type, so later stages read only their own rows."""
    df.write.mode("append").partitionBy(kind).parquet(path)


def upload_path(path: Column, bucket: str, folder: str) -> Column:
    """Path of a file after it was put into a bucket."""
    return F.concat(F.lit(f"s3://{bucket}/{folder}"), F.substring_index(path, "/", -1))


def form_encode(text: Column) -> Column:
    """Percent-encoding of HTML forms: a blank is ``+``; letters, digits and ``_.-~`` stay."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def document_payload(content: Column, folder_id: Column) -> Column:
    """Form body that creates a document from HTML in a folder; NULL reads ``None``."""
    missing = F.lit("None")
    return F.concat(
        F.lit("content="),
        form_encode(F.coalesce(content, missing)),
        F.lit("&format=html&member_ids="),
        form_encode(F.coalesce(folder_id, missing)),
        F.lit("&type=document"),
    )


def append_terms(placed: DataFrame, path: str) -> None:
    """Append glossary terms to the catalog; rows without a name are skipped."""
    placed.where("name is not null").write.mode("append").parquet(path)
