"""Pages to text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textloom.functions.html import body_slice, html_to_text


def slice_bodies(df: DataFrame, html: str = "html", out: str = "text", strict: bool = True) -> DataFrame:
    """Add the body slice of landed pages; an empty slice counts as a failed fetch.

    After a failed fetch an existing ``out`` column keeps its value, a new one is NULL.
    """
    body = body_slice(F.col(html), strict)
    before = F.col(out) if out in df.columns else F.lit(None).cast("string")
    return df.withColumn(out, F.when(body != "", body).otherwise(before))


def clean_html(df: DataFrame, html: str = "text", out: str = "text") -> DataFrame:
    return df.withColumn(out, html_to_text(F.col(html)))


def clean_threads(df: DataFrame, payload: str = "payload", out: str = "text", twice: bool = True) -> DataFrame:
    """Text of documents landed as API replies with a field ``html``.

    The chain cleans the text a second time, which decodes entities twice; ``twice=False``
    cleans once.
    """
    text = html_to_text(F.get_json_object(F.col(payload), "$.html"))
    return df.withColumn(out, html_to_text(text) if twice else text)
