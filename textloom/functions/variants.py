"""JSON as Python reads it: of a key that an object repeats the last value counts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SETTING = "spark.sql.variant.allowDuplicateKeys"


@contextmanager
def last_key_wins(spark: SparkSession) -> Iterator[None]:
    """JSON expressions of DataFrames that are built inside keep the last of repeated keys."""
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SETTING)
        else:
            spark.conf.set(_SETTING, before)
