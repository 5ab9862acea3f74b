"""Model calls that are paid once: a table of replies, keyed by the digest of the request."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.operators.inference import call_model
from textloom.operators.lookup import lookup_join

SCHEMA = "digest string, reply string, error string, batch string"
#: Requests of a task: what a lost executor asks again at most, for each of its cores.
TASK = 500
#: Requests of a wave: what a run that ends early asks again at most.
WAVE = 100_000


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """``ledger(digest, reply, error, batch)``, all rows ever written; empty where the folder does not exist yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def answered(ledger: DataFrame) -> DataFrame:
    """``digest``, ``reply``, ``error``: one row per digest, a reply before an error, the first batch among equals."""
    order = F.struct(F.col("error").isNotNull().alias("failed"), "batch", "reply", "error")
    best = ledger.groupBy("digest").agg(F.min(order).alias("r"))
    return best.select("digest", F.col("r.reply").alias("reply"), F.col("r.error").alias("error"))


def _digest(body: str):
    return F.sha2(F.col(body), 256)


def ask_once(
    df: DataFrame,
    make_client: Callable[[], Callable[[str], str]],
    folder: str,
    body: str = "body",
    wave: int = WAVE,
    task: int = TASK,
) -> int:
    """Ask the requests of ``df`` that have no reply in ``folder``; returns how many were asked.

    Equal requests are asked once. Stored replies are left out by an anti join on the digest, failed ones are asked again.
    The requests that remain go in waves, by their digests; each wave appends its replies and counts as soon as it is
    written. A task asks ``task`` requests, so a lost executor repeats those of its running tasks, and a run that is started
    again repeats one wave at most. Null requests are not asked.
    """
    spark = df.sparkSession
    wanted = df.where(F.col(body).isNotNull()).select(_digest(body).alias("digest"), F.col(body).alias("_request"))
    # Equal requests become one in each task before they move.
    distinct = wanted.groupBy("digest").agg(F.first("_request").alias("_request"))
    asked, number, waves, parts = 0, 0, 1, 1
    while number < waves:
        done = answered(read_ledger(spark, folder)).where(F.col("error").isNull())
        missing = distinct.join(done, "digest", "left_anti")
        if number == 0:
            total = missing.count()
            waves, parts = max(1, math.ceil(total / wave)), max(1, math.ceil(min(total, wave) / task))
        mine = missing.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == number)
        batch = f"{number:06d}-{uuid.uuid4().hex}"
        replies = call_model(mine.repartition(parts, "digest"), make_client, "_request")
        rows = replies.select("digest", "reply", "error", F.lit(batch).alias("batch"))
        rows.write.mode("append").parquet(folder)
        asked += read_ledger(spark, folder).where(F.col("batch") == batch).count()
        number += 1
    return asked


def attach_replies(df: DataFrame, folder: str, body: str = "body") -> DataFrame:
    """Add ``reply`` and ``error`` from the ledger to every row, also to many rows of one request.

    A request that was never asked has neither; an ``error`` that ``df`` has already stays where the ledger has none.
    """
    known = answered(read_ledger(df.sparkSession, folder))
    known = known.select(F.col("digest").alias("_digest"), F.col("reply").alias("_reply"), F.col("error").alias("_error"))
    joined = lookup_join(df.withColumn("_digest", _digest(body)), known, ["_digest"])
    before = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    kept = [c for c in df.columns if c not in ("reply", "error")]
    return joined.select(*kept, F.col("_reply").alias("reply"), F.coalesce("_error", before).alias("error"))


def call_model_once(
    df: DataFrame, make_client: Callable[[], Callable[[str], str]], folder: str, body: str = "body", **limits: int
) -> DataFrame:
    """``call_model`` through the ledger in ``folder``: asks what is missing, then joins all replies."""
    ask_once(df, make_client, folder, body, **limits)
    return attach_replies(df, folder, body)
