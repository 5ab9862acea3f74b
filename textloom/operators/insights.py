"""Chunks, sentiment, entities and key phrases of documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from textloom.functions.chunks import MAX_BYTES, chunk_texts
from textloom.functions.insights import (
    ENTITY_TYPE,
    LEXICON,
    PHRASE_TYPE,
    entities,
    key_phrases,
    label,
    majority,
    sentiment,
)
from textloom.functions.text import bare_words
from textloom.operators.assemble import in_order
from textloom.operators.lookup import fits_broadcast, lookup_join, materialize, rows_if_small

Detector = Callable[[Column], Column]


def explode_chunks(
    df: DataFrame, text: str = "text", key: str = "doc_id", max_bytes: int = MAX_BYTES, spread: bool = False
) -> DataFrame:
    """``chunks(key, chunk_no, chunk)``, numbered from 0.

    With ``spread`` the chunks of one giant text go to many tasks, for costly detectors.
    """
    chunks = df.select(key, F.posexplode(chunk_texts(F.col(text), max_bytes)).alias("chunk_no", "chunk"))
    return chunks.repartition(key, "chunk_no") if spread else chunks


def insights(
    df: DataFrame,
    text: str = "text",
    out: str = "insights",
    lexicon: Mapping[str, int] = LEXICON,
    names: str | None = None,
    top_k: int | None = None,
    max_bytes: int = MAX_BYTES,
    detect_sentiment: Detector | None = None,
    detect_entities: Detector | None = None,
    detect_key_phrases: Detector | None = None,
) -> DataFrame:
    """Add a struct of sentiment, entities and key phrases, chunk by chunk within the row.

    There is no shuffle. Text without a word gives NULL. Detectors given here are Spark
    expressions; Python models work on the table of ``explode_chunks`` instead.
    """
    label_of = detect_sentiment or (lambda c: sentiment(c, lexicon, " "))
    entities_of = detect_entities or (lambda c: entities(c, F.col(names) if names else None))
    phrases_of = detect_key_phrases or (lambda c: key_phrases(c, top_k, space=" "))
    chunked = df.withColumn("_chunks", chunk_texts(F.col(text), max_bytes))
    found = F.struct(
        majority(F.transform("_chunks", label_of)).alias("sentiment"),
        F.flatten(F.transform("_chunks", lambda c: F.coalesce(entities_of(c), F.array()).cast(ENTITY_TYPE))).alias(
            "entities"
        ),
        F.flatten(F.transform("_chunks", lambda c: F.coalesce(phrases_of(c), F.array()).cast(PHRASE_TYPE))).alias(
            "key_phrases"
        ),
    )
    return chunked.withColumn(out, F.when(F.size("_chunks") > 0, found)).drop("_chunks")


def label_chunks(
    chunks: DataFrame,
    lexicon: DataFrame,
    key: str = "doc_id",
    max_inline: int = 2_000,
    max_broadcast: int | None = None,
) -> DataFrame:
    """Add ``label`` to a table of chunks by a ``lexicon(word, weight)`` table of any size.

    A small lexicon stays inside the plan. A larger one is joined with the word counts of each
    chunk, which are summed before they move. The weights of a word that is listed twice add up.
    """
    lexicon = lexicon.groupBy("word").agg(F.sum("weight").alias("weight"))
    rows = rows_if_small(lexicon, max_inline)
    if rows is not None:
        weights = {row["word"]: row["weight"] for row in rows}
        return chunks.withColumn("label", sentiment(F.col("chunk"), weights))
    counted = (
        chunks.select(key, "chunk_no", F.explode(bare_words(F.lower("chunk"))).alias("word"))
        .groupBy(key, "chunk_no", "word")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    limit = {} if max_broadcast is None else {"max_rows": max_broadcast}
    if not fits_broadcast(lexicon, **limit):
        # The join with a large table reads its left side twice: the words of the chunks are counted once.
        counted = materialize(counted)
    weighed = lookup_join(counted, lexicon, ["word"], "inner", **limit).withColumn("_w", F.col("weight") * F.col("_n"))
    sums = weighed.groupBy(key, "chunk_no").agg(
        F.sum(F.greatest("_w", F.lit(0))).alias("_plus"), F.sum(F.greatest(-F.col("_w"), F.lit(0))).alias("_minus")
    )
    zero = F.lit(0)
    return (
        chunks.join(sums, [key, "chunk_no"], "left")
        .withColumn("label", label(F.coalesce("_plus", zero), F.coalesce("_minus", zero)))
        .drop("_plus", "_minus")
    )


def vote(labels: DataFrame, key: str = "doc_id", out: str = "sentiment") -> DataFrame:
    """Most frequent label per key from rows (key, label); ties go to the smallest, NULL last."""
    votes = labels.groupBy(key, "label").agg(F.count(F.lit(1)).alias("_n"))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_n"), F.asc_nulls_last("label")))
    return votes.withColumn("_rank", best).where("_rank = 1").select(key, F.col("label").alias(out))


def merge_insights(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``insights(key, sentiment, entities, key_phrases)`` from rows (key, chunk_no, label, entities, key_phrases).

    One group per document: the vote over its labels and its lists in chunk order. A document whose only row
    has no chunk (NULL chunk_no) has NULL insights.
    """
    some = F.count("chunk_no") > 0
    return found.groupBy(key).agg(
        F.when(some, majority(in_order(["chunk_no"], "label"))).alias("sentiment"),
        *[F.when(some, F.flatten(in_order(["chunk_no"], c))).alias(c) for c in ("entities", "key_phrases")],
    )


def merge_chunks(found: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """Concatenate per-chunk lists of (key, chunk_no, column) in chunk order, duplicates kept."""
    return found.groupBy(key).agg(F.flatten(in_order(["chunk_no"], column)).alias(column))
