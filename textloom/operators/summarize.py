"""Extractive summaries, the provider used when no model is given."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.functions.arrays import let
from textloom.functions.text import strip
from textloom.operators.lookup import materialize

# At 64 bytes a key at most, this many broadcast words stay far below 100 MB.
HOT_WORDS = 400_000
_LONGEST_KEY = 64
#: Texts that a Python worker holds at once, unless one text or the texts of one key are larger.
BUCKET_BYTES = 16 << 20


def sentences(text: Column) -> Column:
    """Runs up to a full stop, an exclamation or question mark or a line end, stripped."""
    runs = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(runs, strip), lambda s: s != "")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``statistics(word, docs)``: in how many texts each word occurs, stored by a checkpoint.

    Words are counted per task before the shuffle, so a common word moves once per task.
    """
    per_text = df.select(F.explode(F.array_distinct(terms(F.col(text)))).alias("word"))
    return materialize(per_text.groupBy("word").agg(F.count(F.lit(1)).alias("docs")))


def _word_key(word: Column) -> Column:
    """A key of bounded length: the word, or a digest of a long one (no word has a blank)."""
    return F.when(F.octet_length(word) <= _LONGEST_KEY, word).otherwise(F.concat(F.lit(" "), F.md5(word.cast("binary"))))


def _hot_level(statistics: DataFrame, hot_words: int) -> tuple[Column, int | None]:
    """Frequency level of a word, and the lowest one above which there are ``hot_words`` at most.

    Levels are logarithmic, so there are some hundreds of them whatever the corpus. The level is
    None when all words are hot.
    """
    level = F.floor(F.log2("docs") * 8).cast("int")
    total = 0
    for row in statistics.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > hot_words:
            return level, row["level"] + 1
    return level, None


def _dealt(df: DataFrame, size: int, text: str, key: str) -> DataFrame:
    """Texts with a ``_bucket`` of about BUCKET_BYTES; those of one key share one, those without a key are spread."""
    buckets = max(size // BUCKET_BYTES + 1, df.sparkSession.sparkContext.defaultParallelism * 2)
    spread = F.when(F.col(key).isNull(), F.col(text))
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key, spread), F.lit(buckets)).cast("int")).repartition("_bucket")


def _bucket_words(dealt: DataFrame, text: str) -> DataFrame:
    """``words(_bucket, word, docs)``, stored by a checkpoint: in how many texts of a bucket each of its words occurs."""
    per_text = dealt.select("_bucket", F.explode(F.array_distinct(terms(F.col(text)))).alias("word"))
    return materialize(per_text.groupBy("_bucket", "word").agg(F.count(F.lit(1)).alias("docs")))


def _weigh(words: DataFrame, statistics: DataFrame, n_docs: int, hot_words: int) -> DataFrame:
    """``(_bucket, word, idf)`` of the words in ``statistics``, in millionths.

    At most ``hot_words`` of the most common words are broadcast, with keys of bounded length, and only rarer words are
    joined by shuffle. A word has a row per bucket at most, so no join key holds a large share of the rows.
    """
    weight = F.round(F.log((F.lit(n_docs) + 1) / (F.col("docs") + 1)) * 1_000_000).cast("long")
    weights = statistics.withColumn("idf", weight)
    level, lowest = _hot_level(statistics, hot_words)
    hot = (weights if lowest is None else weights.where(level >= lowest)).select(
        _word_key(F.col("word")).alias("_key"), "idf"
    )
    marked = words.select("_bucket", "word", _word_key(F.col("word")).alias("_key")).join(
        F.broadcast(hot), "_key", "inner" if lowest is None else "left"
    )
    known = marked.where(F.col("idf").isNotNull()).select("_bucket", "word", "idf")
    if lowest is None:
        return known
    rare = marked.where(F.col("idf").isNull()).select("_bucket", "word")
    return known.unionByName(
        rare.join(weights.where(level < lowest).select("word", "idf").hint("merge"), "word").select("_bucket", "word", "idf")
    )


def _add_scores(rows: pa.Table, words: pa.Table, key: str, schema: pa.Schema) -> pa.Table:
    """The rows of a bucket with ``_scores``, from their ``_terms`` by sentence and the weights of the words of the bucket."""
    if not rows.num_rows:
        return schema.empty_table()
    by_row = rows["_terms"].combine_chunks()
    by_sentence = by_row.flatten()
    n_sentences, n_terms = (pc.list_value_length(lists).to_numpy(zero_copy_only=False) for lists in (by_row, by_sentence))
    found = by_sentence.flatten().dictionary_encode()
    codes, vocabulary = found.indices.to_numpy(), found.dictionary
    at = pc.index_in(vocabulary, value_set=words["word"].combine_chunks())
    known = at.is_valid().to_numpy(zero_copy_only=False)
    idf = np.append(words["idf"].to_numpy(), 0)[pc.fill_null(at, words.num_rows).to_numpy()]
    # Rows of one key are one text: their words are counted, and their sentences of one number scored, together.
    texts = rows[key].combine_chunks().dictionary_encode("encode").indices.to_numpy()
    width = np.zeros(texts.max() + 1, np.int64)
    np.maximum.at(width, texts, n_sentences)
    start = np.cumsum(width) - width
    before = np.cumsum(n_sentences) - n_sentences
    slots = np.repeat(start[texts] - before, n_sentences) + np.arange(len(by_sentence))
    slot = np.repeat(slots, n_terms)
    text = np.repeat(np.repeat(texts, n_sentences), n_terms).astype(np.int64)
    _, pair, tf = np.unique(text * len(vocabulary) + codes, return_inverse=True, return_counts=True)
    score = np.zeros(width.sum(), np.int64)
    np.add.at(score, slot, tf[pair] * idf[codes])
    n_words = np.bincount(slot[known[codes]], minlength=len(score))
    own = width[texts]
    ends = np.cumsum(own)
    sent_no = np.arange(own.sum()) - np.repeat(ends - own, own)
    wanted = np.repeat(start[texts], own) + sent_no
    scores = pa.StructArray.from_arrays(
        [pa.array(sent_no, pa.int32()), pa.array(score[wanted], pa.int64()), pa.array(n_words[wanted], pa.int64())],
        ["sent_no", "score", "n_words"],
    )
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), scores)
    return rows.append_column("_scores", lists).select(schema.names)


def score_sentences(dealt: DataFrame, weighed: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds ``_sentences`` and ``_scores(sent_no, score, n_words)``; scores are in millionths.

    Every occurrence of a word adds its count in the text times its inverse document frequency. The texts of a bucket
    meet the weights of its words; a word moves once per bucket, not once per occurrence. Texts are sorted by bucket
    before they are cut: a sort of sentences and terms holds several times their bytes, and spills them.
    """
    cut = F.coalesce(sentences(F.col(text)), F.array().cast("array<string>"))
    in_order = dealt.sortWithinPartitions("_bucket")
    split = in_order.withColumn("_sentences", cut).withColumn("_terms", F.transform("_sentences", terms))
    scores = F.lit(None).cast("array<struct<sent_no:int,score:bigint,n_words:bigint>>")
    out = split.drop("_bucket", "_terms").withColumn("_scores", scores).schema
    arrow = to_arrow_schema(out)
    return split.groupBy("_bucket").cogroup(weighed.groupBy("_bucket")).applyInArrow(
        lambda rows, words: _add_scores(rows, words, key, arrow), out
    )


def summarize(
    df: DataFrame,
    k: int = 3,
    text: str = "text",
    key: str = "doc_id",
    out: str = "summary",
    statistics: DataFrame | None = None,
    n_docs: int | None = None,
    hot_words: int = HOT_WORDS,
) -> DataFrame:
    """Add the ``k`` sentences with the highest mean score, in reading order.

    Pass ``statistics`` and ``n_docs`` of a corpus to score against it; else they come from
    ``df`` itself. Texts without a word or without a key get an empty summary.
    """
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    dealt = _dealt(df, size, text, key)
    words = _bucket_words(dealt, text)
    if statistics is None or n_docs is None:
        statistics, n_docs = materialize(words.groupBy("word").agg(F.sum("docs").alias("docs"))), rows
    scored = score_sentences(dealt, _weigh(words, statistics, n_docs, hot_words), text, key)
    ranked = F.transform(
        F.filter("_scores", lambda s: s["n_words"] > 0),
        lambda s: F.struct((-s["score"] / s["n_words"]).alias("mean"), s["sent_no"].alias("no")),
    )
    best = F.sort_array(F.transform(F.slice(F.sort_array(ranked), 1, k), lambda s: s["no"]))
    picked = let(best, lambda b: F.array_join(F.transform(b, lambda i: F.get("_sentences", i)), " "))
    summary = F.when(F.col(key).isNotNull(), picked).otherwise(F.lit(""))
    return scored.withColumn(out, summary).drop("_sentences", "_scores")
