"""Near-duplicates: SimHash fingerprints, linked through Golay keys of their segments and compared bit by bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textloom.llm import golay
from textloom.llm.common import hot_join, stored, text_of
from textloom.llm.graph import components
from textloom.llm.url_filter import only_possible

SEED = 42
MAX_ERRORS = 3
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15

KEYS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])


def words_of(text: str) -> list[bytes]:
    """Words between ASCII blanks, with A-Z in lower case."""
    return text.encode().lower().split()


def shingles_of(words: list[bytes], size: int) -> list[bytes]:
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(size)))]


def simhash(hashes: np.ndarray) -> int:
    """Bits set in over half of the unsigned 64-bit hashes; 0 without any."""
    total = np.zeros(64, np.int64)
    for start in range(0, len(hashes), BLOCK):
        total += np.unpackbits(hashes[start : start + BLOCK].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "little")


def fingerprint(text: str, size: int = 3) -> int:
    digest = xxhash.xxh64_intdigest
    found = [digest(s, SEED) for s in shingles_of(words_of(text), size)]
    return simhash(np.array(found, np.uint64))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(size: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            found = [_signed(fingerprint(text.as_py(), size)) for text in table.column("text")]
            yield pa.RecordBatch.from_arrays([table.column("id"), pa.array(found, pa.int64())], names=["id", "fp"])

    return run


def _link_keys(side: str):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recipes = golay.three_errors()
        for table in tables:
            values = table.column("fp").to_numpy()
            row, key = golay.keys(golay.cut64(values.view(np.uint64)), recipes, side)
            for start in range(0, len(row), 100_000):
                part = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(values[row[part]])], schema=KEYS)

    return run


def fingerprint_links(values: DataFrame) -> DataFrame:
    """Links a < b between distinct 64-bit values (column ``fp``) that differ in 3 bits or fewer: all of them.

    A value has at most 43,744 partners, whatever the number of rows. Keys take 30 to 36 bits of a
    value, so unrelated values rarely meet, and the join compares them before it makes a row.
    """
    left = values.select("fp").mapInArrow(_link_keys("left"), "key bigint, fp bigint")
    right = values.select("fp").mapInArrow(_link_keys("right"), "key bigint, fp bigint")
    left, right = left.withColumnRenamed("fp", "a"), right.withColumnRenamed("fp", "b")
    differing = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    joined = left.join(right, (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (differing <= MAX_ERRORS))
    return joined.select("a", "b").distinct()


def _kept_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


def _fingerprinted(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return stored(texts.mapInArrow(_fingerprints(size), f"id {_kept_type(docs, id_col)}, fp bigint"))


def _groups(rows: DataFrame) -> DataFrame:
    """``fp``, ``component_id``, ``n`` for the fingerprints of groups of two rows or more, stored."""
    values = stored(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    labels = components(fingerprint_links(values))
    linked = values.join(labels.withColumnRenamed("node", "fp"), "fp")
    first = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = linked.join(first, "component").select("fp", "component_id", "n")
    alone = values.join(linked.select("fp"), "fp", "left_anti").where("n > 1")
    return stored(linked.union(alone.select("fp", "first_id", "n")))


def fingerprint_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3
) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (hex), ``component_id``.

    Documents are linked where their fingerprints over ``size``-word shingles differ in 3 bits or fewer; the
    component is the smallest id that can be reached. Rows with the same fingerprint become one value
    before any join, so copies cost nothing; the values are joined by Golay keys and compared.

    Null and empty texts have fingerprint 0 and are linked like any other. Null ids belong to a component, which
    has a null id only if all its ids are null. Repeated rows stay, ids keep their type.
    """
    rows = _fingerprinted(docs, id_col, text_col, size)
    found = _groups(rows).withColumn("known", F.lit(True))
    joined = hot_join(rows, found, ["fp"], "n", ["component_id", "known"])
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """The input with one document of each group of ``fingerprint_groups``: that with the smallest id, with all its columns.

    Rows without id stay, and so do rows that repeat the smallest id. Only rows whose id may be among those that go
    are read again with their texts and meet them in a join, by id and fingerprint.
    """
    rows = _fingerprinted(docs, id_col, text_col, size)
    met = hot_join(rows, _groups(rows), ["fp"], "n", ["component_id"])
    gone = stored(met.where(F.col("id") != F.col("component_id")).groupBy("id", "fp").agg(F.count(F.lit(1)).alias("n")))
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("id", F.col(names[docs.columns.index(id_col)]))
    some, others = only_possible(plain, gone, "id")

    @F.pandas_udf("bigint")
    def fingerprints(texts):
        return texts.map(lambda text: _signed(fingerprint(text, size))).astype("int64")

    some = some.withColumn("fp", fingerprints(text_of(names[docs.columns.index(text_col)])))
    left = hot_join(some, gone.withColumn("gone", F.lit(True)), ["id", "fp"], "n", ["gone"]).where("gone is null")
    return others.select(*names).union(left.select(*names)).toDF(*docs.columns)
