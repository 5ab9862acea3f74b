"""Greedy packing of words into chunks of a limited size."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textloom.functions.arrays import let
from textloom.functions.text import SPACE, strip, words

MAX_BYTES = 4000
_BLOCK = 32


def chunk_texts(text: Column, max_bytes: int = MAX_BYTES) -> Column:
    """``array<string>`` of chunks holding at most ``max_bytes`` UTF-8 bytes of words.

    Blanks between words are not counted. A longer word is a chunk of its own, and an empty
    chunk precedes it when it is the first word. The fold only tracks where chunks start, so
    the work is linear in the words; the texts are cut out afterwards. It takes blocks of words
    that fit as a whole and single words only around the end of a chunk.
    """

    def step(acc: Column, word: Column) -> Column:
        size = F.octet_length(word)
        fits = acc["size"] + size <= max_bytes
        return F.struct(
            F.when(fits, acc["starts"])
            .otherwise(F.concat(acc["starts"], F.array(acc["i"])))
            .alias("starts"),
            F.when(fits, acc["size"] + size).otherwise(size.cast("long")).alias("size"),
            (acc["i"] + 1).alias("i"),
        )

    def block_step(acc: Column, block: Column) -> Column:
        size = acc["size"] + F.octet_length(F.array_join(block, ""))
        return F.when(
            size <= max_bytes,
            F.struct(acc["starts"].alias("starts"), size.alias("size"), (acc["i"] + F.size(block)).alias("i")),
        ).otherwise(F.aggregate(block, acc, step))

    def cut(w: Column) -> Column:
        zero = F.struct(
            F.array().cast("array<int>").alias("starts"),
            F.lit(0).cast("long").alias("size"),
            F.lit(0).alias("i"),
        )
        blocks = F.transform(
            F.sequence(F.lit(1), F.size(w), F.lit(_BLOCK)), lambda first: F.slice(w, first, F.lit(_BLOCK))
        )
        starts = F.aggregate(blocks, zero, block_step, lambda acc: acc["starts"])
        bounds = F.concat(F.array(F.lit(0)), starts, F.array(F.size(w)))
        many = let(
            bounds,
            lambda b: F.transform(
                F.sequence(F.lit(0), F.size(b) - 2),
                lambda k: F.array_join(
                    F.slice(w, F.get(b, k) + 1, F.get(b, k + 1) - F.get(b, k)), " "
                ),
            ),
        )
        return F.when(F.size(w) == 0, none).otherwise(many)

    # Most texts are one chunk, which needs no words.
    none = F.array().cast("array<string>")
    whole = F.regexp_replace(strip(text), SPACE + "++", " ")
    return F.when(
        F.octet_length(text) <= max_bytes, F.when(strip(text) == "", none).otherwise(F.array(whole))
    ).otherwise(let(words(text), cut))
