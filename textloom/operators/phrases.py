"""Known phrases found in one pass over each text, through a trie of their words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textloom.functions.arrays import interleave
from textloom.functions.privacy import PRIVATE, PRIVATE_TYPES, private_type
from textloom.functions.text import PUNCTUATION, WHITESPACE, words
from textloom.operators.lookup import MAX_BROADCAST_ROWS, rows_if_small
from textloom.operators.names import find_names
from textloom.operators.privacy import replace_matches
from textloom.session import bound_batches

PHRASES_TYPE = "struct<gaps:array<string>,matches:array<struct<value:string,name:string,type:string>>>"
_WORD = re.compile(r"\S+")


class Trie:
    """Phrases by their words: ``next`` leads from node and word to a node, ``ends`` to the phrases that end there."""

    def __init__(self, phrases: Iterable[tuple[str, str]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[dict[str, tuple[str, str]]] = [{}]
        for name, kind in phrases:
            *inner, last = name.split(" ")
            node = 0
            for word in inner:
                node = self.next[node].setdefault(word, len(self.next))
                if node == len(self.next):
                    self.next.append({})
                    self.ends.append({})
            self.ends[node][last] = (name, kind)

    def spans(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        """Begin, end, name and type of the leftmost phrases, the longest at each place; none overlap."""
        told = [(m.start(), m.group()) for m in _WORD.finditer(text)]
        at = 0
        while at < len(told):
            word = told[at][1].lstrip(PUNCTUATION)
            begin = here = told[at][0] + len(told[at][1]) - len(word)
            node, reached, best = 0, at, None
            while True:
                stem = word.rstrip(PUNCTUATION)
                if stem in self.ends[node]:
                    best = (reached, here + len(stem), *self.ends[node][stem])
                node, reached = self.next[node].get(word), reached + 1
                if node is None or reached == len(told):
                    break
                here, word = told[reached]
            if best:
                yield begin, *best[1:]
                at = best[0]
            at += 1


def _cut(trie: Trie, text: str | None) -> tuple[list, list] | tuple[None, None]:
    if text is None:
        return None, None
    gaps, matches, last = [], [], 0
    for begin, end, name, kind in trie.spans(text):
        gaps.append(text[last:begin])
        matches.append({"value": text[begin:end], "name": name, "type": kind})
        last = end
    return [*gaps, text[last:]], matches


def _marker(make: Callable[[], Trie]):
    @F.pandas_udf(PHRASES_TYPE)
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = make()
        for batch in batches:
            yield pd.DataFrame([_cut(trie, t) for t in batch], columns=["gaps", "matches"])

    return mark


def _own_marker():
    """As the marker, with the names of each row."""

    @F.pandas_udf(PHRASES_TYPE)
    def mark(texts: pd.Series, listed: pd.Series) -> pd.DataFrame:
        rows = [_cut(Trie((n["name"], n["type"]) for n in names), t) for t, names in zip(texts, listed)]
        return pd.DataFrame(rows, columns=["gaps", "matches"])

    return mark


def find_phrases(
    df: DataFrame, gazetteer: DataFrame, text: str = "text", out: str = "phrases", max_rows: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Add the phrases of ``gazetteer(name, type)`` in each text, and the text between them.

    Words stand between white space and are compared without punctuation at the ends of the phrase. Reading from the left,
    the longest phrase at a place counts, and the next one starts after it. A text is read once, whatever the number of
    names and hits; texts do not move. A name with several types has the smallest; names without a type or a word count
    for nothing. A NULL text has NULL gaps and matches.

    A gazetteer of up to ``max_rows`` rows and 64 MB is known to every task. A larger one is joined first, by
    ``find_names``, and each text is read with the names that occur in it: the result is the same.
    """
    bound_batches(df.sparkSession)
    plain = F.btrim(F.array_join(words(F.col("name")), " "), F.lit(WHITESPACE + PUNCTUATION))
    listed = gazetteer.select(plain.alias("name"), "type").where("name <> '' AND type IS NOT NULL")
    listed = listed.groupBy("name").agg(F.min("type").alias("type"))
    rows = rows_if_small(listed, max_rows, max_bytes=64 << 20)
    if rows is None:
        own = find_names(df, listed, text, "_names", max_inline=0)
        return own.withColumn(out, _own_marker()(F.col(text), F.col("_names"))).drop("_names")
    known = df.sparkSession.sparkContext.broadcast([(r["name"], r["type"]) for r in rows])
    return df.withColumn(out, _marker(lambda: Trie(known.value))(F.col(text)))


def anonymize_phrases(
    df: DataFrame, phrases: str = "phrases", text: str = "text", replacement: str = "[Customer]", kind: str = "ORG"
) -> DataFrame:
    """Put ``replacement`` in the place of every phrase of type ``kind``; other phrases stay as they are written."""
    put = lambda m: F.when(m["type"] == kind, F.lit(replacement)).otherwise(m["value"])
    return df.withColumn(text, interleave(F.col(phrases)["gaps"], F.col(phrases)["matches"], put)).withColumn(
        text, F.when(F.col(phrases)["gaps"].isNotNull(), F.col(text))
    )


def tokenize_phrases(
    df: DataFrame,
    phrases: str = "phrases",
    text: str = "text",
    types: tuple[str, ...] = PRIVATE_TYPES,
    out: str = "token_map",
) -> DataFrame:
    """As ``privacy.tokenize`` with the phrases found before as names; addresses, numbers and dates are looked for between them."""
    between = F.transform(
        F.col(phrases)["gaps"],
        lambda g: F.struct(F.split(g, PRIVATE).alias("gaps"), F.regexp_extract_all(g, F.lit(PRIVATE), F.lit(0)).alias("values")),
    )
    found = df.withColumn("_between", between)
    matches = F.transform(
        "_between",
        lambda b, i: F.concat(
            F.transform(b["values"], lambda v: F.struct(v.alias("value"), private_type(v).alias("type"))),
            F.transform(
                F.slice(F.col(phrases)["matches"], i + 1, F.lit(1)),
                lambda m: F.struct(m["value"].alias("value"), m["type"].alias("type")),
            ),
        ),
    )
    gaps = F.flatten(F.transform("_between", lambda b: b["gaps"]))
    return replace_matches(found.withColumns({"_gaps": gaps, "_matches": F.flatten(matches)}).drop("_between"), text, out, types)
