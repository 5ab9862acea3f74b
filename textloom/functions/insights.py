"""Deterministic sentiment, key phrases and entities for one piece of text."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from textloom.functions.arrays import let, run_counts
from textloom.functions.privacy import find_private
from textloom.functions.text import PUNCT, SPACE, bare_words

# Word weights and stop words used when the caller gives none.
LEXICON = {
    "good": 1, "great": 2, "excellent": 2, "happy": 1, "love": 2, "best": 2, "nice": 1, "success": 1,
    "positive": 1, "helpful": 1, "bad": -1, "poor": -1, "terrible": -2, "sad": -1, "hate": -2,
    "worst": -2, "wrong": -1, "failure": -1, "negative": -1, "broken": -1,
}
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on",
    "or", "that", "the", "this", "to", "was", "with",
)

ENTITY_TYPE = "array<struct<Text:string,Type:string,Score:double>>"
PHRASE_TYPE = "array<struct<Text:string,Score:double>>"
_BREAK = "\u0001"


def label(positive: Column, negative: Column) -> Column:
    """POSITIVE, NEGATIVE, MIXED or NEUTRAL from the two absolute sums of weights.

    MIXED: both sides occur and differ by at most a quarter of their total.
    """
    return (
        F.when((positive > 0) & (negative > 0) & (F.abs(positive - negative) * 4 <= positive + negative), "MIXED")
        .when(positive > negative, "POSITIVE")
        .when(negative > positive, "NEGATIVE")
        .otherwise("NEUTRAL")
    )


def sentiment(text: Column, lexicon: Mapping[str, int] = LEXICON, space: str = SPACE) -> Column:
    """Label of a text by a bounded lexicon, which becomes hash sets in the plan."""
    by_weight: dict[int, list[str]] = {}
    for word, weight in lexicon.items():
        by_weight.setdefault(weight, []).append(word)

    def occurrences(w: Column, members: list[str]) -> Column:
        return F.size(F.filter(w, lambda x: x.isin(members)))

    def total(w: Column, sign: int) -> Column:
        parts = [
            occurrences(w, members) * abs(weight)
            for weight, members in sorted(by_weight.items())
            if weight * sign > 0
        ]
        return sum(parts[1:], parts[0]) if parts else F.lit(0)

    weighted = F.filter(bare_words(F.lower(text), space), lambda x: x.isin(list(lexicon)))
    return let(weighted, lambda w: label(total(w, 1), total(w, -1)))


def phrases(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, space: str = SPACE) -> Column:
    """Runs of words between stop words and punctuation, in lower case and reading order.

    Punctuation counts where it touches white space. It becomes a break mark first; then stop
    words between blanks or marks are cut out.
    """
    lowered = F.lower(text) if space == " " else F.regexp_replace(F.lower(text), space + "++", " ")
    plain = F.concat(F.lit(" "), lowered, F.lit(" "))
    marked = F.regexp_replace(plain, rf"(?<!{PUNCT}){PUNCT}++(?= )| {PUNCT}++", _BREAK)
    parts = F.split(marked, f"[ {_BREAK}](?:{_alternatives(stop_words)})(?=[ {_BREAK}])|{_BREAK}")
    return F.filter(F.transform(parts, lambda p: F.btrim(p)), lambda p: p != "")


def _alternatives(listed: tuple[str, ...]) -> str:
    """Alternation of words by first letter, so that most of them fail at one character."""
    by_letter: dict[str, list[str]] = {}
    for word in listed:
        by_letter.setdefault(re.escape(word[0]), []).append(re.escape(word[1:]))
    return "|".join(f"{letter}(?:{'|'.join(rests)})" for letter, rests in by_letter.items())


def key_phrases(
    text: Column, top_k: int | None = None, stop_words: tuple[str, ...] = STOP_WORDS, space: str = SPACE
) -> Column:
    """Distinct phrases by falling score (occurrences times words), then by text."""
    scored = F.transform(
        run_counts(phrases(text, stop_words, space)),
        lambda r: F.struct(
            (-r["n"] * F.size(F.split(r["item"], " "))).cast("double").alias("rank"), r["item"].alias("item")
        ),
    )
    ordered = F.transform(
        F.sort_array(scored), lambda r: F.struct(r["item"].alias("Text"), (-r["rank"]).alias("Score"))
    )
    return ordered if top_k is None else F.slice(ordered, 1, top_k)


def entities(text: Column, names: Column | None = None) -> Column:
    """Matches of the detector in reading order, all with score 1."""
    return F.transform(
        find_private(text, names)[1],
        lambda m: F.struct(
            m["value"].alias("Text"), m["type"].alias("Type"), F.lit(1.0).alias("Score")
        ),
    )


def majority(labels: Column) -> Column:
    """The most frequent label; NULL votes too. Ties go to the smallest label, NULL last."""
    return F.array_min(
        F.transform(
            run_counts(labels),
            lambda r: F.struct(
                (-r["n"]).alias("votes"), r["item"].isNull().alias("missing"), r["item"].alias("label")
            ),
        )
    )["label"]
