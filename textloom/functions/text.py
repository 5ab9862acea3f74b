"""Text primitives: Python-style white space, words, n-grams, entity decoding."""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from textloom.functions.arrays import interleave, let

# The characters Python's str.split() and str.strip() treat as white space.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _char_class(chars: str) -> str:
    """A character class that reads the same in Java regular expressions and in RE2."""
    codes = sorted(map(ord, chars))
    parts, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        first, last = codes[i], codes[j]
        parts.append(rf"\x{{{first:x}}}" if first == last else rf"\x{{{first:x}}}-\x{{{last:x}}}")
        i = j + 1
    return "[" + "".join(parts) + "]"


WS_CLASS = _char_class(WHITESPACE)
# The same class for Java alone: letters fail after a bit set and one range test.
_RARE_SPACE = _char_class("".join(c for c in WHITESPACE if ord(c) > 255))
SPACE = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in WHITESPACE if ord(c) < 256) + r"[\x{1680}-\x{3000}&&" + _RARE_SPACE + "]]"
PUNCTUATION = ".,;:!?\"'()[]{}<>|/\\*#%$&=~`^_-+"
PUNCT = "[" + "".join("\\" + c for c in PUNCTUATION) + "]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Words between runs of white space, never empty ones."""
    return F.array_remove(F.split(strip(text), SPACE + "++"), "")


def bare_words(text: Column, space: str = SPACE) -> Column:
    """``bare`` of every word in one pass, without the words that have nothing left.

    ``space`` is a blank for text such as chunks, where nothing else stands between words.
    """
    return F.array_remove(
        F.split(F.btrim(text, F.lit(WHITESPACE + PUNCTUATION)), f"{PUNCT}*+{space}++{PUNCT}*+"), ""
    )


def bare(word: Column) -> Column:
    """The word without punctuation at either end."""
    return F.btrim(word, F.lit(PUNCTUATION))


def ngrams(text: Column, lengths: list[int]) -> Column:
    """Blank-joined n-grams of the given lengths in reading order, the longest first at each position."""
    if list(lengths) == [1]:
        return bare_words(text)
    return let(
        words(text),
        lambda w: F.flatten(
            F.transform(
                w,
                lambda _, i: F.filter(
                    F.array(
                        *[
                            F.when(i + n <= F.size(w), bare(F.array_join(F.slice(w, i + 1, F.lit(n)), " ")))
                            for n in sorted(lengths, reverse=True)
                        ]
                    ),
                    lambda g: g.isNotNull(),
                ),
            )
        ),
    )


# A named reference needs its semicolon, a numeric one does not.
_REFERENCE = r"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[A-Za-z][A-Za-z0-9]++;)"
_NAMED = json.dumps({**{k: chr(v) for k, v in name2codepoint.items()}, "apos": "'"})


def _character(code: Column) -> Column:
    """The character at a code point, empty for code points that markup may not hold."""
    allowed = (
        code.isin(9, 10, 13)
        | code.between(0x20, 0xD7FF)
        | code.between(0xE000, 0xFFFD)
        | code.between(0x10000, 0x10FFFF)
    )
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    return F.when(allowed, F.decode(utf32, "UTF-32")).otherwise(F.lit(""))


def _code_point(digits: Column, base: int) -> Column:
    """The number of a reference; leading zeros do not count, and what is too long is no code point."""
    plain = F.ltrim(digits, F.lit("0"))
    number = F.conv(plain, base, 10).cast("long")
    return F.when(F.length(plain) <= 7, F.coalesce(number, F.lit(0))).otherwise(F.lit(0))


def _resolve(reference: Column) -> Column:
    name = F.btrim(reference, F.lit("&;"))
    named = F.from_json(F.lit(_NAMED), "map<string,string>")
    return (
        F.when(F.lower(name).startswith("#x"), _character(_code_point(F.substr(name, F.lit(3)), 16)))
        .when(name.startswith("#"), _character(_code_point(F.substr(name, F.lit(2)), 10)))
        .when(name == "amp", F.lit("&"))
        .when(name == "nbsp", F.lit(" "))
        .otherwise(F.coalesce(F.try_element_at(named, name), reference))
    )


def decode_entities(text: Column) -> Column:
    """Decode character references in one pass from left to right; unknown names stay."""
    decoded = interleave(
        F.split(text, _REFERENCE), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), _resolve
    )
    return F.when(text.contains("&"), decoded).otherwise(text)
