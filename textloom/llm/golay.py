"""Binary Golay code of length 23: nearest codewords of words, and join keys made of them.

The code is perfect: every 23-bit word lies within distance 3 of exactly one codeword, its centre. Words x and y that
differ in one bit at most always meet: the centre of x is among the codewords within distance 4 of
y. Those are the centre of y and, where y is 3 away from it, five more.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np

#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECK = 23, 11
NEAR = 6
#: Where a key has the number of its recipe, above all parts.
RECIPE = 56


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders by high bits; by remainder, the error and the five codewords beyond it (0: none)."""
    high = np.array([_remainder(i << CHECK) for i in range(1 << (LENGTH - CHECK))], np.uint32)
    words = (np.arange(1 << (LENGTH - CHECK), dtype=np.uint32) << np.uint32(CHECK)) ^ high
    seven = words[np.bitwise_count(words) == 7]
    error = np.zeros(1 << CHECK, np.uint32)
    beyond = np.zeros((1 << CHECK, NEAR - 1), np.uint32)
    bits = [1 << i for i in range(LENGTH)]
    for i, a in enumerate(bits):
        error[_remainder(a)] = a
        for j, b in enumerate(bits[:i]):
            error[_remainder(a | b)] = a | b
            for c in bits[:j]:
                place = _remainder(a | b | c)
                error[place] = a | b | c
                beyond[place] = seven[(seven & np.uint32(a | b | c)) == (a | b | c)]
    return high, error, beyond


def near_codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords near each word, centre first, and which of the six there are."""
    high, error, beyond = _tables()
    words = words.astype(np.uint32)
    rest = high[words >> np.uint32(CHECK)] ^ (words & np.uint32((1 << CHECK) - 1))
    centre = words ^ error[rest]
    more = beyond[rest]
    found = np.concatenate([centre[:, None], centre[:, None] ^ more], axis=1)
    there = np.concatenate([np.ones((len(words), 1), bool), more > 0], axis=1)
    return found >> np.uint32(CHECK), there


@dataclass(frozen=True)
class Part:
    """Part of a key: ``first`` and ``second`` give the centre on one side and all near codewords on the other."""

    kind: str
    segment: int
    shift: int = 0
    bits: int = LENGTH


def keys(segments: list[np.ndarray], recipes: list[list[Part]], side: str) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys. ``side`` is left or right; keys of two recipes never agree."""
    near = [near_codewords(s) for s in segments]
    rows, found = [], []
    for number, recipe in enumerate(recipes):
        key = np.zeros((len(segments[0]), 1), np.int64)
        there = np.ones((len(segments[0]), 1), bool)
        for part in recipe:
            if part.kind == "exact":
                cut = (segments[part.segment] >> np.uint32(part.shift)) & np.uint32((1 << part.bits) - 1)
                values, present, width = cut[:, None], np.ones((len(cut), 1), bool), part.bits
            else:
                values, present = near[part.segment]
                width = LENGTH - CHECK
                if (part.kind == "first") == (side == "left"):
                    values, present = values[:, :1], present[:, :1]
            key = ((key << width)[:, :, None] | values.astype(np.int64)[:, None, :]).reshape(len(key), -1)
            there = (there[:, :, None] & present[:, None, :]).reshape(len(key), -1)
        row, column = np.nonzero(there)
        rows.append(row)
        found.append(key[row, column] | number << RECIPE)
    return np.concatenate(rows), np.concatenate(found)


def three_errors(segments: int = 3) -> list[list[Part]]:
    """Recipes that bring together any two words of 64 bits, cut by ``cut64``, that differ in 3 bits or fewer.

    Either a segment has no error: then one of the two others has one error at most. Or each has one: then
    one half of the last has none.
    """
    exact = [[Part("exact", i), Part("first", j)] for i in range(segments) for j in range(segments) if i != j]
    halves = [[Part("first", 0), Part("second", 1), Part("exact", 2, s, b)] for s, b in ((0, 11), (11, 10))]
    return exact + halves


def cut64(values: np.ndarray) -> list[np.ndarray]:
    """Segments of 22, 21 and 21 bits of unsigned 64-bit words."""
    return [
        (values >> np.uint64(42)).astype(np.uint32),
        (values >> np.uint64(21) & np.uint64((1 << 21) - 1)).astype(np.uint32),
        (values & np.uint64((1 << 21) - 1)).astype(np.uint32),
    ]
