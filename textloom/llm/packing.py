"""Packing of token pieces into sequences by linear grouping and best fit.

Only the number of pieces of each length matters, so the plan is made from a histogram of at most
``limit`` entries: large lengths are cut into groups of equal cardinality and rounded up to the largest
of their group; a linear program over configurations of these few sizes says how often each is used; actual lengths take
the places, the longest that the room left by rounding allows; and small pieces go where they fit best. The plan says, by length, which stretch of pieces goes to which sequences.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from textloom.llm.common import stored, text_of

LIMIT = 2_048
SEPARATOR = np.uint32(0).tobytes()
#: Words whose ids a task remembers.
HELD = 400_000
#: Large lengths start above limit / LARGE; they form GROUPS groups, so they become that many sizes.
LARGE = (4, 8, 2)
GROUPS = 40
#: Stages of the plan.
STAGES = 8
#: Rounds of the linear program per size; it may end before its optimum, any round gives a whole plan.
ROUNDS = 20

PIECES = pa.schema(
    [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]
)


class WordIds(dict):
    """Token ids of words between ASCII blanks, as little-endian bytes.

    Right for tokenizers that drop white space before they split: no token then spans two words. The letters of
    a plain word and the punctuation after it are tokenized apart, as the tokenizer does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters: dict[str, bytes] = {}
        self.byte_level = {}
        for code in (*range(97, 123), *range(223, 247), *range(248, 256)):
            ((mapped, _),) = self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(code))
            self.byte_level[code] = mapped

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        plain = SIMPLE.fullmatch(text)
        data = self._letters(plain[1].lower()) + self._encoded(plain[2]) if plain else self._encoded(text)
        if len(self) < HELD and len(word) < 64:
            self[word] = data
        return data

    def _letters(self, letters: str) -> bytes:
        found = self.letters.get(letters)
        if found is None:
            tokens = self.tokenizer.model.tokenize(letters.translate(self.byte_level)) if letters else []
            found = array("I", [t.id for t in tokens]).tobytes()
            if len(self.letters) < HELD and len(letters) < 64:
                self.letters[letters] = found
        return found

    def _encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if text else b""


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The words that this Python worker knows, kept from one task to the next."""
    return WordIds(path)


#: Latin letters and the punctuation after them, without apostrophes.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


def _pieces(path: str, limit: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(path)
        width = 4 * limit
        for table in tables:
            out: dict[str, list] = {name: [] for name in PIECES.names}
            for i, text in zip(table.column("id").to_pylist(), table.column("text")):
                data = b"".join(map(ids.__getitem__, text.as_py().encode().split())) + SEPARATOR
                for piece, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    for name, value in zip(PIECES.names, (i, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, PIECES)

    return run


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``id``, ``piece``, ``start``, ``length``, ``crc`` (of the ids): one row per piece of at most ``limit`` tokens."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return texts.mapInArrow(_pieces(path, limit), "id bigint, piece int, start bigint, length bigint, crc bigint")


# The plan: bins are kept as kinds (lengths in order) with how many there are of each.


def _groups(counts: dict[int, int], large: list[int], groups: int) -> dict[int, list[int]]:
    """Equal-cardinality groups of the large lengths: largest length -> its lengths, longest first."""
    total, found, filled, size = sum(counts[x] for x in large), {}, 0, 0
    for length in sorted(large, reverse=True):
        if filled * groups >= size * total:
            size += 1
            top = length
            found[top] = []
            while filled * groups >= size * total and size < groups:
                size += 1
        found[top].append(length)
        filled += counts[length]
    return found


def _fullest(left: dict[int, int], room: int) -> list[int]:
    """Sizes that fill ``room`` best, with at most as many of each as are left; large ones where they do."""
    full, reached, steps = (1 << room + 1) - 1, 1, []
    for size in sorted((s for s in left if s <= room), reverse=True):
        n = min(left[size], room // size)
        steps.append((size, n, reached))
        for k in range(1, n + 1):
            reached |= steps[-1][2] << k * size & full
        if reached >> room:
            break
    at, found = reached.bit_length() - 1, []
    for size, n, before in reversed(steps):
        k = next(k for k in range(n + 1) if at >= k * size and before >> at - k * size & 1)
        found += [size] * k
        at -= k * size
    return found


def _configurations(demand: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """(sizes, how often) for all demanded sizes: the largest first, each filled as well as possible."""
    left, found = dict(demand), []
    while left:
        top = max(left)
        rest = {s: n - (s == top) for s, n in left.items()}
        sizes = [top, *_fullest({s: n for s, n in rest.items() if n}, limit - top)]
        need = Counter(sizes)
        often = min(left[s] // n for s, n in need.items())
        found.append((sizes, often))
        for s, n in need.items():
            left[s] -= n * often
            if not left[s]:
                del left[s]
    return found


def _most_worth(sizes: list[int], worth: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """How many of each size fill a sequence with the most worth (a knapsack with as many of each as fit)."""
    best, before = np.zeros(limit + 1), []
    for size, value in zip(sizes, worth):
        before.append(best)
        if value > 0:
            best = best.copy()
            for start in range(size, limit + 1, size):
                stop = min(start + size, limit + 1)
                best[start:stop] = np.maximum(best[start:stop], best[start - size : stop - size] + value)
    room, taken = limit, np.zeros(len(sizes))
    for k in range(len(sizes) - 1, -1, -1):
        held = best
        best = before[k]
        while room >= sizes[k] and worth[k] > 0 and held[room] > best[room] + 1e-12:
            taken[k] += 1
            room -= sizes[k]
    return float(worth @ taken), taken


def _optimised(demand: dict[int, int], limit: int) -> list[tuple[list[int], int]]:
    """(sizes, how often) for all demanded sizes, by column generation.

    A linear program has one sequence for each size and finds, by its prices, the configuration that is worth most, until none
    is worth more than a sequence. Whole numbers of its configurations are used; the sizes that are left, less than a
    sequence of each, are filled one configuration after another.
    """
    sizes = sorted(demand, reverse=True)
    if not sizes:
        return []
    wanted = np.array([demand[s] for s in sizes], float)
    columns = np.diag([float(limit // s) for s in sizes])
    for _ in range(ROUNDS * len(sizes)):
        worth, taken = _most_worth(sizes, np.linalg.solve(columns.T, np.ones(len(sizes))), limit)
        if worth <= 1 + 1e-7:
            break
        often, change = np.linalg.solve(columns, wanted), np.linalg.solve(columns, taken)
        falls = change > 1e-9
        if not falls.any():
            break
        steps = np.where(falls, np.maximum(often, 0) / np.where(falls, change, 1), np.inf)
        columns[:, int(steps.argmin())] = taken
    often = np.floor(np.linalg.solve(columns, wanted) + 1e-6).astype(np.int64)
    left, found = dict(demand), []
    for column, n in zip(columns.T.astype(int), often.tolist()):
        need = {s: int(k) for s, k in zip(sizes, column) if k}
        n = min([n, *(left[s] // k for s, k in need.items())])
        if n > 0:
            found.append(([s for s, k in need.items() for _ in range(k)], n))
            for s, k in need.items():
                left[s] -= k * n
    return found + _configurations({s: n for s, n in left.items() if n}, limit)


def _substitute(configurations, counts: dict[int, int], limit: int) -> tuple[Counter, dict[int, int]]:
    """Kinds of bins with actual lengths in the places of configurations, and the lengths that found no place.

    A place takes the longest piece that is left and leaves room for the places behind it, so what rounding spared in the
    places before is used; what is left behind the last place takes more pieces where they fit. Configurations with the
    largest sizes come first.
    """
    kinds: Counter = Counter()
    left, lengths = dict(counts), sorted(counts)
    for sizes, often in sorted(((sorted(sizes, reverse=True), n) for sizes, n in configurations), reverse=True):
        while often and lengths:
            kind, behind = [], sum(sizes)
            mine: Counter = Counter()
            for size in sizes:
                behind -= size
                at = bisect_right(lengths, limit - sum(kind) - behind) - 1
                while at >= 0 and mine[lengths[at]] >= left[lengths[at]]:
                    at -= 1
                if at >= 0:
                    kind.append(lengths[at])
                    mine[lengths[at]] += 1
            at = bisect_right(lengths, limit - sum(kind)) - 1
            while at >= 0:
                if mine[lengths[at]] < left[lengths[at]]:
                    kind.append(lengths[at])
                    mine[lengths[at]] += 1
                    at = bisect_right(lengths, limit - sum(kind)) - 1
                else:
                    at -= 1
            if not kind:
                break
            take = min([often, *(left[x] // n for x, n in mine.items())])
            kinds[tuple(kind)] += take
            often -= take
            for length, n in mine.items():
                left[length] -= n * take
                if not left[length]:
                    lengths.remove(length)
    return kinds, {x: left[x] for x in lengths}


def _best_fit(kinds: Counter, small: dict[int, int], limit: int) -> Counter:
    """Put small lengths, longest first, into the bins with the least room that is enough."""
    rooms: dict[int, Counter] = {}

    def add(kind: tuple, n: int) -> None:
        rooms.setdefault(limit - sum(kind), Counter())[kind] += n

    for kind, n in kinds.items():
        add(kind, n)
    for length in sorted(small, reverse=True):
        n = small[length]
        while n:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                per = limit // length
                if n >= per:
                    add((length,) * per, n // per)
                    n %= per
                if n:
                    add((length,) * n, 1)
                    n = 0
                break
            # All bins of this room are alike: as many pieces as fit go into each.
            kind, bins = next(iter(rooms[room].items()))
            per = min(room // length, n)
            used = min(bins, n // per)
            rooms[room][kind] -= used
            if not rooms[room][kind]:
                del rooms[room][kind]
            if not rooms[room]:
                del rooms[room]
            add(kind + (length,) * per, used)
            n -= used * per
    return sum(rooms.values(), Counter())


def plan_bins(counts: dict[int, int], limit: int = LIMIT, groups: int = GROUPS) -> Counter:
    """Kinds of sequences (lengths in order) and how many of each; the best over a few bounds of what counts as large.

    The large lengths are planned in STAGES stages. Each uses half of its configurations and leaves the other half of the work to
    the next one, which groups what is left anew: pieces that took a place of a smaller size are then accounted for.
    """
    best: Counter | None = None
    for large in LARGE:
        left = {x: n for x, n in counts.items() if x * large > limit}
        kinds: Counter = Counter()
        for stage in range(STAGES):
            grouped = _groups(left, list(left), groups)
            demand = {top: sum(left[x] for x in lengths) for top, lengths in grouped.items()}
            configurations = _optimised(demand, limit)
            if stage + 1 < STAGES:
                configurations = [(sizes, math.ceil(n / 2)) for sizes, n in configurations]
            some, left = _substitute(configurations, left, limit)
            kinds += some
        small = {x: n for x, n in counts.items() if x * large <= limit}
        kinds = _best_fit(kinds, small | left, limit)
        if best is None or sum(kinds.values()) < sum(best.values()):
            best = kinds
    return best


def stretches(kinds: Counter) -> dict[int, np.ndarray]:
    """By length: rows of (first rank, first sequence, offset); ranks go on to the next row's first rank."""
    found: dict[int, list] = {}
    ranks: Counter = Counter()
    sequence = 0
    for kind, n in kinds.items():
        offset = 0
        for length in kind:
            found.setdefault(length, []).append((ranks[length], sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return {length: np.array(rows, np.int64) for length, rows in found.items()}


def _place(plan):
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables:
            lengths, ranks = table.column("length").to_numpy(), table.column("rank").to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                rows, mine = plan.value[length], lengths == length
                at = np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1
                sequence[mine] = rows[at, 1] + ranks[mine] - rows[at, 0]
                offset[mine] = rows[at, 2]
            arrays = [*(table.column(n) for n in PIECES.names), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Documents are tokenized, closed with id 0, and cut only where they are longer than ``limit``. The driver gets
    one count per length. Pieces of one length are numbered in parallel: by bucket, with the sums of the
    buckets before. Null texts count as empty: one token, the closing one. Repeated rows are packed each.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, path, id_col, text_col, limit))
    # Ranks need the rows of a (length, bucket) together; buckets split lengths that many pieces have.
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(buckets)).cast("int")
    dealt = pieces.withColumn("bucket", bucket)
    sums = stored(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(stretches(plan_bins(counts, limit)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "crc")
    ranked = dealt.withColumn("place", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"])
    placed = ranked.select(*PIECES.names, (F.col("base") + F.col("place")).alias("rank")).mapInArrow(
        _place(plan),
        "id bigint, piece int, start bigint, length bigint, crc bigint, sequence_id bigint, offset bigint",
    )
    return placed.withColumnsRenamed({"id": id_col, "crc": "ids_crc32"})
