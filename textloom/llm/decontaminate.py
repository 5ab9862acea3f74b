"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders. Windows of the resulting templates, and of the plain words in lower
case for copies in another case, are joined by hash; a match counts
if the values in the places of a document follow from those of the item, so an item with other
numbers and names is found as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import HEAVY_KEYS, batches, hot_join, stored, text_of
from textloom.llm.url_filter import only_possible
from textloom.operators.lookup import fits_broadcast

WINDOW = 8
#: Share of an item's words that a document must hold, or words of one passage with the item's own values.
SHARE = 0.5
PASSAGE = 13
#: Parts that a frequent window is split into where the windows are too many to broadcast.
SPLIT = 64
#: The prefilter is a bitmap of 2 ** BITS bits, whatever the number of items.
BITS = 24

# Words with a meaning of their own.
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million"
UNIT_WORDS = (
    "kg g mg lb lbs oz km cm mm mile miles meter meters metre metres foot feet inch inches yard yards second seconds minute "
    "minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros pound pounds percent "
    "liter liters litre litres ml gallon gallons mph kph degree degrees"
)
STARTERS = (
    "a an and are as at but by can did do does each every find for from given has have he her his how i if in is it its let "
    "many much my no not of on one or she some suppose that the their then there these they this to was we were what when "
    "where which who why will with you your"
)
NUMBERS, UNITS, PLAIN = (frozenset(x.split()) for x in (NUMBER_WORDS, UNIT_WORDS, STARTERS))
NUMBER = re.compile(r"[$€£]?[+-]?\d+(?:[.,:/]\d+)*(?:%|st|nd|rd|th)?")
MEASURE = re.compile(r"[$€£]?[+-]?\d+(?:[.,]\d+)*(?:kg|g|mg|lb|km|cm|mm|m|ml|l|h|s|mph|kph)")
EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])).replace("$", "").replace("+", "")

#: Words of a task's dictionary, and their bytes, before it is emptied between two texts.
HELD, HELD_BYTES = 300_000, 64 << 20
#: So many names, or number words, side by side are one placeholder; longer runs, as in titles, stay word by word.
RUN = 4


#: Keeps hashes of words in lower case apart from those of templates.
FOLD = 1


def canonical(word: str) -> tuple[str, str]:
    """Template word and value: a typed placeholder with its value, or the lower-cased word and ''."""
    bare = word.strip(EDGES) or word
    low = bare.lower()
    if low in NUMBERS:
        return "#number", low
    # Both patterns need a digit.
    if not low.isalpha():
        if NUMBER.fullmatch(low):
            return "#number", low
        if MEASURE.fullmatch(low):
            return "#measure", low
    if low in UNITS:
        return "#unit", low
    if bare[0].isupper() and low not in PLAIN:
        return "#name", low
    return low, ""


KINDS = ("", "#number", "#measure", "#unit", "#name")
JOINED = np.array([kind in ("#number", "#name") for kind in KINDS])
PLACES = {kind: xxhash.xxh64_intdigest(kind.encode()) for kind in KINDS[1:]}
STOPS = frozenset(b",;:.!?)]}\"")


class Vocabulary(dict):
    """Numbers of words, and by number: hash of the template word, its kind and value, hash of the lower-cased word.

    ``stops`` tells whether punctuation ends the word, so that no run of names goes on behind it.
    """

    def __init__(self):
        super().__init__()
        self.template, self.folded = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.kinds, self.stops = np.zeros(1 << 12, np.int8), np.zeros(1 << 12, bool)
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.values: list[str] = []
        self.fresh: tuple[list, ...] = ([], [], [], [])
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        kind, value = canonical(word.decode())
        low = (value or kind).encode()
        templates, folds, kinds, stops = self.fresh
        templates.append(PLACES[kind] if value else xxhash.xxh64_intdigest(low))
        folds.append(xxhash.xxh64_intdigest(low, FOLD))
        kinds.append(KINDS.index(kind) if value else 0)
        stops.append(word[-1] in STOPS)
        number = self[word] = len(self.values)
        self.values.append(value)
        self.held += len(word)
        return number

    def settle(self) -> None:
        """Put the words of this text that were new into the arrays."""
        n, first = len(self.values), len(self.values) - len(self.fresh[0])
        for name, told in zip(("template", "folded", "kinds", "stops"), self.fresh):
            column = getattr(self, name)
            if n > len(column):
                column = np.concatenate([column, np.zeros(max(n, 2 * len(column)) - len(column), column.dtype)])
                setattr(self, name, column)
            column[first:n] = told
            told.clear()

    def read(self, text: bytes) -> Words:
        if len(self) > HELD or self.held > HELD_BYTES:
            self.empty()
        split = text.split()
        numbers = np.fromiter(map(self.__getitem__, split), np.int64, len(split))
        self.settle()
        return Words(self, numbers)


class Words:
    """The words of a text, and its template: ``starts`` are the words that template words begin with."""

    def __init__(self, known: Vocabulary, numbers: np.ndarray):
        self.known, self.numbers = known, numbers
        n, kinds = len(numbers), known.kinds[numbers]
        new = np.ones(n, bool)
        new[1:] = (kinds[1:] != kinds[:-1]) | known.stops[numbers[:-1]]
        runs = np.flatnonzero(new)
        sizes = np.diff(np.append(runs, n))
        one = (sizes > 1) & (sizes <= RUN) & JOINED[kinds[runs]]
        self.starts = np.flatnonzero(new | ~np.repeat(one, sizes))
        self.kinds = kinds[self.starts]

    def __len__(self) -> int:
        return len(self.numbers)

    def hashes(self, fold: bool) -> np.ndarray:
        return self.known.folded[self.numbers] if fold else self.known.template[self.numbers[self.starts]]

    def begin(self, place: int) -> int:
        """First word of a template word, or the end of the text."""
        return int(self.starts[place]) if place < len(self.starts) else len(self.numbers)

    def value(self, place: int) -> str:
        told = self.numbers[self.begin(place) : self.begin(place + 1)].tolist()
        return " ".join(self.known.values[i] for i in told)

    def values(self, place: int, size: int) -> list[str]:
        """Kinds and values of the placeholders in a window of template words."""
        kinds = self.kinds[place : place + size].tolist()
        return [f"{KINDS[kind]}={self.value(place + i)}" for i, kind in enumerate(kinds) if kind]


def _numbered(words: Words) -> str:
    """Template of a whole item, with the places numbered by value: items that ask the same with other values agree."""
    numbers: dict[tuple, int] = {}
    told = []
    for place, (digest, kind) in enumerate(zip(words.hashes(False).tolist(), words.kinds.tolist())):
        told.append(f"{KINDS[kind]}{numbers.setdefault((kind, words.value(place)), len(numbers))}" if kind else f"{digest:x}")
    return " ".join(told)


#: Odd factors of the two hashes of a window.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def run_hashes(words: np.ndarray, spots: np.ndarray | None, size: int, factor: np.uint64) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from each of ``spots``, or from every place that has as many."""
    n = max(0, len(words) - size + 1) if spots is None else len(spots)
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total *= factor
        total += words[i : i + n] if spots is None else words[spots + i]
    total ^= total >> np.uint64(31)
    total *= factor
    total ^= total >> np.uint64(29)
    return total


ITEMS = pa.schema([("item_id", pa.int64()), ("text", pa.string()), ("template", pa.binary())])
ITEM_WINDOWS = pa.schema(
    [
        ("first", pa.int64()),
        ("second", pa.int64()),
        ("size", pa.int32()),
        ("item_id", pa.int64()),
        ("fold", pa.bool_()),
        ("place", pa.int32()),
        ("begin", pa.int32()),
        ("end", pa.int32()),
        ("n_words", pa.int32()),
        ("slots", pa.list_(pa.string())),
        ("literals", pa.int32()),
    ]
)
DOC_WINDOWS = pa.schema(
    [
        ("hash", pa.binary()),
        ("first", pa.int64()),
        ("second", pa.int64()),
        ("size", pa.int32()),
        ("at", pa.int64()),
        ("values", pa.list_(pa.string())),
    ]
)


def _templates(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        known = Vocabulary()
        for table in tables:
            for item, text in zip(table.column("item_id").to_pylist(), table.column("text").to_pylist()):
                words = known.read(text.encode())
                if len(words):
                    yield {"item_id": item, "text": text, "template": xxhash.xxh3_128_digest(_numbered(words))}

    yield from batches(rows(), ITEMS)


def _item_windows(size: int, fold: bool = False):
    """Windows of templates, or of the lower-cased words: these have no places for values."""

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            known = Vocabulary()
            for table in tables:
                for item, text in zip(table.column("item_id").to_pylist(), table.column("text").to_pylist()):
                    words = known.read(text.encode())
                    hashes = words.hashes(fold)
                    wide = min(size, len(hashes))
                    spots = np.arange(len(hashes) - wide + 1)
                    first, second = (run_hashes(hashes, spots, wide, f).view(np.int64).tolist() for f in FACTORS)
                    for place, (a, b) in enumerate(zip(first, second)):
                        slots = [] if fold else words.values(place, wide)
                        begin, end = (place, place + wide) if fold else (words.begin(place), words.begin(place + wide))
                        yield {
                            "first": a, "second": b, "size": wide, "item_id": item, "fold": fold, "place": place,
                            "begin": begin, "end": end, "n_words": len(words), "slots": slots, "literals": wide - len(slots),
                        }

        yield from batches(rows(), ITEM_WINDOWS)

    return run


def _doc_windows(sizes: list[int], bitmap, any_case: bool):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            known, bits = Vocabulary(), bitmap.value
            for table in tables:
                for digest, text in zip(table.column("hash").to_pylist(), table.column("text").cast(pa.binary())):
                    words = known.read(text.as_py())
                    for fold, size in product((False, True) if any_case else (False,), sizes):
                        hashes = words.hashes(fold)
                        first = run_hashes(hashes, None, size, FACTORS[0])
                        spot = first >> np.uint64(64 - BITS)
                        hits = np.flatnonzero(bits[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1))
                        if not len(hits):
                            continue
                        second = run_hashes(hashes, hits, size, FACTORS[1]).view(np.int64).tolist()
                        for at, one, two in zip(hits.tolist(), first[hits].view(np.int64).tolist(), second):
                            yield {
                                "hash": digest, "first": one, "second": two, "size": size, "at": at, "values": [] if fold else words.values(at, size),
                            }

        yield from batches(rows(), DOC_WINDOWS, 5_000)

    return run


def _bitmap(windows: DataFrame) -> np.ndarray:
    """Bitmap of the hashes; at most 2 ** (BITS - 6) words come to the driver."""
    spot = F.shiftrightunsigned("first", 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(63)).cast("int"))
    words = windows.groupBy(F.shiftright(spot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bitmap


def _split_join(found: DataFrame, windows: DataFrame, on: list[str]) -> DataFrame:
    """Join by shuffle where a key may be frequent on both sides; ``found`` is stored.

    The HEAVY_KEYS most frequent keys of ``found`` meet in SPLIT parts each, with a copy of their windows per part; any
    other key holds at most 1 in HEAVY_KEYS of the rows.
    """
    frequent = found.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    heavy = F.broadcast(stored(frequent.orderBy(F.desc("_n"), *on).limit(HEAVY_KEYS)))
    part = F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("hash", "at"), F.lit(SPLIT))).otherwise(0)
    parts = F.when(F.col("_n").isNotNull(), F.sequence(F.lit(0), F.lit(SPLIT - 1))).otherwise(F.array(F.lit(0)))
    left = found.join(heavy, on, "left").withColumn("_part", part.cast("int")).drop("_n")
    right = windows.join(heavy, on, "left").withColumn("_part", F.explode(parts)).drop("_n")
    return left.join(right, [*on, "_part"]).drop("_part")


def matches(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    size: int = WINDOW,
    share: float = SHARE,
    passage: int = PASSAGE,
    any_case: bool = False,
) -> DataFrame:
    """``hash`` (128 bits of the text), ``leaks`` (item_id, n_items, covered, exact), ``n``: for texts with a leak.

    Items that differ only in their values are one: the smallest id stands for all ``n_items``. A window that
    keeps fewer than half of its words must have the item's own values. Places must map one to one
    for names, and by a function for numbers and units. ``covered`` is the share of the item's words in
    matching windows of consistent stretches, and in windows with the item's own values of all others; ``exact`` tells
    that all values are the item's own. A text holds an item if it covers ``share`` of its words, or ``passage`` words in
    one stretch with the item's values, whatever the rest of that stretch holds.

    Up to RUN names, or number words, side by side are one placeholder, so "Mary Ann" may stand for "Alice"; punctuation
    parts them. Covered words are always words of the item's text.

    With ``any_case``, windows of the words in lower case, of all items, are joined as well: words that agree
    but for case have the values of the item, or of one of those it stands for.
    """
    spark = docs.sparkSession
    known = items.select(F.col("item_id").cast("bigint").alias("item_id"), text_of("text").alias("text"))
    templates = known.mapInArrow(_templates, "item_id bigint, text string, template binary")
    order = F.struct(F.col("item_id").isNull(), "item_id", "text")
    first = templates.groupBy("template").agg(F.min_by(F.struct("item_id", "text"), order).alias("i"), F.count(F.lit(1)).alias("n_items"))
    kinds = (
        "first bigint, second bigint, size int, item_id bigint, fold boolean, place int, begin int, end int, n_words int, "
        "slots array<string>, literals int"
    )
    # The number of an item among the representatives is its text; ids may repeat or be null.
    classes = stored(first.select("i.item_id", "i.text", "n_items", F.xxhash64("template").alias("item_key")))
    windows = stored(classes.select(F.col("item_key").alias("item_id"), "text").mapInArrow(_item_windows(size), kinds))
    if any_case:
        every = templates.select(F.xxhash64("template").alias("item_id"), "text").distinct()
        windows = stored(windows.union(every.mapInArrow(_item_windows(size, fold=True), kinds).distinct()))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    bitmap = spark.sparkContext.broadcast(_bitmap(windows))
    digest = F.unhex(F.md5(text_of(text_col).cast("binary")))
    texts = docs.select(digest.alias("hash"), text_of(text_col).alias("text"))
    kinds = "hash binary, first bigint, second bigint, size int, at bigint, values array<string>"
    found = texts.mapInArrow(_doc_windows(sizes, bitmap, any_case), kinds)
    on = ["first", "second", "size"]
    met = found.join(F.broadcast(windows), on) if fits_broadcast(windows) else _split_join(stored(found), windows, on)
    own = F.col("values") == F.col("slots")
    met = met.where(own | (F.col("literals") * 2 >= F.col("size"))).withColumn("own", own)
    # Copies of a text become one here.
    each = met.groupBy("hash", "item_id", "fold", (F.col("at") - F.col("place")).alias("shift"), "place").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("own").alias("own"),
        F.first("n_words").alias("n_words"),
        F.first(F.struct("begin", "end")).alias("span"),
        F.flatten(F.collect_set(F.arrays_zip(F.col("slots").alias("slot"), F.col("values").alias("value")))).alias("pairs"),
    )
    stretch = each.groupBy("hash", "item_id", "fold", "shift").agg(
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"),
        F.collect_list("span").alias("places"),
        F.collect_list(F.when(F.col("own"), F.col("span"))).alias("own_places"),
        F.min("own").alias("exact"),
        F.max("n").alias("n"),
        F.first("n_words").alias("n_words"),
    )
    names = F.filter("pairs", lambda p: p["slot"].startswith("#name"))
    by_place = F.size(F.array_distinct(F.col("pairs.slot"))) == F.size("pairs")
    by_value = F.size(F.array_distinct(names["value"])) == F.size(names)

    def words(places):
        return F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p["begin"], p["end"] - 1))))

    counted = F.when(by_place & by_value, F.col("places")).otherwise(F.col("own_places"))
    merged = (
        stretch.withColumns({"words": words(counted), "own_words": F.size(words(F.col("own_places")))})
        .groupBy("hash", "item_id")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"),
            F.max("own_words").alias("own_words"),
            F.min("exact").alias("exact"),
            F.max("n").alias("n"),
            F.first("n_words").alias("n_words"),
        )
        .withColumn("covered", F.col("words") / F.col("n_words"))
        .where((F.col("covered") >= share) | (F.col("own_words") >= passage))
    )
    named = merged.withColumnRenamed("item_id", "item_key").join(classes.drop("text"), "item_key")
    leak = F.struct("item_id", "n_items", "covered", "exact")
    return named.groupBy("hash").agg(F.sort_array(F.collect_list(leak)).alias("leaks"), F.max("n").alias("n"))


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """One row per document and leaked item: id, ``item_id``, ``n_items``, ``covered``, ``exact``, ``contaminated`` (true).

    Clean documents have no row. Null and empty texts hold no item; items without words match nothing.
    """
    found = stored(matches(docs, items, text_col, **options))
    digest = F.unhex(F.md5(text_of(text_col).cast("binary")))
    rows = docs.select(F.col(id_col).alias("_id"), digest.alias("hash"))
    joined = hot_join(rows, found, ["hash"], "n", ["leaks"])
    each = joined.select(F.col("_id").alias(id_col), F.explode("leaks").alias("leak"))
    return each.select(id_col, "leak.*", F.lit(True).alias("contaminated"))


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The input without the documents that hold an item; all columns."""
    found = stored(matches(docs, items, text_col, **options))
    names = [f"_{i}" for i in range(len(docs.columns))]
    text = text_of(names[docs.columns.index(text_col)])
    plain = docs.toDF(*names).withColumn("hash", F.unhex(F.md5(text.cast("binary"))))
    plain = plain.withColumn("key", F.hex("hash"))
    some, clean = only_possible(plain, found.select(F.hex("hash").alias("key")), "key")
    kept = hot_join(some, found, ["hash"], "n", ["leaks"]).where("leaks is null")
    return clean.select(*names).union(kept.select(*names)).toDF(*docs.columns)
