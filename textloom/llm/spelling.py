"""Spelling variants: words one edit apart, by pairs of trie nodes, grouped under their frequent forms.

Every prefix of a word is a node of a trie, every suffix a node of the trie of reversed words. A word gives integer pairs
(prefix node, suffix node): those of its places, and those in which one letter is skipped. Two words that share a skipping pair
differ in that letter; a word that has a place where another skips is that one without a letter. Both meet by one
grouping of the pairs, and no text of a word moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import stored, text_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters after A-Z became a-z.
RUN = "[a-zÀ-ÿ]+"
#: Rows of a batch of pairs.
ROWS = 100_000
#: Seeds of the node numbers that are tried.
SEEDS = 8
#: Kinds of pairs: a place between letters, a skipped letter, a skipped letter that is the first of a run of equal ones.
PLACE, SKIP, FIRST = 0, 1, 2

PAIRS = pa.schema([("p", pa.int64()), ("s", pa.int64()), ("kind", pa.int8()), ("n", pa.int64()), ("no", pa.int64())])
NODES = pa.schema([("trie", pa.int8()), ("node", pa.int64()), ("parent", pa.int64()), ("letter", pa.int32())])


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 31, shortest: int = 7, least: int = 2
) -> DataFrame:
    """``word``, ``n``: letter runs in lower case (A-Z alone), with planted typing errors, of ``shortest`` letters and ``least`` times.

    Of one in ``one_in`` runs, by the CRC-32 of id and run, a letter is left out. Null texts have no word; a null id counts as
    an empty one. Runs that are too short are left out before anything else is done, and counts are added up in each task.
    """
    text = F.translate(text_of(text_col), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= shortest)
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run")).cast("int")
    left_out = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % one_in == 0, left_out).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def trie_nodes(letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int, backwards: bool) -> np.ndarray:
    """Node numbers of the prefixes (or suffixes) of words, 0 to all letters, ``lengths + 1`` numbers a word.

    ``letters`` holds the words behind each other. The number of a node follows from that of its parent and its letter, so
    it is the same in every task. Words go down the trie together, level by level.
    """
    out = np.empty(int((lengths + 1).sum()), np.uint64)
    base = starts + np.arange(len(starts))
    order = np.argsort(-lengths, kind="stable")
    rising = lengths[order][::-1]
    node = np.full(len(starts), _mixed(np.array([seed + 1], np.uint64))[0], np.uint64)
    for level in range(int(lengths.max(initial=0)) + 1):
        if level:
            order = order[: len(order) - int(np.searchsorted(rising, level))]
            rising = rising[len(rising) - len(order) :]
            where = starts[order] + (lengths[order] - level if backwards else level - 1)
            node = _mixed(node[: len(order)] * np.uint64(0x9E3779B97F4A7C15) + letters[where].astype(np.uint64) + np.uint64(1))
        out[base[order] + (lengths[order] - level if backwards else level)] = node
    return out.view(np.int64)


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return letters, np.cumsum(lengths) - lengths, lengths


def _pieces(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch whose words have about ROWS letters."""
    if table.num_rows:
        turn = np.cumsum(pc.utf8_length(table.column("word")).to_numpy(zero_copy_only=False)) // ROWS
        edges = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), table.num_rows]
        yield from (table.slice(a, b - a) for a, b in zip(edges, edges[1:]))


def _sliced(columns: list, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(columns[0]), ROWS):
        parts = [pa.array(c[start : start + ROWS], f.type) for c, f in zip(columns, schema)]
        yield pa.RecordBatch.from_arrays(parts, schema=schema)


def _node_pairs(seed: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in (part for whole in tables for part in _pieces(whole)):
            letters, starts, lengths = _flat(table.column("word").to_pylist())
            prefix = trie_nodes(letters, starts, lengths, seed, False)
            suffix = trie_nodes(letters, starts, lengths, seed, True)
            n, no = table.column("n").to_numpy(), table.column("no").to_numpy()
            places = np.repeat(np.arange(len(lengths)), lengths + 1)
            skips = np.repeat(np.arange(len(lengths)), lengths)
            last, first = np.zeros(len(prefix), bool), np.zeros(len(prefix), bool)
            first[starts + np.arange(len(starts))] = True
            last[starts + np.arange(len(starts)) + lengths] = True
            leads = np.ones(len(letters), bool)
            leads[1:] = (letters[1:] != letters[:-1]) | (np.diff(skips) != 0)
            owner = np.concatenate((places, skips))
            kind = np.concatenate((np.full(len(places), PLACE, np.int8), np.where(leads, FIRST, SKIP).astype(np.int8)))
            columns = [np.concatenate((prefix, prefix[~last])), np.concatenate((suffix, suffix[~first])), kind, n[owner], no[owner]]
            yield from _sliced(columns, PAIRS)

    return run


def _dictionary(seed: int):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in (part for whole in tables for part in _pieces(whole)):
            letters, starts, lengths = _flat(table.column("word").to_pylist())
            for trie in (0, 1):
                nodes = trie_nodes(letters, starts, lengths, seed, bool(trie))
                ends = starts + np.arange(len(starts))
                inner = np.ones(len(nodes), bool)
                inner[ends + (lengths if trie else 0)] = False
                at = np.flatnonzero(inner)
                parent = nodes[at + 1] if trie else nodes[at - 1]
                root = np.flatnonzero(~inner)[:1]
                columns = [
                    np.full(len(at) + 1, trie, np.int8),
                    np.concatenate((nodes[at], nodes[root])),
                    np.concatenate((parent, np.zeros(1, np.int64))),
                    np.concatenate((letters, np.full(1, -1))),
                ]
                yield from _sliced(columns, NODES)

    return run


def numbers_are_sound(nodes: DataFrame) -> bool:
    """Whether every node number (``trie``, ``node``) has one parent and one letter, so that it stands for one string alone."""
    sides = [f(c).alias(f"{k}_{c}") for c in ("parent", "letter") for k, f in (("least", F.min), ("most", F.max))]
    mixed = F.col("least_parent") != F.col("most_parent")
    mixed = mixed | (F.col("least_letter") != F.col("most_letter"))
    return nodes.groupBy("trie", "node").agg(*sides).where(mixed).isEmpty()


def _nodes(words: DataFrame, seed: int) -> DataFrame:
    return words.select("word").mapInArrow(_dictionary(seed), "trie tinyint, node bigint, parent bigint, letter int")


def _seed(words: DataFrame) -> int:
    for seed in range(SEEDS):
        if numbers_are_sound(_nodes(words, seed)):
            return seed
    raise ValueError("node numbers meet under all seeds")


def near_counts(words: DataFrame) -> DataFrame:
    """``no``, ``n_near``, ``best(n, back)``: how many words are one edit away, and the most frequent one (``back`` is minus its number).

    ``words`` has word (distinct), n, and no, their numbers in the order of the words. A pair is shared by as many words
    as there are letters at most and by one word's place, whatever the number of words; each group is counted as a
    whole, without a row per pair of words. Words differ in one letter in one pair; a word lies in one pair beside the one with
    a letter more, as of equal letters beside each other the first is skipped alone.
    """
    pairs = words.select("word", "n", "no").mapInArrow(
        _node_pairs(_seed(words)), "p bigint, s bigint, kind tinyint, n bigint, no bigint"
    )
    mine = F.struct(F.col("n"), (-F.col("no")).alias("back"), (F.col("kind") == FIRST).alias("first"))
    place = F.struct(F.col("n"), (-F.col("no")).alias("back"))
    met = pairs.groupBy("p", "s").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") != PLACE, mine)), asc=False).alias("skips"),
        F.max(F.when(F.col("kind") == PLACE, place)).alias("place"),
    )
    met = met.where((F.size("skips") > 1) | ((F.size("skips") > 0) & F.col("place").isNotNull()))

    def plain(word: Column) -> Column:
        return F.when(word.isNotNull(), F.struct(word["n"].alias("n"), word["back"].alias("back")))

    def member(word: Column, i: Column) -> Column:
        other = plain(F.when(i == 0, F.get("skips", F.lit(1))).otherwise(F.get("skips", F.lit(0))))
        shorter = F.when(word["first"], F.col("place"))
        return F.struct(
            (-word["back"]).alias("no"),
            (F.size("skips") - 1 + shorter.isNotNull().cast("int")).alias("near"),
            F.greatest(other, shorter).alias("best"),
        )

    longer = F.filter("skips", lambda w: w["first"])
    own = F.struct(
        (-F.col("place.back")).alias("no"), F.size(longer).alias("near"), plain(F.get(longer, F.lit(0))).alias("best")
    )
    found = F.concat(F.transform("skips", member), F.filter(F.array(own), lambda w: w["no"].isNotNull()))
    each = met.select(F.explode(found).alias("f")).select("f.*").where("near > 0")
    return each.groupBy("no").agg(F.sum("near").cast("long").alias("n_near"), F.max("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``no``, ``root`` for the words that have a form: each round follows twice as many forms."""
    paths = stored(forms.select("no", F.col("form_no").alias("root")))
    while True:
        onward = paths.select(F.col("no").alias("root"), F.col("root").alias("next"))
        joined = paths.join(onward, "root", "left")
        moved = F.col("next").isNotNull().alias("moved")
        further = stored(joined.select("no", F.coalesce("next", "root").alias("root"), moved))
        paths = further.select("no", "root")
        if further.where("moved").isEmpty():
            return paths


def group_variants(counts: DataFrame, times: int = 10) -> DataFrame:
    """One row per word of ``counts(word, n)``: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. The form of a word is its most
    frequent near word, the first in code-point order among equals, if that is ``times`` as frequent at least; else null.
    ``root`` follows the forms to the last one and is the word itself if it has none. Words must be distinct and not null; without
    words there are no rows. Frequencies grow along the forms, so these never lead back and end after some steps.
    """
    words = stored(counts.select("word", "n").orderBy("word").withColumn("no", F.monotonically_increasing_id()))
    near = near_counts(words)
    judged = stored(
        words.select("no", "n")
        .join(near, "no")
        .select(
            "no",
            "n_near",
            F.when(F.col("best.n") >= times * F.col("n"), -F.col("best.back")).alias("form_no"),
            F.when(F.col("best.n") >= times * F.col("n"), F.col("best.n")).alias("form_n"),
        )
    )
    forms = judged.where(F.col("form_no").isNotNull())
    known = forms.join(_roots(forms), "no").select("no", "form_no", F.col("root").alias("root_no"))
    for side in ("form", "root"):
        known = known.join(words.select(F.col("no").alias(f"{side}_no"), F.col("word").alias(side)), f"{side}_no")
    result = words.join(judged.select("no", "n_near", "form_n"), "no", "left")
    result = result.join(known.select("no", "form", "root"), "no", "left")
    n_near = F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")
    return result.select("word", "form", F.coalesce("root", "word").alias("root"), "n", n_near, "form_n")


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = 10, **options
) -> DataFrame:
    """``group_variants`` of the ``word_counts`` of documents."""
    return group_variants(word_counts(docs, id_col, text_col, **options), times)
