"""Texts rebuilt from blocks, cells and paragraphs."""

from __future__ import annotations

from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.functions.arrays import let
from textloom.operators.assemble import concat_rows
from textloom.operators.lookup import materialize, rows_if_small

RELATIONSHIPS = "array<struct<type:string,ids:array<string>>>"
#: Blocks of a document above which its words are spread over all tasks; 64 bytes of text count as one more.
LARGE_BLOCKS = 10_000
#: Blocks that a Python worker holds at once, counted in the same way, and one document more.
BUCKET_BLOCKS = 1 << 17
_FIRST = -(1 << 63)


def _lists() -> Column:
    """The CHILD lists of a LINE, as ``array<struct<list, ids>>``."""
    each = F.transform(
        F.when(F.col("block_type") == "LINE", F.col("relationships")),
        lambda r, n: F.when(
            r["type"] == "CHILD", F.struct(n.alias("list"), F.coalesce(r["ids"], F.array().cast("array<string>")).alias("ids"))
        ),
    )
    return F.filter(each, lambda r: r.isNotNull())


def _asked(blocks: DataFrame, key: str) -> DataFrame:
    """A row per place of a line: ``ord``, ``line``, ``list``, ``no`` and the ``id`` of its word; an empty list has a place without.

    A block without lists has one row without ``list``, so its document stays.
    """
    listed = F.explode_outer(_lists()).alias("_list")
    lists = blocks.select(F.col(key).alias("_key"), F.col("ord").cast("long").alias("ord"), F.col("id").alias("line"), listed)
    return lists.select("_key", "ord", "line", F.col("_list.list").alias("list"), F.posexplode_outer("_list.ids").alias("no", "_id"))


def _line_text(rows: Column) -> Column:
    """Text of one line from its places (ord, list, no, word_ord, word): the latest block, the latest word of each place."""
    last = F.element_at(rows, -1)["ord"]

    def told(rows: Column) -> Column:
        def piece(row: Column, i: Column) -> Column:
            before = F.get(rows, i - 1)
            gap = F.when(i == 0, "").when(before["list"] != row["list"], "\n").otherwise(" ")
            return F.concat(gap, row["word"])

        return F.array_join(F.transform(rows, piece), "")

    def places(rows: Column) -> Column:
        def counts(row: Column, i: Column) -> Column:
            after = F.get(rows, i + 1)
            return after.isNull() | (after["list"] != row["list"]) | (after["no"] != row["no"])

        return let(F.filter(rows, counts), told)

    return let(F.filter(rows, lambda r: r["ord"] == last), places)


def _spread_lines(blocks: DataFrame, key: str, strict: bool, hashed: bool) -> DataFrame:
    """``rebuild_lines`` for large documents: words meet their places by (key, id), lines are put together by (key, line)."""
    is_word = F.coalesce(F.col("block_type") == "WORD", F.lit(False))
    words = blocks.where(is_word).select(
        key, "id", F.col("ord").cast("long").alias("word_ord"), F.coalesce("text", F.lit("")).alias("word"), F.lit(True).alias("known")
    )
    asked = _asked(blocks.where(~is_word), key)
    met = asked.join(words.hint("shuffle_hash") if hashed else words, F.col("_key").eqNullSafe(F.col(key)) & (F.col("_id") == F.col("id")), "full_outer")
    word = F.coalesce("word", F.lit(""))
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown word "), F.col("_id"))).cast("string")
        word = F.when(F.col("known").isNull() & F.col("_id").isNotNull(), unknown).otherwise(word)
    place = F.struct("ord", "list", F.coalesce("no", F.lit(0)).alias("no"), "word_ord", word.alias("word"))
    # A word that no line asks for keeps its document; it has no line and no place.
    mine = F.when(F.col("line").isNull() & F.col("_key").isNull(), F.col(key)).otherwise(F.col("_key"))
    lines = met.groupBy(mine.alias(key), "line").agg(
        F.sort_array(F.collect_list(F.when(F.col("list").isNotNull(), place))).alias("_rows")
    )
    last = F.get("_rows", F.size("_rows") - 1)["ord"]
    text = F.when(F.size("_rows") > 0, _line_text(F.col("_rows")))
    texts = lines.select(key, last.alias("ord"), "line", text.alias("_line"))
    return concat_rows(texts, key, ["ord", "line"], F.col("_line"), separators=("\n", "\n"))


def _numbered(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each value the number of it among the distinct ones, and these; null is a value."""
    encoded = values.dictionary_encode("encode")
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def _place_words(asked: pa.Array, texts: np.ndarray, words: pa.Table, of: np.ndarray, strict: bool) -> tuple[np.ndarray, pa.Table]:
    """The row of each asked id of a text among the words, -1 without, and the words; of two with one id the later comes first."""
    words = words.combine_chunks()
    if words["id"].null_count:
        named = np.flatnonzero(words["id"].is_valid().to_numpy())
        words, of = words.take(named), of[named]
    codes, ids = _numbered(words["id"].combine_chunks())
    own = pa.array(of * len(ids) + codes)
    if len(own.unique()) < len(own):
        later = pc.sort_indices(words, [("ord", "descending"), ("word", "descending")])
        words, own = words.take(later), own.take(later)
    wanted = pc.index_in(asked, value_set=ids, skip_nulls=True).fill_null(-1).to_numpy().astype(np.int64)
    hit = pc.index_in(pa.array(np.where(wanted < 0, -1, texts * len(ids) + wanted)), value_set=own).fill_null(-1).to_numpy()
    if strict:
        unknown = np.flatnonzero((hit < 0) & asked.is_valid().to_numpy(zero_copy_only=False))
        if len(unknown):
            raise ValueError(f"unknown word {asked[int(unknown[0])]}")
    return hit, words


def _bucket_texts(words: pa.Table, lines: pa.Table, key: str, strict: bool, schema: pa.Schema) -> pa.Table:
    """The texts of a bucket of documents, from their words and from the ``_lists`` of their other blocks."""
    of, keys = _numbered(pa.concat_arrays([words[key].combine_chunks(), lines[key].combine_chunks()]))
    text = of[words.num_rows :]
    codes, ids = _numbered(lines["id"].combine_chunks())
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    order, line = lines["ord"].to_numpy(), rank[codes]
    # Of two blocks of one line the later counts.
    same, which = np.unique(text * len(ids) + line, return_inverse=True)
    last = np.full(len(same), _FIRST)
    np.maximum.at(last, which, order)
    at = np.flatnonzero(order == last[which])
    lists, text, order, line = lines["_lists"].combine_chunks().take(at), text[at], order[at], line[at]
    n_lists = pc.list_value_length(lists).to_numpy()
    number, asked = lists.flatten().flatten()
    text, order, line, number = np.repeat(text, n_lists), np.repeat(order, n_lists), np.repeat(line, n_lists), number.to_numpy()
    n_asked = pc.list_value_length(asked).to_numpy()
    ends = np.append(0, np.cumsum(n_asked))
    asked = asked.flatten()
    hit, words = _place_words(asked, np.repeat(text, n_asked), words, of[: words.num_rows], strict)
    found = words["word"].combine_chunks().take(pa.array(hit, mask=hit < 0)).fill_null("")
    told = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), " ")
    placed = np.lexsort((number, line, order, text))
    told, text = told.take(placed), text[placed]
    repeats = text[1:] == text[:-1]
    for part in (order[placed], line[placed], number[placed]):
        repeats &= part[1:] == part[:-1]
    if repeats.any():
        # One line twice at one place: the later word of each place.
        own, value = words["ord"].to_numpy(), told.to_pylist()
        starts = np.flatnonzero(np.append(True, ~repeats))
        for start, stop in zip(starts, np.append(starts[1:], len(placed))):
            if stop - start > 1:
                places = [
                    [(own[h] if h >= 0 else _FIRST, found[int(p)].as_py()) for p, h in zip(range(ends[k], ends[k + 1]), hit[ends[k] : ends[k + 1]])]
                    for k in placed[start:stop]
                ]
                value[start] = " ".join(max(p)[1] for p in zip_longest(*places, fillvalue=(_FIRST, "")))
        told, text = pa.array([value[k] for k in starts], pa.string()), text[starts]
    each = np.append(0, np.cumsum(np.bincount(text, minlength=len(keys))))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(each, pa.int32()), told), "\n")
    return pa.table([keys, texts], schema=schema)


def rebuild_lines(
    blocks: DataFrame, key: str = "doc_id", strict: bool = True, hashed: bool = True, sizes: DataFrame | None = None
) -> DataFrame:
    """``texts(key, text)`` from OCR blocks: lines of words, words joined by blanks.

    ``blocks`` has key, ord, id, block_type, text, relationships(type, ids). Each CHILD list of a
    LINE is one line, in the order of ord and id. An unknown word fails, or is left out when not
    strict. Of two blocks with one id the later counts. A document without lines has the empty text.

    Blocks move once: those of a document meet in a bucket of about BUCKET_BLOCKS. The words of documents above LARGE_BLOCKS
    meet the places that ask for them by (key, id), and lines are put together by (key, line), so such a document spreads
    over all tasks; its lines then meet per stretch and per document. With ``hashed`` its words in a shuffle partition are
    held in memory, which their number of partitions has to allow; else both sides are sorted. The blocks are counted for
    this, unless ``sizes(key, size)`` tells about how many each document has; the texts do not depend on it.
    """
    blocks = blocks.withColumn("ord", F.coalesce(F.col("ord").cast("long"), F.lit(_FIRST)))
    is_word = F.coalesce(F.col("block_type") == "WORD", F.lit(False))
    word = F.when(is_word, F.coalesce("text", F.lit(""))).otherwise("")
    if sizes is None:
        size = F.lit(1) + F.octet_length(word) / 64
        sizes = materialize(blocks.groupBy(key).agg(F.sum(size).alias("size")))
    sizes = sizes.select(F.col(key).alias("_key"), "size")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = sizes.where(F.col("size") > LARGE_BLOCKS).select("_key")
    spread, few = None, rows_if_small(large)
    if few is None:
        mine = F.col(key).eqNullSafe(F.col("_key"))
        spread = _spread_lines(blocks.join(F.broadcast(large), mine, "left_semi"), key, strict, hashed)
        blocks = blocks.join(F.broadcast(large), mine, "left_anti")
    elif few:
        # A filter on the key, unlike a join, goes down to where the blocks come from.
        named = F.coalesce(F.col(key).isin([r[0] for r in few if r[0] is not None]), F.lit(any(r[0] is None for r in few)))
        spread = _spread_lines(blocks.where(named), key, strict, hashed)
        blocks = blocks.where(~named)
    buckets = max(int(total) // BUCKET_BLOCKS + 1, blocks.sparkSession.sparkContext.defaultParallelism * 2)
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")
    # An empty list instead of null: before each row Spark's Arrow writer passes over the nulls that stand before it.
    lists = F.coalesce(_lists(), F.array().cast("array<struct<list:int,ids:array<string>>>"))
    words = blocks.where(is_word).select(bucket, key, "ord", "id", word.alias("word"))
    lines = blocks.where(~is_word).select(bucket, key, "ord", "id", lists.alias("_lists"))
    out = blocks.select(key, F.lit("").cast("string").alias("text")).schema
    arrow = to_arrow_schema(out)
    texts = words.groupBy("_bucket").cogroup(lines.groupBy("_bucket")).applyInArrow(
        lambda words, lines: _bucket_texts(words, lines, key, strict, arrow), out
    )
    return texts if spread is None else texts.unionByName(spread)


def page_lines(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``texts(key, text)`` from paged OCR results: the own text of each LINE and a line end.

    A line without text is an empty line; a document without lines has the empty text.
    """
    own = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    return concat_rows(pages, key, ["page", "ord"], F.when(F.col("block_type") == "LINE", own), within=("page",))


def sheet_texts(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """``texts(key, text)`` from cells(key, row, col, value): values with a blank, rows with a line end.

    An empty row has at least one cell without a value. A sheet without cells has no row here;
    ``assemble.complete`` adds its document.
    """
    value = F.coalesce(F.concat("value", F.lit(" ")), F.lit(""))
    joined = concat_rows(cells, key, ["row", "col"], value, separators=("\n", ""))
    return joined.withColumn("text", F.concat("text", F.lit("\n")))


def paragraph_texts(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``texts(key, text)`` from paragraphs(key, part, ord, text): the body first, then tables.

    A paragraph without text is an empty line. ``assemble.complete`` adds documents without paragraphs.
    """
    own = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))
    return concat_rows(paragraphs, key, ["part", "ord"], own, within=("part",))
