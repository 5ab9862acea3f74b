"""Replace personal data by tokens and restore it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textloom.functions.privacy import (
    PRIVATE_TYPES,
    TOKEN_PREFIX,
    find_private,
    group_matches,
    restore_tokens,
    restore_tokens_in_order,
    splice_tokens,
    token_map,
)

TOKEN_MAP_TYPE = "array<struct<token:string,value:string,type:string>>"
_BLOCK = 1024
_PAGE = 256
#: Bits of one row of a bitmap aggregate, and of the filter of ``tokenize_spans``: 8 MB, broadcast.
_BITMAP = 32_768
FILTER_BITS = 1 << 26


def detect_spans(df: DataFrame, text: str = "text", key: str = "doc_id", names: str | None = None) -> DataFrame:
    """``spans(key, begin, end, type, value)`` of the built-in detector, in code points.

    Only values and positions leave the text. The ends are running sums inside the row, gathered in
    pages, so there is no shuffle.
    """
    gaps, matches = find_private(F.col(text), F.col(names) if names else None)
    lengths = F.zip_with(
        F.slice("_gaps", F.lit(1), F.size("_matches")), "_matches", lambda g, m: F.length(g) + F.length(m["value"])
    )
    ends = F.aggregate(
        lengths,
        F.struct(F.array().cast("array<array<int>>").alias("pages"), F.array().cast("array<int>").alias("page"), F.lit(0).alias("end")),
        _add_end,
        lambda acc: F.concat(F.flatten(acc["pages"]), acc["page"]),
    )
    found = df.select(key, gaps.alias("_gaps"), matches.alias("_matches")).where(F.size("_matches") > 0)
    pieces = found.select(key, F.explode(F.arrays_zip(F.col("_matches").alias("m"), ends.alias("end"))).alias("_span"))
    end = F.col("_span.end")
    return pieces.select(
        key, (end - F.length("_span.m.value")).alias("begin"), end.alias("end"), F.col("_span.m.type").alias("type"), F.col("_span.m.value").alias("value")
    )


def _add_end(acc, length):
    end, full = acc["end"] + length, F.size(acc["page"]) >= _PAGE
    return F.struct(
        F.when(full, F.concat(acc["pages"], F.array(acc["page"]))).otherwise(acc["pages"]).alias("pages"),
        F.when(full, F.array(end)).otherwise(F.concat(acc["page"], F.array(end))).alias("page"),
        end.alias("end"),
    )


def keep_private(spans: DataFrame, types: tuple[str, ...] = PRIVATE_TYPES) -> DataFrame:
    return spans.where(F.col("type").isin(*types))


def number_tokens(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """``token_map(key, token, value, type)`` from spans, numbered by first appearance."""
    values = spans.groupBy(key, "value").agg(F.min("begin").alias("_at"), F.min_by("type", "begin").alias("type"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("_at", "value"))
    return values.select(key, F.concat(F.lit(TOKEN_PREFIX), number.cast("string")).alias("token"), "value", "type")


def tokenize(
    df: DataFrame,
    text: str = "text",
    names: str | None = None,
    types: tuple[str, ...] = PRIVATE_TYPES,
    out: str = "token_map",
) -> DataFrame:
    """Replace personal data in ``text`` by tokens and add the ordered token map of the row."""
    gaps, matches = find_private(F.col(text), F.col(names) if names else None)
    found = df.withColumns({"_gaps": gaps, "_matches": matches})
    return replace_matches(found, text, out, types)


def replace_matches(found: DataFrame, text: str, out: str, types: tuple[str, ...]) -> DataFrame:
    """Token map and new text from the columns ``_gaps`` and ``_matches`` of each row, which go; NULL means no match."""
    matches = F.coalesce("_matches", F.array().cast("array<struct<value:string,type:string>>"))
    spliced = splice_tokens(F.col("_gaps"), F.col("_matches"), F.col("_groups"), types)
    return (
        found.withColumn("_groups", group_matches(matches, types))
        .withColumns(
            {
                out: token_map(F.col("_groups")).cast(TOKEN_MAP_TYPE),
                text: F.when(F.size("_groups") > 0, spliced).otherwise(F.col(text)),
            }
        )
        .drop("_groups", "_gaps", "_matches")
    )


def _flag_listed(df: DataFrame, keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Add ``_listed``: whether the key of a row may be among ``keys``, by a bitmap of their hashes of ``bits`` bits."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    bucket, bit = F.floor(place / _BITMAP).alias("_bucket"), F.pmod(place, F.lit(_BITMAP)).alias("_bit")
    maps = keys.select(bucket, bit).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(F.col("_bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) != 0
    joined = df.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(maps), "_bucket", "left")
    return joined.withColumn("_listed", F.coalesce(held, F.lit(False))).drop("_bucket", "_bit", "_bitmap")


def _disjoint(spans):
    """Spans by begin, longest first, without those that start inside a kept one.

    Kept spans are gathered in pages, so that adding one copies a page and not all of them.
    """
    kind = "struct<begin:int,backwards:int,end:int,type:string>"

    def keep(acc, span):
        fits = span["begin"] >= acc["end"]
        full = F.size(acc["page"]) >= _PAGE
        return F.struct(
            F.when(fits & full, F.concat(acc["pages"], F.array(acc["page"]))).otherwise(acc["pages"]).alias("pages"),
            F.when(fits & full, F.array(span))
            .when(fits, F.concat(acc["page"], F.array(span)))
            .otherwise(acc["page"])
            .alias("page"),
            F.when(fits, span["end"]).otherwise(acc["end"]).alias("end"),
        )

    zero = F.struct(
        F.array().cast(f"array<array<{kind}>>").alias("pages"),
        F.array().cast(f"array<{kind}>").alias("page"),
        F.lit(0).alias("end"),
    )
    return F.aggregate(spans, zero, keep, lambda acc: F.concat(F.flatten(acc["pages"]), acc["page"]))


def tokenize_spans(
    df: DataFrame,
    spans: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    types: tuple[str, ...] = PRIVATE_TYPES,
    out: str = "token_map",
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """As ``tokenize`` for spans (key, begin, end, type) that another detector delivered.

    Spans may be unsorted or overlap; of overlapping ones the first and longest counts. Texts
    are cut from blocks, so the cost of a piece depends on its length and not its position.

    A bitmap of ``filter_bits`` bits over the keys of the spans splits off the texts that have none: they stay where they are,
    and only the others meet their spans. ``df`` is read twice for that. A bit that two keys share costs a move, not the result.
    """
    begin, end = F.col("begin").cast("int"), F.col("end").cast("int")
    # One span per start: a text has fewer of them than characters, however many were delivered.
    longest = (
        keep_private(spans, types)
        .groupBy(key, begin.alias("begin"))
        .agg(F.min(F.struct((-end).alias("backwards"), end.alias("end"), "type")).alias("_span"))
    )
    per_text = (
        longest.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("begin", "_span.backwards", "_span.end", "_span.type"))).alias("_spans"))
        .withColumn("_spans", _disjoint(F.col("_spans")))
    )

    def cut(blocks, first, last):
        block = F.floor(first / _BLOCK).cast("int")
        count = F.floor(last / _BLOCK).cast("int") - block + 1
        inner = F.array_join(F.slice(blocks, block + 1, count), "")
        return F.when(last <= first, F.lit("")).otherwise(
            F.substr(inner, first - block * _BLOCK + 1, last - first)
        )

    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    flagged = _flag_listed(df, longest, key, filter_bits)
    still = flagged.where(~F.col("_listed")).drop("_listed").withColumn(out, F.array().cast(TOKEN_MAP_TYPE))
    moved = flagged.where("_listed").drop("_listed")
    joined = moved.join(per_text, key, "left").withColumn("_blocks", F.when(F.col("_spans").isNotNull(), blocks))
    values = F.transform(
        "_spans",
        lambda s: F.struct(cut(F.col("_blocks"), s["begin"], s["end"]).alias("value"), s["type"].alias("type")),
    )
    ends = F.concat(F.array(F.lit(0)), F.transform("_spans", lambda s: s["end"]))
    begins = F.concat(F.transform("_spans", lambda s: s["begin"]), F.array(F.length(text)))
    gaps = F.zip_with(ends, begins, lambda e, b: cut(F.col("_blocks"), e, b))
    some = F.col("_spans").isNotNull()
    found = joined.withColumns({"_matches": F.when(some, values), "_gaps": F.when(some, gaps)})
    return replace_matches(found, text, out, types).drop("_spans", "_blocks").unionByName(still)


def explode_token_map(df: DataFrame, key: str = "doc_id", tokens: str = "token_map") -> DataFrame:
    """``token_map(key, token, value, type)`` rows, the form to store."""
    return df.select(key, F.explode(tokens).alias("_entry")).select(key, "_entry.token", "_entry.value", "_entry.type")


def attach_token_map(
    df: DataFrame, token_table: DataFrame, key: str = "doc_id", out: str = "token_map", strict: bool = False
) -> DataFrame:
    """Add the stored token map of each row; a row without one gets an error or fails."""
    number = F.substr(F.col("token"), F.lit(len(TOKEN_PREFIX) + 1)).cast("int")
    maps = token_table.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(number.alias("n"), "token", "value", "type"))).alias("_entries")
    )
    entries = F.transform("_entries", lambda e: F.struct(e["token"], e["value"], e["type"])).cast(TOKEN_MAP_TYPE)
    joined = df.join(maps, key, "left")
    missing = F.col("_entries").isNull()
    if strict:
        entries = F.when(missing, F.raise_error(F.lit("token map is missing")).cast(TOKEN_MAP_TYPE)).otherwise(entries)
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return joined.withColumns(
        {out: entries, "error": F.when(missing, "token map is missing").otherwise(error)}
    ).drop("_entries")


def restore(df: DataFrame, text: str = "text", tokens: str = "token_map", in_order: bool = False) -> DataFrame:
    """Put values back for tokens. A NULL text stays NULL and is reported in ``error``.

    ``in_order`` replaces token by token as plain text, where ``T1`` also changes ``T10``.
    """
    put_back = restore_tokens_in_order if in_order else restore_tokens
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return df.withColumn("error", F.when(F.col(text).isNull(), "no text to restore").otherwise(error)).withColumn(
        text, F.when(F.col(tokens).isNull(), F.col(text)).otherwise(put_back(F.col(text), F.col(tokens)))
    )


def flag_reversible(df: DataFrame, original: str, text: str = "text", tokens: str = "token_map") -> DataFrame:
    """Add ``reversible``: whether restoring gives the original, look-alike tokens included."""
    return df.withColumn("reversible", restore_tokens(F.col(text), F.col(tokens)) == F.col(original))
