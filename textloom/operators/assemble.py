"""Ordered concatenation of rows into one text per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.arrays import let

SPAN = 1024


def in_order(order: list[str], value: Column | str) -> Column:
    """Values of a group as an array ordered by the given columns."""
    value = F.col(value) if isinstance(value, str) else value
    rows = F.sort_array(F.collect_list(F.struct(*[F.col(o) for o in order], value.alias("_value"))))
    return F.transform(rows, lambda r: r["_value"])


def concat_rows(
    df: DataFrame,
    key: str,
    order: list[str],
    piece: Column,
    out: str = "text",
    separators: tuple[str, ...] | None = None,
    within: tuple[str, ...] = (),
    span: int = SPAN,
) -> DataFrame:
    """One text per key: the pieces in the order of the ``order`` columns.

    ``separators`` has one entry per order column, put in where that column is the first to
    change. Rows are first joined per stretch of ``span`` consecutive numbers and then per key,
    so sorting and joining one large key is spread over many tasks and the last step only holds
    one row per stretch. The numbers are those of the first order column, or with
    ``within=("page",)`` those of the second one inside each page. A NULL piece adds nothing, but its
    key stays: a key without any piece has the empty text.
    """
    separators = separators or ("",) * len(order)
    counted = order[len(within)]
    stretch = [*within, F.floor(F.col(counted) / span).alias("_stretch")]

    def join(rows: Column) -> Column:
        def prefixed(row: Column, i: Column) -> Column:
            before = F.get(rows, i - 1)
            gap = F.when(i == 0, F.lit(""))
            for column, separator in zip(order, separators):
                gap = gap.when(before[column] != row[column], F.lit(separator))
            return F.concat(gap.otherwise(F.lit(separators[-1])), row["_piece"])

        return F.array_join(F.transform(rows, prefixed), "")

    rows = F.sort_array(F.collect_list(F.when(F.col("_piece").isNotNull(), F.struct(*order, "_piece"))))
    parts = (
        df.select(key, *order, piece.alias("_piece"))
        .groupBy(key, *stretch)
        .agg(rows.alias("_rows"))
        .select(key, *within, "_stretch", F.when(F.size("_rows") > 0, let(F.col("_rows"), join)).alias("_part"))
    )
    listed = F.filter(in_order([*within, "_stretch"], "_part"), lambda p: p.isNotNull())
    return parts.groupBy(key).agg(F.array_join(listed, separators[0]).alias(out))


def complete(texts: DataFrame, documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One text per row of ``documents(key, ...)``; those that no row was found for have the empty text."""
    found = texts.select(key, F.col(text).alias("_text"))
    return documents.drop(text).join(found, key, "left").withColumn(text, F.coalesce("_text", F.lit(""))).drop("_text")
