"""Conversation histories as request texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textloom.operators.assemble import concat_rows

PAGE = 64


def _message() -> Column:
    options = {"ignoreNullFields": "false"}
    return F.to_json(F.struct("role", F.col("text").alias("content")), options)


def _messages(listed: Column) -> Column:
    return F.concat(F.lit('{"messages":['), listed, F.lit("]}"))


def _expand(pages: DataFrame, questions_only: bool) -> DataFrame:
    """One row per turn of a page: the text before the page and the messages up to the turn."""
    turns = pages.select("conv_id", "_before", "_n", "_turns", F.posexplode("_turns").alias("_i", "_turn"))
    if questions_only:
        turns = turns.where((F.col("_turn.role") == "user") & (F.col("_turn.turn") > 0))
    here = F.array_join(F.transform(F.slice("_turns", 1, F.col("_i") + 1), lambda t: t["_m"]), ",")
    return turns.select(
        "conv_id",
        F.col("_turn.turn").alias("turn"),
        (F.col("_n") + F.col("_i") + 1).alias("n_messages"),
        _messages(F.when(F.col("_n") > 0, F.concat("_before", F.lit(","), here)).otherwise(here)).alias("messages"),
    )


def chat_requests(turns: DataFrame, questions_only: bool = True, page: int = PAGE) -> DataFrame:
    """``requests(conv_id, turn, n_messages, messages)``: the history sent with each question.

    ``turns`` has conv_id, turn (from 0), role, text; turn 0 is the document text. A question is
    any later turn of the user. The turns of a conversation are gathered in pages of ``page``. Each
    page goes to all later pages of its conversation, where it becomes part of the text before them,
    so the prefixes of a long conversation are put together by as many tasks as it has pages.
    """
    # A key without nulls, so that the partitioning of the pages serves the joins too.
    conversation = F.struct("conv_id").alias("_conv")
    number = F.floor(F.col("turn") / page).alias("_page")
    numbered = turns.select(conversation, number, "turn", "role", _message().alias("_m"))
    listed = F.sort_array(F.collect_list(F.struct("turn", "role", "_m"))).alias("_turns")
    pages = numbered.groupBy("_conv", "_page").agg(listed)
    # Only conversations of several pages go on from here; their pages are named before any text is touched.
    ends = numbered.groupBy("_conv").agg(F.min("_page").alias("_first"), F.max("_page").alias("_last"))
    long = ends.where("_first < _last").select("_conv", "_last", F.explode(F.expr("sequence(_first, _last - 1)")).alias("_page"))
    text = F.array_join(F.transform("_turns", lambda t: t["_m"]), ",")
    later = (
        pages.join(long, ["_conv", "_page"])
        .select(
            "_conv",
            F.explode(F.sequence(F.col("_page") + 1, F.col("_last"))).alias("_target"),
            F.struct("_page", text.alias("text"), F.size("_turns").alias("n")).alias("_part"),
        )
        .groupBy("_conv", F.col("_target").alias("_page"))
        .agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    )
    before = later.select(
        "_conv",
        "_page",
        F.array_join(F.col("_parts.text"), ",").alias("_before"),
        F.aggregate("_parts", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("_n"),
    )
    placed = pages.join(before, ["_conv", "_page"], "left").select(
        "_conv.conv_id", "_turns", F.coalesce("_before", F.lit("")).alias("_before"), F.coalesce("_n", F.lit(0)).cast("long").alias("_n")
    )
    return _expand(placed, questions_only)


def chat_texts(turns: DataFrame, include: bool = True) -> DataFrame:
    """``texts(conv_id, text)`` for the next stage: the whole history, or the text as it was.

    Without ``include`` the text of turn 0 stays.
    """
    if not include:
        return turns.where("turn = 0").select("conv_id", "text")
    listed = concat_rows(turns, "conv_id", ["turn"], _message(), "_listed", (",",))
    return listed.select("conv_id", _messages(F.col("_listed")).alias("text"))
