"""Run the stage list of every record in one plan: one scan, a guarded projection per stage, one model call for all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.html import body_slice, html_to_text
from textloom.operators import routing
from textloom.operators.inference import call_model, hold_chats
from textloom.operators.insights import insights
from textloom.operators.privacy import restore, tokenize
from textloom.operators.prompting import build_requests, fill_prompts, read_replies
from textloom.sources.files import transcript_text

Stage = Callable[[DataFrame], DataFrame]


def landed_text(kind: Column, payload: Column) -> Column:
    """Text of what landed for a record: a page, a thread reply, the output of a speech job, or the text itself.

    A NULL payload and a page without a body give the empty text, as nothing was read.
    """
    body = body_slice(payload)
    thread = html_to_text(F.get_json_object(payload, "$.html"))
    read = (
        F.when(kind == "http", html_to_text(F.when(body != "", body)))
        .when(kind == "quip", html_to_text(thread))
        .when(kind.isin("youtube_url", "multimedia_file"), transcript_text(payload))
        .otherwise(payload)
    )
    return F.coalesce(read, F.lit(""))


def guarded(df: DataFrame, on: Column, stage: Stage, text: str = "text") -> DataFrame:
    """A row-local stage for the rows where ``on`` holds; the others keep their text and error.

    They pass through the same projection with a NULL text, so nothing is computed for them, and no
    row is scanned twice or moved.
    """
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    kept = df.withColumns({"_on": F.coalesce(on, F.lit(False)), "_text": F.col(text), "_error": error})
    done = stage(kept.withColumn(text, F.when(F.col("_on"), F.col(text))))
    after = F.col("error") if "error" in done.columns else F.lit(None).cast("string")
    return done.withColumns(
        {
            text: F.when(F.col("_on"), F.col(text)).otherwise(F.col("_text")),
            "error": F.when(F.col("_on"), after).otherwise(F.col("_error")),
        }
    ).drop("_on", "_text", "_error")


def run_stages(
    records: DataFrame,
    templates: DataFrame,
    make_client: Callable[[], Callable[[str], str]],
    make_chat_client: Callable[[], Callable[[str], str]],
    props: str,
    input_path: str,
    output_path: str,
    template: str = "{prompt_text}",
    lexicon: dict[str, int] | None = None,
    compat: bool = False,
) -> DataFrame:
    """Add ``stages``, ``text``, ``token_map`` and ``error``: every record taken through the stages of its type and flags.

    ``records`` has input_type, anonymize, chat, clipboard (what ``routing.stages`` looks at), payload (what landed),
    prompt_name, and for chats questions (array of texts) and include_chat. All lists are parts of one order:
    read, tokenize, chat, fill the prompt, ask the model, chat, restore. So the plan holds each stage once, and rows of
    different types meet in the same model call. ``make_client`` is for ``call_model``, ``make_chat_client`` for
    ``hold_chats``. Records of the type ``custom`` have ``insights`` if a ``lexicon`` is given.

    NULL flags count as: no tokens, no chat, no clipboard, history left out. An input type that has no list ends the job.
    Fetching, upload, speech, OCR, writing and the clipboard are outside: their results are the payload, or the text here.
    """
    anonymize, clipboard = (F.coalesce(F.col(c), F.lit(False)) for c in ("anonymize", "clipboard"))
    listed = routing.stages(F.col("input_type"), anonymize, F.col("chat"), clipboard, compat)
    df = records.withColumns({"stages": listed, "text": landed_text(F.col("input_type"), F.col("payload"))})

    def has(name: str) -> Column:
        return F.array_contains("stages", name)

    at_chat, at_prompt = F.array_position("stages", "chat"), F.array_position("stages", "fill_prompt")
    chat_first = has("chat") & ((at_prompt == 0) | (at_chat < at_prompt))

    def model(rows: DataFrame) -> DataFrame:
        asked = build_requests(rows, props, input_path, template)
        asked = asked.withColumn("body", F.when(F.col("_on"), F.col("body")))
        return read_replies(call_model(asked, make_client), output_path).drop("body", "reply")

    def chat(rows: DataFrame) -> DataFrame:
        return hold_chats(rows, make_chat_client, on="_on")

    df = guarded(df, has("tokenize"), tokenize)
    df = guarded(df, chat_first, chat)
    df = guarded(df, has("fill_prompt"), lambda rows: fill_prompts(rows, templates))
    df = guarded(df, has("call_model"), model)
    df = guarded(df, has("chat") & ~chat_first, chat)
    df = guarded(df, has("restore"), restore)
    if lexicon is not None:
        df = guarded(df, has("insights"), lambda rows: insights(rows, lexicon=lexicon))
        df = df.withColumn("insights", F.when(has("insights"), F.col("insights")))
    return df
