"""Classify paths and list the stages a record needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Suffixes per input type, looked at in this order.
SUFFIXES = (
    ("multimedia_file", (".mp3", ".mp4", ".m4a", ".wav", ".flac", ".mov", ".avi")),
    ("pdf", (".pdf",)),
    ("microsoft_word", (".docx",)),
    ("microsoft_excel", (".xlsx", ".xlsm", ".xltx", ".xltm")),
    ("image_file", (".jpg", ".jpeg", ".png", ".tiff")),
)

READ_STAGES = {
    "youtube_url": ["read_video", "upload", "transcribe", "write_text"],
    "multimedia_file": ["upload", "transcribe", "write_text"],
    "image_file": ["read_text", "ocr"],
    "pdf": ["read_pdf"],
    "http": ["fetch_page", "html_to_text", "write_text"],
    "text_or_json": ["read_text"],
    "s3": ["read_object"],
    "quip": ["read_thread", "html_to_text"],
    "microsoft_word": ["read_word"],
    "microsoft_excel": ["read_sheet"],
}


def input_type(path: Column) -> Column:
    """Input type by the first rule that matches; case counts."""
    kind = (
        F.when(path.contains("youtube") | path.contains("youtu.be"), "youtube_url")
        .when(path.startswith("http"), "http")
        .when(path.startswith("s3://"), "s3")
        .when(path.startswith("quip://"), "quip")
    )
    for name, suffixes in SUFFIXES:
        ends = path.endswith(suffixes[0])
        for suffix in suffixes[1:]:
            ends = ends | path.endswith(suffix)
        kind = kind.when(ends, name)
    return kind.otherwise("text_or_json")


def _names(stages: list[str]) -> Column:
    return F.array(*map(F.lit, stages)) if stages else F.array().cast("array<string>")


def stages(kind: Column, anonymize: Column, chat: Column, clipboard: Column, compat: bool = False) -> Column:
    """``array<string>`` of stage names for an input type and the flags of a run.

    With ``compat`` a summary followed by a chat loses model and chat as soon as another stage
    comes after them.
    """
    read = F.when(kind == "custom", _names(["read_pdf", "insights"]))
    for name, names in READ_STAGES.items():
        read = read.when(kind == name, _names(names))
    read = read.otherwise(F.raise_error(F.concat(F.lit("unsupported input type: "), kind)).cast("array<string>"))

    nothing = _names([])
    both = _names(["fill_prompt", "call_model", "chat"])
    if compat:
        both = F.when(anonymize | clipboard, _names(["fill_prompt"])).otherwise(both)
    middle = (
        F.when(F.coalesce(chat, F.lit("")) == "", _names(["fill_prompt", "call_model"]))
        .when(chat == "sum_first", both)
        .when(chat == "chat_only", _names(["chat"]))
        .otherwise(_names(["chat", "fill_prompt", "call_model"]))
    )
    tail = F.concat(
        F.when(anonymize, _names(["tokenize"])).otherwise(nothing),
        middle,
        F.when(anonymize, _names(["restore"])).otherwise(nothing),
        F.when(clipboard, _names(["clipboard"])).otherwise(nothing),
    )
    return F.when(kind == "custom", read).otherwise(F.concat(read, tail))


def anonymize_flag(value: Column) -> Column:
    """True for ``true`` and ``1`` and when unset; any other text turns it off."""
    return F.coalesce(value.isin("true", "1"), F.lit(True))


def requests(df: DataFrame, path: str = "path", prompt_name: str = "default_prompt") -> DataFrame:
    """Add the fields of a fresh request to rows that have a path."""
    return df.withColumns(
        {
            "input_type": input_type(F.col(path)),
            "prompt_name": F.lit(prompt_name),
            "text": F.lit(""),
            "error": F.lit(None).cast("string"),
        }
    )


def s3_bucket(path: Column) -> Column:
    return F.regexp_extract(path, "^[^/]*/[^/]*/([^/]*)", 1)


def s3_key(path: Column, strict: bool = True) -> Column:
    """Object key of ``s3://bucket/key``; without one strict fails and the other form is empty."""
    key = F.regexp_extract(path, "(?s)^[^/]*/[^/]*/[^/]*/(.*)$", 1)
    if not strict:
        return key
    whole = path.rlike("^[^/]*/[^/]*/[^/]*/")
    return F.when(whole, key).otherwise(F.raise_error(F.concat(F.lit("no object key in "), path)).cast("string"))


def thread_id(path: Column) -> Column:
    """Document id of ``quip://<id>``; any other prefix fails."""
    return F.when(path.startswith("quip://"), F.substr(path, F.lit(8))).otherwise(
        F.raise_error(F.concat(F.lit("not a quip:// path: "), path)).cast("string")
    )
