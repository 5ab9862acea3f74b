"""Prompt templates, request bodies and replies."""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, functions as F

from textloom.functions import jsonpath
from textloom.functions.arrays import let

# The template of unknown names.
FALLBACK = "Please provide a summary of the following text: {input_text}"


def segments(template: str, field: str = "input_text") -> list[str]:
    """Literal pieces around the placeholder; anything but ``{field}`` is refused here."""
    pieces = [""]
    for literal, name, spec, conversion in string.Formatter().parse(template):
        pieces[-1] += literal
        if name is None:
            continue
        if name != field or spec or conversion:
            raise ValueError(f"template placeholder {{{name}}} is not {{{field}}}")
        pieces.append("")
    return pieces


def segments_of(template: Column, field: str = "input_text") -> Column:
    """``segments`` of a template column; a template with anything but ``{field}`` fails."""
    place = "{" + field + "}"
    tokens = F.regexp_extract_all(template, F.lit(r"\{\{|\}\}|\{" + field + r"\}|[^{}]+|."), F.lit(0))
    alone = F.exists(tokens, lambda t: t.isin("{", "}"))
    plain = F.transform(
        tokens,
        lambda t: F.when(t == "{{", "{").when(t == "}}", "}").when(t == place, "\u0000").otherwise(t),
    )
    refused = F.raise_error(F.concat(F.lit(f"template placeholder is not {place}: "), template)).cast("array<string>")
    return F.when(alone, refused).otherwise(F.split(F.array_join(plain, ""), "\u0000"))


def fill(pieces: Column, text: Column) -> Column:
    """Put the text between the pieces, literally; a NULL text reads ``None``."""
    return F.call_function("array_join", pieces, F.coalesce(text, F.lit("None")))


def fill_template(template: str, text: Column, field: str = "input_text") -> Column:
    value = F.coalesce(text, F.lit("None"))
    parts: list[Column] = []
    for i, piece in enumerate(segments(template, field)):
        parts += ([value] if i else []) + ([F.lit(piece)] if piece else [])
    return F.concat(F.lit(""), *parts)


def json_string(text: Column) -> Column:
    """A JSON string literal with its quotes."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)


def request_body(prompt: Column, props: str, input_path: str = "prompt", template: str = "{prompt_text}") -> Column:
    """JSON request with the prompt set at every match of a JSONPath in the body given by ``props``.

    A path that the body does not have changes nothing.
    """
    body, slot = json.loads(props), "\u0000slot\u0000"
    for box, key in list(jsonpath.find(body, jsonpath.parse(input_path))):
        box[key] = slot
    text = json.dumps(body, ensure_ascii=False, separators=(",", ":"))
    pieces = text.split(json.dumps(slot))
    value = json_string(fill_template(template, prompt, "prompt_text"))
    parts = [F.lit(pieces[0])]
    for piece in pieces[1:]:
        parts += [value, F.lit(piece)]
    return F.concat(*parts)


def reply_text(reply: Column, output_path: str = "$") -> Column:
    """The first match of a JSONPath in a JSON reply; the whole reply where the path finds nothing.

    Paths that ``jsonpath.parse`` does not know are refused when the plan is built. A reply that is no JSON and a falsy value (empty,
    zero, false, null) give NULL. An object or array is given as JSON.
    """
    parsed = F.try_parse_json(reply)
    found = jsonpath.first_match(reply, output_path) if jsonpath.parse(output_path) else parsed

    def told(match: Column) -> Column:
        kind = F.schema_of_variant(match)
        value = F.try_variant_get(match, "$", "string")
        falsy = (
            (kind == "VOID")
            | (value == "")
            | ((kind == "BOOLEAN") & (value == "false"))
            | (kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)") & (F.try_variant_get(match, "$", "double") == 0))
            | (value.isin("[]", "{}") & (kind != "STRING"))
        )
        return F.when(match.isNull(), reply).when(falsy, F.lit(None).cast("string")).otherwise(value)

    return F.when(parsed.isNull(), F.lit(None).cast("string")).otherwise(let(found, told))
