"""The usual chains: text in, restored model answer out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from textloom.operators.inference import call_model
from textloom.operators.names import find_names
from textloom.operators.privacy import restore, tokenize
from textloom.operators.prompting import build_requests, fill_prompts, read_replies
from textloom.operators.web import clean_html, slice_bodies

Stage = Callable[[DataFrame], DataFrame]


def page_texts(pages: DataFrame) -> DataFrame:
    """Text of landed pages (html)."""
    return pages.transform(slice_bodies).transform(clean_html)


def protected(df: DataFrame, inner: Stage, gazetteer: DataFrame | None = None) -> DataFrame:
    """Run stages on text without personal data: tokens before, values back afterwards."""
    names = "names" if gazetteer is not None else None
    if gazetteer is not None:
        df = find_names(df, gazetteer, out=names)
    done = inner(tokenize(df, names=names))
    return restore(done).drop("token_map", *([names] if names else []))


def prompts(df: DataFrame, templates: DataFrame, name: str = "default_prompt") -> DataFrame:
    """Fill the template of each row, or the given one when rows have no ``prompt_name``."""
    named = df if "prompt_name" in df.columns else df.withColumn("prompt_name", F.lit(name))
    return fill_prompts(named, templates)


def answers(
    df: DataFrame,
    templates: DataFrame,
    make_client: Callable[[], Callable[[str], str]],
    props: str,
    input_path: str,
    output_path: str,
    template: str = "{prompt_text}",
    gazetteer: DataFrame | None = None,
) -> DataFrame:
    """The default run: tokenize, prompt, model, restore; ``text`` holds the answer."""

    def model(tokenized: DataFrame) -> DataFrame:
        asked = build_requests(prompts(tokenized, templates), props, input_path, template)
        return read_replies(call_model(asked, make_client), output_path).drop("body", "reply")

    return protected(df, model, gazetteer)


def by_input_type(df: DataFrame, stages: dict[str, Stage]) -> DataFrame:
    """Send the rows of each ``input_type`` through their own stage and put them together again.

    Rows of other types stay as they are. Every stage filters its own rows, so read ``df`` from a
    table partitioned by ``input_type``: each folder is then read once.
    """
    parts = [stage(df.where(F.col("input_type") == kind)) for kind, stage in stages.items()]
    rest = df.where(~F.coalesce(F.col("input_type").isin(*stages), F.lit(False)))
    for part in parts:
        rest = rest.unionByName(part, allowMissingColumns=True)
    return rest
