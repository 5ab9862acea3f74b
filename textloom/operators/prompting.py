"""Fill prompts, build requests, read replies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from textloom.functions.prompts import FALLBACK, fill, reply_text, request_body, segments, segments_of
from textloom.functions.variants import last_key_wins
from textloom.operators.lookup import lookup_join

# The default template.
DEFAULT_TEMPLATES = {
    "default_prompt": "Please provide 300 words minimum summary highlighting the most important topics from the "
    "following text: {input_text}. \n\nDo not provide an entry line such as: \"Here is a summary of key points "
    'from the text:", instead just start with the summary.'
}


def template_table(spark, templates: Mapping[str, str] = DEFAULT_TEMPLATES) -> DataFrame:
    """``templates(prompt_name, segments)``; templates are checked here, before any row runs."""
    rows = [(name, segments(text)) for name, text in templates.items()]
    return spark.createDataFrame(rows, "prompt_name string, segments array<string>")


def read_templates(spark, folder: str) -> DataFrame:
    """``templates(prompt_name, segments)`` from the ``.txt`` files of a folder, however many.

    A template with another placeholder ends the job that reads it.
    """
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("name"), "value"
    )
    return files.select(F.col("name").alias("prompt_name"), segments_of(F.col("value")).alias("segments"))


def fill_prompts(
    df: DataFrame,
    templates: DataFrame,
    name: str = "prompt_name",
    text: str = "text",
    max_broadcast: int | None = None,
) -> DataFrame:
    """Replace ``text`` by the named template around it; an unknown name uses the fallback.

    Templates are joined by name, broadcast where their size allows it. Of two with one name the first
    in order of their pieces counts.
    """
    fallback = F.array(*map(F.lit, segments(FALLBACK)))
    one = templates.groupBy(F.col("prompt_name").alias(name)).agg(F.min("segments").alias("_segments"))
    limit = {} if max_broadcast is None else {"max_rows": max_broadcast}
    joined = lookup_join(df, one, [name], **limit)
    return joined.withColumn(text, fill(F.coalesce("_segments", fallback), F.col(text))).select(*df.columns)


def build_requests(
    df: DataFrame,
    props: str,
    input_path: str = "prompt",
    template: str = "{prompt_text}",
    prompt: str = "text",
    out: str = "body",
) -> DataFrame:
    return df.withColumn(out, request_body(F.col(prompt), props, input_path, template))


def read_replies(df: DataFrame, output_path: str = "$", reply: str = "reply", out: str = "text") -> DataFrame:
    """Add the text of each reply; of a key that a reply repeats the last value counts."""
    with last_key_wins(df.sparkSession):
        return df.withColumn(out, reply_text(F.col(reply), output_path))
