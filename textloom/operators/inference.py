"""Batch model calls through a callable that the caller provides."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from textloom.session import bound_batches


def call_model(df: DataFrame, make_client: Callable[[], Callable[[str], str]], body: str = "body") -> DataFrame:
    """Add ``reply`` and ``error``: one call per row, a failed call gives a NULL reply. A NULL request is not asked.

    ``make_client`` runs once per task and returns the function that maps a request to a reply.
    Only the request column travels to Python. A task that is run again calls the model again,
    so store the result before using it more than once.
    """

    bound_batches(df.sparkSession)

    @F.pandas_udf("reply string, error string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def one(request):
            try:
                return (None if request is None else client(request)), None
            except Exception as problem:  # noqa: BLE001 - a failed call must not end the job
                return None, str(problem)

        for batch in batches:
            yield pd.DataFrame([one(r) for r in batch], columns=["reply", "error"], dtype="object")

    before = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    return (
        df.withColumn("_call", call(F.col(body)))
        .withColumns({"reply": F.col("_call.reply"), "error": F.coalesce("_call.error", before)})
        .drop("_call")
    )


def hold_chats(
    df: DataFrame,
    make_client: Callable[[], Callable[[str], str]],
    text: str = "text",
    questions: str = "questions",
    include: str = "include_chat",
    on: str | None = None,
) -> DataFrame:
    """Ask the questions of each row about its text, one after the other, with all that was said before.

    The client maps ``{"messages":[...]}`` to an answer. Where ``include`` holds, the whole history becomes the text, else
    the text stays. A call that fails ends the session of its row: its ``error`` is set and the history holds what was
    answered until then. NULL questions are left out; a row without any has a history of its text alone. Rows where the
    boolean column ``on`` does not hold are not asked. The questions of a row wait for each other, rows do not.
    """

    bound_batches(df.sparkSession)

    @F.pandas_udf("history string, error string")
    def hold(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        client = make_client()

        def written(messages):
            return json.dumps({"messages": messages}, ensure_ascii=False, separators=(",", ":"))

        def one(content, asked, wanted):
            if not wanted:
                return None, None
            messages = [{"role": "user", "content": content}]
            for question in () if asked is None else asked:
                if question is None:
                    continue
                try:
                    answer = client(written([*messages, {"role": "user", "content": question}]))
                except Exception as problem:  # noqa: BLE001 - a failed call must not end the job
                    return written(messages), str(problem)
                messages += [{"role": "user", "content": question}, {"role": "assistant", "content": answer}]
            return written(messages), None

        for texts, lists, wanted in batches:
            rows = [one(t, q, w) for t, q, w in zip(texts, lists, wanted)]
            yield pd.DataFrame(rows, columns=["history", "error"], dtype="object")

    asks = F.coalesce(F.col(on), F.lit(False)) if on else F.lit(True)
    before = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    kept = asks & F.coalesce(F.col(include), F.lit(False))
    return (
        df.withColumn("_chat", hold(F.col(text), F.col(questions), asks))
        .withColumns(
            {
                text: F.when(kept, F.col("_chat.history")).otherwise(F.col(text)),
                "error": F.coalesce("_chat.error", before),
            }
        )
        .drop("_chat")
    )
