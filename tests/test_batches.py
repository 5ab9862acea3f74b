import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.operators import ledger, phrases
from textloom.operators.inference import hold_chats
from textloom.session import BATCH_BYTES
from textloom.sources import office

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
STAGES = {
    "word": lambda d: office.parse_paragraphs(d.selectExpr("text path", "binary(text) content")),
    "workbook": lambda d: office.parse_cells(d.selectExpr("text path", "binary(text) content")),
    "phrases": lambda d: phrases.find_phrases(d, d.selectExpr("text name", "'ORG' type")),
    "ledger": lambda d: ledger.call_model(d, lambda: str, "text"),
    "chats": lambda d: hold_chats(d.withColumns({"questions": F.array("text"), "include_chat": F.lit(True)}), lambda: str),
}


@pytest.mark.parametrize("name", STAGES)
def test_python_is_sent_small_batches(spark, name):
    """A batch of long texts is bounded by bytes; a limit that is smaller stays."""
    for before, after in (("64m", str(BATCH_BYTES)), ("1m", "1m")):
        session = spark.newSession()
        session.conf.set(SETTING, before)
        STAGES[name](session.createDataFrame([("a",)], "text string"))
        assert session.conf.get(SETTING) == after


def test_batches_hold_few_long_texts(spark):
    session = spark.newSession()
    seen = session.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([sum(map(len, texts))] * len(texts))

    phrases.find_phrases(seen, session.createDataFrame([("a", "ORG")], "name string, type string"))
    assert seen.select(size("text").alias("n")).agg(F.max("n")).first()[0] <= BATCH_BYTES + 100_000
