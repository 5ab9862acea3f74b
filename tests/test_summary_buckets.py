"""Summaries: words meet their weights once per bucket of texts, whatever the rows look like."""

import pytest

from textloom.operators import summarize

ROWS = [
    ("a", "One two. Two three! Four four four. Five", 1),
    ("a", "Six seven. Two", 2),
    ("b", None, 3),
    ("c", "", 4),
    ("d", "... !!!", 5),
    (None, "One two. Four", 6),
    (None, None, 7),
    ("e", "Ünï " + "x" * 100 + ". " + "y" * 100 + " two. one\nunknown", 8),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, body string, n int").repartition(3)


@pytest.mark.parametrize("hot_words", [100_000, 2])
def test_odd_rows_are_summarized(rows, hot_words):
    got = summarize.summarize(rows, 1, "body", "id", "short", hot_words=hot_words)
    assert got.columns == ["id", "body", "n", "short"]
    short = {r["n"]: r["short"] for r in got.collect()}
    # Rows of one key are judged together: their third sentence is the best, and one row has none.
    assert short == {1: "Four four four.", 2: "", 3: "", 4: "", 5: "", 6: "", 7: "", 8: "Ünï " + "x" * 100 + "."}


@pytest.mark.parametrize("hot_words", [100_000, 1])
def test_words_outside_the_statistics_do_not_count(spark, rows, hot_words):
    statistics = spark.createDataFrame([("one", 3), ("two", 2), ("y" * 100, 1)], "word string, docs long")
    got = summarize.summarize(rows, 2, "body", "id", "short", statistics, 50, hot_words)
    short = {r["n"]: r["short"] for r in got.collect()}
    assert short[1] == "One two. Two three!" and short[8] == "y" * 100 + " two. one"


def test_occurrences_are_no_rows(rows):
    summary = summarize.summarize(rows, 1, "body", "id", hot_words=2)
    assert "Generate" not in summary._jdf.queryExecution().executedPlan().toString()


def test_a_word_moves_once_per_bucket(spark):
    texts = spark.range(200).selectExpr("id as doc_id", "concat('Same words here. Same words, word', id % 5) as text")
    dealt = summarize._dealt(texts, 1, "text", "doc_id")
    words = summarize._bucket_words(dealt, "text")
    buckets = dealt.select("_bucket").distinct().count()
    assert words.where("word = 'same'").count() == buckets and words.agg({"docs": "sum"}).first()[0] == 200 * 4


def test_texts_are_sorted_before_they_are_cut(rows):
    plan = summarize.summarize(rows, 1, "body", "id", hot_words=2)._jdf.queryExecution().executedPlan().toString()
    texts = plan[plan.index("FlatMapCoGroupsInArrow") : plan.index("REPARTITION_BY_COL")]
    assert texts.count("Sort [_bucket") == 1
    assert texts.index(" AS _terms") < texts.index(" AS _sentences") < texts.index("Sort [_bucket")
