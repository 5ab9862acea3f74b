from textloom.operators import insights


def test_words_of_chunks_are_counted_once(spark, monkeypatch):
    """The join with a large lexicon reads its left side twice, so the counts are stored before it."""
    stored, kept = [], insights.materialize
    monkeypatch.setattr(insights, "materialize", lambda df: stored.append(df.columns) or kept(df))
    chunks = spark.createDataFrame([(1, 0, "Good good bad"), (2, 0, "none")], "doc_id long, chunk_no int, chunk string")
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1)], "word string, weight int")
    joined = insights.label_chunks(chunks, lexicon, max_inline=0, max_broadcast=0)
    assert stored == [["doc_id", "chunk_no", "word", "_n"]]
    assert sorted(joined.collect()) == sorted(insights.label_chunks(chunks, lexicon).collect())
