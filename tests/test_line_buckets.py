"""Lines of small documents are rebuilt per bucket of documents, in one shuffle; large documents spread as before."""

import pytest

from textloom.operators import blocks

BLOCK = "id_ string, ord int, id string, block_type string, text string, relationships array<struct<type:string,ids:array<string>>>"
ROWS = [
    ("a", 0, "p", "PAGE", None, [("CHILD", ["l1"])]),
    ("a", 2, "l2", "LINE", "x", [("CHILD", ["w3", "w1"]), ("OTHER", ["w9"]), None, ("CHILD", ["w2"]), ("CHILD", None)]),
    ("a", 1, "l1", "LINE", None, [("CHILD", ["w2", None, "w2"])]),
    ("a", 3, "l3", "LINE", "x", None), ("a", 4, "w1", "WORD", "one", None), ("a", 5, "w2", "WORD", "early", None),
    ("a", 6, "w3", "WORD", None, None), ("a", 9, "w2", "WORD", "two", None), ("a", 9, "w2", "WORD", "also", None),
    # One line three times: the later place counts, and there the later word of each list and number.
    ("b", 1, "l", "LINE", None, [("CHILD", ["w1", "w1", "w1"])]), ("b", 3, "l", "LINE", None, [("CHILD", ["w1", "w2"])]),
    ("b", 3, "l", "LINE", None, [("CHILD", ["w2", "w1", "w2"]), ("CHILD", ["w1"])]), ("b", 2, "k", "LINE", None, [("CHILD", [])]),
    ("b", 1, "w1", "WORD", "first", None), ("b", 2, "w2", "WORD", "second", None), ("b", 3, None, "WORD", "unnamed", None),
    ("c", 1, "w1", "WORD", "alone", None), ("d", 1, None, None, None, [("CHILD", ["w1"])]),
    (None, 1, "l10", "LINE", None, [("CHILD", ["w1"])]), (None, 1, "l1", "LINE", None, [("CHILD", ["w1", "w1"])]),
    (None, None, None, "LINE", None, [("CHILD", ["w1"])]), (None, 1, "w1", "WORD", "nobody's", None),
]
TEXTS = {
    "a": "two  two\n one\ntwo\n", "b": "\nsecond second second\nfirst", "c": "", "d": "", None: "nobody's\nnobody's nobody's\nnobody's",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("large", [blocks.LARGE_BLOCKS, 0, 8])
def test_odd_blocks_give_the_same_by_bucket_and_spread(spark, monkeypatch, large):
    monkeypatch.setattr(blocks, "LARGE_BLOCKS", large)
    df = spark.createDataFrame(ROWS, BLOCK).repartition(3)
    got = blocks.rebuild_lines(df, "id_").collect()
    assert {r["id_"]: r["text"] for r in got} == TEXTS and len(got) == len(TEXTS)


@pytest.mark.parametrize("large", [blocks.LARGE_BLOCKS, 0])
def test_unknown_words_by_bucket_and_spread(spark, monkeypatch, large):
    monkeypatch.setattr(blocks, "LARGE_BLOCKS", large)
    rows = [("a", 1, "l", "LINE", None, [("CHILD", ["w", "none", "w"])]), ("a", 1, "w", "WORD", "x", None), ("b", 1, "none", "WORD", "y", None)]
    df = spark.createDataFrame(rows, BLOCK)
    with pytest.raises(Exception, match="unknown word none"):
        blocks.rebuild_lines(df, "id_").collect()
    lenient = {r["id_"]: r["text"] for r in blocks.rebuild_lines(df, "id_", strict=False).collect()}
    assert lenient == {"a": "x  x", "b": ""}


def test_words_of_small_documents_move_once(spark):
    lines = spark.range(50).selectExpr(
        "id as doc_id", "1 as ord", "'l' as id", "'LINE' as block_type", "string(null) as text",
        "array(struct('CHILD' as type, array('w0', 'w1') as ids)) as relationships",
    )
    words = spark.range(50).selectExpr("id as doc_id", "explode(array(0, 1)) as ord").selectExpr(
        "doc_id", "ord", "concat('w', ord) as id", "'WORD' as block_type", "concat(doc_id, '-', ord) as text",
        f"cast(null as {blocks.RELATIONSHIPS}) as relationships",
    )
    df = lines.unionByName(words)
    sizes = spark.range(50).selectExpr("id as doc_id", "if(id = 7, 1000000, 3) as size")
    rebuilt = blocks.rebuild_lines(df)
    assert plan(rebuilt).count("Exchange hashpartitioning") == 2 and "Join" not in plan(rebuilt)
    told = blocks.rebuild_lines(df, sizes=sizes)
    assert "ShuffledHashJoin" in plan(told)
    for texts in (rebuilt, told, blocks.rebuild_lines(df, sizes=sizes.where("doc_id < 7"))):
        assert {r["doc_id"]: r["text"] for r in texts.collect()} == {i: f"{i}-0 {i}-1" for i in range(50)}
