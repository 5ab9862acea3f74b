"""Nothing leaks, vanishes, or depends on the size of a table."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from textloom.functions.prompts import reply_text
from textloom.functions.text import decode_entities
from textloom.operators import assemble, blocks, chat, glossary, insights, lookup, names, privacy, prompting

ADDRESSES = [
    "x@a.b.c.d.e.f.g.h.i.example.com",
    "q" * 5000 + "@ab.com",
    "a@" + "l" * 200 + ".org",
    "a@example." + "z" * 100,
    "first.last+tag%x@sub-1.example.co",
]


@pytest.mark.parametrize("address", ADDRESSES)
def test_no_part_of_an_address_stays(spark, address):
    texts = [f"{address}", f"to {address}.", f"({address}), {address}; {address}x1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in privacy.tokenize(df).orderBy("doc_id").collect()]
    assert got[:2] == ["T1", "to T1."] and "@" not in got[2] and got[2].startswith("(T1), T1; ")


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 200_000, "a." * 100_000, "a@" * 100_000, "a@" + "a." * 100_000 + "1", "1" * 200_000, "&#" + "0" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in privacy.tokenize(df).orderBy("doc_id").collect()] == texts


def test_dates_and_phones_are_whole_numbers(spark):
    texts = ["12024-01-023", "2024-01-02", "1555-123-4567", "555-123-45678", "+1 (555) 123-4567.", "x555-123-4567"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in privacy.tokenize(df).orderBy("doc_id").collect()]
    assert got == [texts[0], "T1", texts[2], texts[3], "T1.", "xT1"]


def test_spans_of_many_matches(spark):
    text = "é😀 " + ", ".join(f"2024-01-{i % 28 + 1:02d}" for i in range(700))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    spans = privacy.detect_spans(df).collect()
    assert len(spans) == 700 and all(text[s["begin"] : s["end"]] == s["value"] for s in spans)


def test_references_of_any_length(values):
    cases = {
        "a&#0000000065;b &#x0000041;c": "aAb Ac",
        "&#" + "0" * 300 + "65;": "A",
        "&#99999999999999999999;x&#xFFFFFFFFFFFFFFFFFFFF;": "x",
        "&#1114112;&#xD800;&#0;&#65 &#65": "A A",
        "&" + "n" * 300 + ";": "&" + "n" * 300 + ";",
    }
    assert values(list(cases), decode_entities) == list(cases.values())


LEXICON = [("good", 1), ("good", 2), ("bad", -2), ("fine", 1)]


def test_words_listed_twice_add_up(spark):
    chunks = spark.createDataFrame([(1, 0, "good bad"), (2, 0, "bad"), (3, 0, "fine fine bad")], "doc_id long, chunk_no int, chunk string")
    lexicon = spark.createDataFrame(LEXICON, "word string, weight int")
    found = []
    for limits in ({}, {"max_inline": 0}, {"max_inline": 0, "max_broadcast": 0}):
        found.append({r["doc_id"]: r["label"] for r in insights.label_chunks(chunks, lexicon, **limits).collect()})
    assert found[0] == {1: "MIXED", 2: "NEGATIVE", 3: "MIXED"} and found[0] == found[1] == found[2]


@pytest.mark.parametrize("limit", [None, 0])
def test_templates_listed_twice_count_once(spark, limit):
    templates = spark.createDataFrame([("a", ["1", ""]), ("a", ["2", ""]), (None, ["3", ""])], "prompt_name string, segments array<string>")
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, None, "y")], "doc_id long, prompt_name string, text string")
    filled = [r["text"] for r in prompting.fill_prompts(df, templates, max_broadcast=limit).orderBy("doc_id").collect()]
    assert filled[:2] == ["1x", "1x"] and filled[2].endswith("text: y")


def test_many_templates(spark, tmp_path):
    rows = [(f"t{i}", f"{i} {{{{x}}}} {{input_text}}{{{{{{input_text}}}}}}") for i in range(2_100)]
    for name, text in [*rows[:3], ("bad", "{other}")]:
        (tmp_path / f"{name}.txt").write_text(text)
    read = prompting.read_templates(spark, str(tmp_path))
    assert {r["prompt_name"]: r["segments"] for r in read.where("prompt_name <> 'bad'").collect()}["t1"] == ["1 {x} ", "{", "}"]
    with pytest.raises(Exception, match="template placeholder is not"):
        read.collect()
    table = prompting.template_table(spark, dict(rows))
    df = spark.createDataFrame([(1, "t2099", "v")], "doc_id long, prompt_name string, text string")
    assert prompting.fill_prompts(df, table).first()["text"] == "2099 {x} v{v}"


GAZETTEER = [("Acme", "ORG"), ("Acme Bank", "ORG"), ("b c", None), ("Zed", "NAME"), ("Zed", "ORG")]


def test_names_do_not_depend_on_sizes_or_keys(spark):
    gazetteer = spark.createDataFrame(GAZETTEER, "name string, type string")
    rows = [(1, "Acme Bank, and (Acme)"), (1, "b c"), (None, "Zed b c"), (2, None), (3, ""), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for limits in ({}, {"max_inline": 0}, {"max_inline": 0, "max_broadcast": 0}):
        got = names.find_names(df, gazetteer, **limits).collect()
        found.append(sorted((str(r["doc_id"]), str(r["text"]), [tuple(n) for n in r["names"]]) for r in got))
    assert found[0] == found[1] == found[2]
    by_text = {t: n for _, t, n in found[0]}
    assert by_text["Acme Bank, and (Acme)"] == [("Acme Bank", "ORG"), ("Acme", "ORG")]
    assert by_text["b c"] == [("b c", None)] and by_text["Zed b c"] == [("Zed", "NAME"), ("b c", None)]
    assert by_text["None"] == by_text[""] == []


def test_long_names_do_not_make_long_ngrams(spark):
    long_name = " ".join(f"w{i}" for i in range(50))
    gazetteer = spark.createDataFrame([(long_name, "ORG"), ("w1", "ORG")], "name string, type string")
    df = spark.createDataFrame([(1, f"x {long_name} y")], "doc_id long, text string")
    assert [n["name"] for n in names.find_names(df, gazetteer).first()["names"]] == [long_name, "w1"]


def turns_of(n, conv=1):
    return [(conv, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_turns_that_arrive_later_are_kept(spark, tmp_path):
    path = str(tmp_path / "turns")
    spark.createDataFrame(turns_of(2), SCHEMA).write.json(path)

    def again(_):
        import glob
        import json

        import pyarrow as pa

        rows = [json.loads(line) for f in glob.glob(f"{path}/*.json") for line in open(f)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    source = spark.range(1).coalesce(1).mapInArrow(again, SCHEMA)
    requests = chat.chat_requests(source, page=2)
    assert [r["turn"] for r in requests.collect()] == [1]
    spark.createDataFrame(turns_of(4)[2:], SCHEMA).write.mode("append").json(path)
    assert sorted(r["turn"] for r in requests.collect()) == [1, 3]


def test_long_conversations_are_written_by_many_tasks(spark):
    turns = spark.createDataFrame(turns_of(10_000) + turns_of(3, None), SCHEMA)
    requests = chat.chat_requests(turns, page=1_000, questions_only=False).select(
        "conv_id", "turn", "n_messages", F.md5("messages").alias("digest"), F.length("messages").alias("size")
    )
    found = {(r["conv_id"], r["turn"]): r for r in requests.where("turn in (0, 2, 999, 1000, 9999)").collect()}
    assert found[1, 9999]["n_messages"] == 10_000 and found[1, 1000]["n_messages"] == 1_001 and found[None, 2]["n_messages"] == 3
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = chat.chat_requests(turns, page=1_000).select("conv_id", F.spark_partition_id().alias("p")).where("conv_id = 1")
        assert parts.select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


BLOCK = "doc_id long, page int, ord int, id string, block_type string, text string, relationships array<struct<type:string,ids:array<string>>>"


def test_documents_without_lines_have_an_empty_text(spark):
    child = [("CHILD", ["w1"])]
    rows = [
        (1, 1, 0, "p", "PAGE", None, [("CHILD", ["l"])]),
        (2, 1, 0, "l1", "LINE", "a", child), (2, 1, 0, "l2", "LINE", None, [("CHILD", ["w2"])]),
        (2, 1, 1, "w1", "WORD", "a", None), (2, 1, 2, "w2", "WORD", "b", None), (3, 1, 0, "w1", "WORD", "alone", None),
        (4, 1, 0, "l", "LINE", "x", None), (None, 1, 0, "l", "LINE", "n", [("CHILD", None), ("VALUE", ["w9"])]),
    ]
    df = spark.createDataFrame(rows, BLOCK)
    assert {r["doc_id"]: r["text"] for r in blocks.rebuild_lines(df).collect()} == {1: "", 2: "a\nb", 3: "", 4: "", None: ""}
    lines = {r["doc_id"]: r["text"] for r in blocks.page_lines(df).collect()}
    assert lines == {1: "", 2: "a\n\n", 3: "", 4: "x\n", None: "n\n"} or lines[2] == "\na\n"


@pytest.mark.parametrize("hashed", [True, False])
def test_one_document_spreads_over_tasks(spark, hashed):
    """Words meet their places by document and id; later blocks of an id, several lists and equal words count as before."""
    lines = [
        (1, 1, n, f"l{n}", "LINE", None, [("CHILD", [f"w{n}-{k}" for k in range(40)]), ("OTHER", ["x"]), ("CHILD", [f"w{n}-0"] * 2)])
        for n in range(300)
    ]
    words = [(1, 1, 40 * n + k, f"w{n}-{k}", "WORD", f"t{k}", None) for n in range(300) for k in range(40)]
    again = [(1, 1, 20_000, "w7-0", "WORD", "later", None), (1, 1, 1_000, "l3", "LINE", None, [("CHILD", ["w3-1"])])]
    df = spark.createDataFrame(lines + words + again, BLOCK).repartition(4)
    rebuilt = blocks.rebuild_lines(df, hashed=hashed)
    text = {n: " ".join(f"t{k}" for k in range(40)) + "\nt0 t0" for n in range(300)}
    text[7] = text[7].replace("t0 ", "later ", 1).replace("t0 t0", "later later")
    first = [text[n] for n in range(300) if n != 3]
    assert rebuilt.first()["text"] == "\n".join([*first, "t1"])
    plan = rebuilt._jdf.queryExecution().executedPlan().toString()
    assert ("ShuffledHashJoin" in plan) == hashed
    assert len([p for p in plan.splitlines() if "Exchange hashpartitioning(coalesce" in p and "id#" in p]) >= 1


def test_documents_without_cells_or_paragraphs(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, None)], "doc_id long, row long, col long, value string")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    whole = assemble.complete(blocks.sheet_texts(cells), docs)
    assert {r["doc_id"]: r["text"] for r in whole.collect()} == {1: "a \n\n", 2: ""}
    paragraphs = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, "b")], "doc_id long, part int, ord long, text string")
    whole = assemble.complete(blocks.paragraph_texts(paragraphs), docs)
    assert {r["doc_id"]: r["text"] for r in whole.collect()} == {1: "\nb\n", 2: ""}


def test_the_last_of_repeated_keys_counts(spark):
    term = '{"name":"%s","shortDescription":"s","name":"%s"}'
    text = '{"a":[%s],"b":[%s],"a":[%s]}' % (term % ("1", "2"), term % ("3", "4"), term % ("5", "6"))
    df = spark.createDataFrame([(1, text), (2, '{"a":[],"a":3}'), (3, "{}"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["valid"] for r in glossary.flag_glossaries(df).collect()} == {1: True, 2: False, 3: True, 4: False}
    got = [tuple(r)[1:5] for r in glossary.glossary_terms(df).orderBy("category_no").collect()]
    assert got == [(0, "a", 0, "6"), (1, "b", 0, "4")]
    replies = spark.createDataFrame([('{"t":"x","t":"y"}',)], "reply string")
    assert prompting.read_replies(replies, "t").first()["text"] == "y"
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys", "false") == "false"


@pytest.mark.parametrize("path", ["$.a[?(@.b > 1)]", "$.a.`len`", "$['a", "a b", "$.a[1:2:0]"])
def test_other_paths_are_refused_before_a_job(path):
    with pytest.raises(ValueError, match="unsupported path|step 0"):
        reply_text(F.lit("{}"), path)


def test_merged_insights_keep_documents_without_chunks(spark):
    rows = [(1, 0, "POSITIVE"), (1, 1, "POSITIVE"), (2, None, None)]
    found = spark.createDataFrame(rows, "doc_id long, chunk_no int, label string").withColumns(
        {"entities": F.array(F.col("chunk_no")), "key_phrases": F.array(F.col("chunk_no"))}
    )
    got = {r["doc_id"]: tuple(r)[1:] for r in insights.merge_insights(found).collect()}
    assert got == {1: ("POSITIVE", [0, 1], [0, 1]), 2: (None, None, None)}


def test_a_cluster_names_its_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lookup.shared_dir(session)
