import json

import pytest
from pyspark.sql import functions as F

from textloom.functions.insights import sentiment
from textloom.functions.prompts import reply_text, request_body, segments
from textloom.operators import blocks, chat, glossary, insights, prompting, routing, summarize
from textloom.operators.inference import call_model
from textloom.operators.lookup import fits_broadcast, lookup_join

# Routing

PATHS = [
    ("https://youtu.be/x", "youtube_url"), ("/a/youtube.pdf", "youtube_url"), ("https://a/b.pdf", "http"),
    ("httpfoo.txt", "http"), ("s3://b/a.pdf", "s3"), ("quip://abc", "quip"), ("a.mp3", "multimedia_file"),
    ("a.avi", "multimedia_file"), ("X.PDF", "text_or_json"), ("x.pdf", "pdf"), ("x.docx", "microsoft_word"),
    ("x.xlsm", "microsoft_excel"), ("x.xltm", "microsoft_excel"), ("x.jpeg", "image_file"), ("x.tiff", "image_file"),
    ("notes", "text_or_json"), ("", "text_or_json"),
]


def test_input_types(values):
    assert values([p for p, _ in PATHS], routing.input_type) == [t for _, t in PATHS]


@pytest.mark.parametrize(
    "flags, compat, expected",
    [
        (("pdf", True, None, False), False, "read_pdf tokenize fill_prompt call_model restore"),
        (("pdf", False, None, True), False, "read_pdf fill_prompt call_model clipboard"),
        (("http", True, "chat_only", False), False, "fetch_page html_to_text write_text tokenize chat restore"),
        (("s3", False, "chat_first", False), False, "read_object chat fill_prompt call_model"),
        (("s3", True, "sum_first", False), False, "read_object tokenize fill_prompt call_model chat restore"),
        (("s3", True, "sum_first", True), True, "read_object tokenize fill_prompt restore clipboard"),
        (("s3", False, "sum_first", True), True, "read_object fill_prompt clipboard"),
        (("s3", False, "sum_first", False), True, "read_object fill_prompt call_model chat"),
        (("custom", True, "sum_first", True), False, "read_pdf insights"),
        (("youtube_url", False, None, False), False, "read_video upload transcribe write_text fill_prompt call_model"),
        (("quip", False, None, False), False, "read_thread html_to_text fill_prompt call_model"),
    ],
)
def test_stage_lists(spark, flags, compat, expected):
    df = spark.createDataFrame([flags], "kind string, anonymize boolean, chat string, clipboard boolean")
    got = df.select(routing.stages(F.col("kind"), F.col("anonymize"), F.col("chat"), F.col("clipboard"), compat).alias("s"))
    assert got.first()["s"] == expected.split()


def test_unknown_input_type_fails(spark):
    df = spark.createDataFrame([("tape",)], "kind string")
    with pytest.raises(Exception, match="unsupported input type"):
        df.select(routing.stages(F.col("kind"), F.lit(True), F.lit(None).cast("string"), F.lit(False))).collect()


def test_anonymize_flag(values):
    assert values(["true", "1", "yes", None], routing.anonymize_flag) == [True, True, False, True]


def test_paths_are_split(values):
    paths = ["s3://bucket/a/b.txt", "s3://bucket/"]
    assert values(paths, routing.s3_bucket) == ["bucket", "bucket"]
    assert values(paths, routing.s3_key) == ["a/b.txt", ""]
    assert values(["s3://bucket"], lambda p: routing.s3_key(p, strict=False)) == [""]
    with pytest.raises(Exception, match="no object key"):
        values(["s3://bucket"], routing.s3_key)
    assert values(["quip://abc"], routing.thread_id) == ["abc"]
    with pytest.raises(Exception, match="not a quip"):
        values(["http://abc"], routing.thread_id)


# Prompts and replies


def test_templates(spark):
    assert segments("a {{x}} {input_text} b {input_text}") == ["a {x} ", " b ", ""]
    for bad in ("{other}", "{input_text!r}", "{input_text:>5}", "{"):
        with pytest.raises(ValueError):
            segments(bad)
    templates = prompting.template_table(spark, {"two": "<{input_text}|{{}}|{input_text}>"})
    rows = [(1, "two", "a"), (2, "nosuch", "{input_text}"), (3, "two", None), (4, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, prompt_name string, text string")
    fallback = "Please provide a summary of the following text: "
    for limit in (None, 0):
        filled = prompting.fill_prompts(df, templates, max_broadcast=limit)
        got = {r["doc_id"]: r["text"] for r in filled.collect()}
        assert got == {1: "<a|{}|a>", 2: fallback + "{input_text}", 3: "<None|{}|None>", 4: fallback + "b"}


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "one.txt").write_text("A {input_text}\nB")
    table = prompting.read_templates(spark, str(tmp_path))
    assert [tuple(r) for r in table.collect()] == [("one", ["A ", "\nB"])]


BODIES = [
    ('{"max_tokens":9,"messages":[{"role":"user","content":""}]}', "$.messages[0].content", "{prompt_text}"),
    ('{"prompt":"","stop":[]}', "$.prompt", "\n\nHuman:{prompt_text}\n\nAssistant:"),
    ('{"inputText":"","config":{"topP":1}}', "inputText", "\n{prompt_text}"),
    ('{"a":1}', "$.missing", "{prompt_text}"),
]


def test_request_bodies(values):
    texts = ['say "hi"\n\t\\ é😀 \x01', "", None]
    bodies = [values(texts, lambda t, b=body: request_body(t, *_order(b))) for body in BODIES]
    for text, *made in zip(texts, *bodies):
        chat_body, prompt_body, input_body, unchanged = map(json.loads, made)
        said = "None" if text is None else text
        assert chat_body == {"max_tokens": 9, "messages": [{"role": "user", "content": said}]}
        assert prompt_body == {"prompt": f"\n\nHuman:{said}\n\nAssistant:", "stop": []}
        assert input_body == {"inputText": "\n" + said, "config": {"topP": 1}}
        assert unchanged == {"a": 1}


def _order(body):
    props, path, template = body
    return props, path, template


REPLIES = [
    ('{"a":[{"b":"x"}]}', "x"),
    ('{"a":[{"b":{"c":1}}]}', '{"c":1}'),
    ('{"a":[{"b":5}]}', "5"),
    ('{"a":[{"b":"0"}]}', "0"),
    ('{"a":[{"b":"[]"}]}', "[]"),
    ('{"a":[{"b":true}]}', "true"),
    ('{"a":[]}', '{"a":[]}'),
    ('{"z":1}', '{"z":1}'),
    *[('{"a":[{"b":%s}]}' % falsy, None) for falsy in ('""', "0", "0.0", "false", "null", "[]", "{}")],
    ("not json", None),
    (None, None),
]


def test_replies(values):
    assert values([r for r, _ in REPLIES], lambda t: reply_text(t, "$.a[0].b")) == [e for _, e in REPLIES]
    assert values(['{"a":1}', "{}"], lambda t: reply_text(t, "$")) == ['{"a":1}', None]


def test_failed_calls_do_not_stop_the_job(spark):
    def make_client():
        def call(body):
            if "bad" in body:
                raise RuntimeError("no quota")
            return body.upper()

        return call

    df = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, body string")
    rows = {r["doc_id"]: (r["reply"], r["error"]) for r in call_model(df, make_client).collect()}
    assert rows == {1: ("GOOD", None), 2: (None, "no quota")}


# Insights

DOCS = "doc_id long, text string"


def test_insights_struct(spark):
    rows = [(1, "Good red fox, a@b.org. Bad cat"), (2, ""), (3, "  "), (4, None)]
    got = {r["doc_id"]: r["insights"] for r in insights.insights(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[2] is None and got[3] is None and got[4] is None
    assert got[1]["sentiment"] == "MIXED"
    assert [tuple(e) for e in got[1]["entities"]] == [("a@b.org", "EMAIL", 1.0)]
    assert [p["Text"] for p in got[1]["key_phrases"]] == ["good red fox", "bad cat", "a@b.org"]


def test_detectors_can_be_replaced(spark):
    df = spark.createDataFrame([(1, "a b")], DOCS)
    row = insights.insights(
        df,
        max_bytes=1,
        detect_sentiment=lambda c: F.when(c == "b", "P"),
        detect_entities=lambda c: F.lit(None),
        detect_key_phrases=lambda c: F.array(F.struct(c.alias("Text"), F.lit(0.5).alias("Score"))),
    ).first()["insights"]
    assert row["sentiment"] == "P" and row["entities"] == []
    assert [p["Text"] for p in row["key_phrases"]] == ["a", "b"]


def test_labels_by_every_join(spark):
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1), ("great", 2)], "word string, weight int")
    chunks = spark.createDataFrame(
        [(1, 0, "Good good bad"), (1, 1, "none"), (2, 0, "bad, great")], "doc_id long, chunk_no int, chunk string"
    )
    expected = {(r[0], r[1]): r[3] for r in chunks.withColumn("l", sentiment(F.col("chunk"), {"good": 1, "bad": -1, "great": 2})).collect()}
    for limits in ({}, {"max_inline": 0}, {"max_inline": 0, "max_broadcast": 0}):
        got = insights.label_chunks(chunks, lexicon, **limits).collect()
        assert {(r["doc_id"], r["chunk_no"]): r["label"] for r in got} == expected


def test_votes(spark):
    rows = [(1, "P"), (1, "N"), (1, "P"), (2, "P"), (2, "N"), (3, None), (3, None), (3, "P"), (4, None), (4, "P")]
    got = insights.vote(spark.createDataFrame(rows, "doc_id long, label string")).collect()
    assert {r["doc_id"]: r["sentiment"] for r in got} == {1: "P", 2: "N", 3: None, 4: "P"}


# Joins


def test_lookup_join_by_size(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    left = spark.createDataFrame([("a", i) for i in range(200)] + [("b", 0), ("c", 0)], "k string, i int")
    assert fits_broadcast(table) and not fits_broadcast(table, 1) and not fits_broadcast(table, max_bytes=5)
    for limit in (10, 1):
        rows = lookup_join(left, table, ["k"], max_rows=limit).collect()
        assert sorted((r["k"], r["v"] or 0) for r in rows) == [("a", 1)] * 200 + [("b", 2), ("c", 0)]


# Conversations

TURNS = "conv_id long, turn long, role string, text string"


def test_histories_over_page_borders(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(11)]
    turns += [(2, 0, "user", 'quote " and\nline'), (2, 1, "user", None)]
    df = spark.createDataFrame(turns[::-1], TURNS)
    for page in (1, 3, 64):
        got = {(r["conv_id"], r["turn"]): r for r in chat.chat_requests(df, page=page).collect()}
        assert sorted(got) == [(1, 2), (1, 4), (1, 6), (1, 8), (1, 10), (2, 1)]
        for (conv, turn), row in got.items():
            said = [{"role": r, "content": t} for c, n, r, t in turns if c == conv and n <= turn]
            assert json.loads(row["messages"]) == {"messages": said} and row["n_messages"] == turn + 1


def test_one_conversation_with_most_turns(spark):
    turns = [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(500)]
    turns += [(c, i, "user", "x") for c in range(100, 350) for i in range(2)]
    got = chat.chat_requests(spark.createDataFrame(turns, TURNS), questions_only=False, page=16).collect()
    assert len(got) == len(turns)
    for row in got:
        messages = json.loads(row["messages"])["messages"]
        assert len(messages) == row["n_messages"] == row["turn"] + 1
        if row["conv_id"] == 7:
            assert [m["content"] for m in messages] == [f"t{i}" for i in range(row["turn"] + 1)]


def test_chat_texts(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")], TURNS)
    assert json.loads(chat.chat_texts(df).first()["text"])["messages"] == [
        {"role": "user", "content": "a"},
        {"role": "assistant", "content": "b"},
    ]
    assert chat.chat_texts(df, include=False).first()["text"] == "a"


# Glossaries

TERM = '{"name":"n","shortDescription":"s"}'
GLOSSARIES = [
    ('{"A":[%s,%s],"B":[]}' % (TERM, TERM), True),
    ("{}", True),
    ('{"A":[{"name":{"x":1},"shortDescription":null}]}', True),
    ("[%s]" % TERM, False),
    ("[[%s]]" % TERM, False),
    ('{"A":%s}' % TERM, False),
    ('{"A":"x"}', False),
    ('{"A":[{"name":"n"}]}', False),
    ('{"A":["n"]}', False),
    ('{"A":[%s],"A":[]}' % TERM, False),
    ('{"A":[%s,]}' % TERM, False),
    ('{"A":[%s]' % TERM, False),
    ("null", False),
    ("text", False),
    ("", False),
    (None, False),
]


def test_glossary_structure(values):
    assert values([g for g, _ in GLOSSARIES], glossary.is_glossary) == [v for _, v in GLOSSARIES]


def test_glossary_terms_and_catalog(spark):
    text = '{"Z":[{"name":"1","shortDescription":"a"},{"name":"2","shortDescription":"b","x":1}],"A":[%s,%s]}' % (TERM, TERM)
    df = spark.createDataFrame([(1, text), (2, "broken"), (3, "{}")], DOCS)
    terms = glossary.glossary_terms(df)
    assert sorted(tuple(r) for r in terms.collect()) == [
        (1, 0, "Z", 0, "1", "a"), (1, 0, "Z", 1, "2", "b"), (1, 1, "A", 0, "n", "s"), (1, 1, "A", 1, "n", "s"),
    ]
    existing = spark.createDataFrame([("id-2", "Z"), ("id-1", "Z"), ("id-3", "other")], "id string, name string")
    catalog = glossary.get_or_create(terms, existing)
    rows = {r["name"]: r for r in catalog.collect()}
    assert sorted(rows) == ["A", "Z"]
    assert rows["Z"]["id"] == "id-1" and not rows["Z"]["created"] and rows["Z"]["status"] is None
    assert rows["A"]["created"] and rows["A"]["description"] == "Glossary for A" and rows["A"]["status"] == "ENABLED"
    placed = glossary.place_terms(terms, existing).collect()
    assert sorted((r["glossary_id"], r["name"]) for r in placed) == sorted(
        [("id-1", "1"), ("id-1", "2"), (rows["A"]["id"], "n"), (rows["A"]["id"], "n")]
    )


# Blocks

BLOCKS = (
    "doc_id long, page int, ord int, id string, block_type string, text string, "
    "relationships array<struct<type:string,ids:array<string>>>"
)


def ocr(spark, *rows):
    return spark.createDataFrame(list(rows), BLOCKS)


def test_lines_from_words(spark):
    df = ocr(
        spark,
        (1, 1, 0, "p", "PAGE", None, [("CHILD", ["l2", "l1"])]),
        (1, 1, 1, "l2", "LINE", "x", [("CHILD", ["w3", "w1"]), ("OTHER", ["w2"]), ("CHILD", ["w2"])]),
        (1, 1, 2, "l3", "LINE", "x", []),
        (1, 1, 3, "l4", "LINE", "x", None),
        (1, 1, 4, "l1", "LINE", "x", [("CHILD", ["w2"])]),
        (1, 1, 5, "l5", "LINE", "x", [("CHILD", [])]),
        (1, 1, 6, "w1", "WORD", "one", None),
        (1, 1, 7, "w2", "WORD", "early", None),
        (1, 1, 8, "w3", "WORD", "three", None),
        (1, 1, 9, "w2", "WORD", "two", None),
        (2, 1, 0, "l1", "LINE", "x", [("CHILD", ["w1"])]),
        (2, 1, 1, "w1", "WORD", "other", None),
    )
    got = {r["doc_id"]: r["text"] for r in blocks.rebuild_lines(df).collect()}
    assert got == {1: "three one\ntwo\ntwo\n", 2: "other"}


def test_unknown_words(spark):
    df = ocr(spark, (1, 1, 0, "l", "LINE", None, [("CHILD", ["w", "none"])]), (1, 1, 1, "w", "WORD", "a", None))
    with pytest.raises(Exception, match="unknown word none"):
        blocks.rebuild_lines(df).collect()


def test_page_lines(spark):
    rows = [(1, p, i, f"{p}-{i}", "LINE", f"{p}.{i}", None) for p in (1, 2) for i in range(2500)]
    df = ocr(spark, *rows[::-1], (1, 1, 9999, "w", "WORD", "no", None))
    assert blocks.page_lines(df).first()["text"] == "".join(f"{r[1]}.{r[2]}\n" for r in rows)


def test_sheets_and_paragraphs(spark):
    cells = spark.createDataFrame(
        [(1, 1, 1, "a"), (1, 1, 2, None), (1, 1, 10, "c"), (1, 2, 1, None), (1, 3000, 2, "z")],
        "doc_id long, row int, col int, value string",
    )
    assert blocks.sheet_texts(cells).first()["text"] == "a c \n\nz \n"
    paragraphs = spark.createDataFrame(
        [(1, 1, 0, "cell"), (1, 0, 2000, "last"), (1, 0, 1, ""), (1, 0, 0, "first")],
        "doc_id long, part int, ord int, text string",
    )
    assert blocks.paragraph_texts(paragraphs).first()["text"] == "first\n\nlast\ncell\n"


# Summaries


def summary_model(docs, k):
    import math
    import re
    from collections import Counter

    split = {d: [s.strip() for s in re.findall(r"[^.!?\n]+[.!?]*", t) if s.strip()] for d, t in docs.items()}
    terms = {d: [re.findall(r"\w+", s.lower()) for s in ss] for d, ss in split.items()}
    df = Counter(w for ts in terms.values() for w in {w for t in ts for w in t})
    idf = {w: round(math.log((len(docs) + 1) / (n + 1)) * 1e6) for w, n in df.items()}
    out = {}
    for d, ts in terms.items():
        tf = Counter(w for t in ts for w in t)
        scored = [(-sum(tf[w] * idf[w] for w in t) / len(t), i) for i, t in enumerate(ts) if t]
        out[d] = " ".join(split[d][i] for i in sorted(i for _, i in sorted(scored)[:k]))
    return out


def test_summaries_match_a_model(spark):
    import random

    rng = random.Random(2)
    pool = [f"w{int(rng.paretovariate(0.5)) % 60}" for _ in range(400)]
    docs = {
        d: "".join(" ".join(rng.choices(pool, k=rng.randrange(1, 9))) + rng.choice([". ", "! ", "\n"]) for _ in range(rng.randrange(12)))
        for d in range(60)
    }
    docs[60] = "... !!!"
    df = spark.createDataFrame(list(docs.items()), DOCS)
    for hot_words in (100_000, 3):
        got = {r["doc_id"]: r["summary"] for r in summarize.summarize(df, 2, hot_words=hot_words).collect()}
        assert got == summary_model(docs, 2)
