import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import prompting, routing
from textloom.operators.inference import hold_chats
from textloom.plans import routed

PROPS = '{"messages":[{"role":"user","content":""}]}'
SCHEMA = (
    "id long, path string, payload string, anonymize boolean, chat string, clipboard boolean, questions array<string>, "
    "include_chat boolean, prompt_name string, note string"
)


def clients():
    """Nested, so that they travel to the workers whole."""

    def model():
        import json

        def call(body):
            content = json.loads(body)["messages"][0]["content"]
            if "busy" in content:
                raise RuntimeError("busy")
            return json.dumps({"content": [{"text": f"<{content}>"}]})

        return call

    def talker():
        import json

        def call(body):
            messages = json.loads(body)["messages"]
            if messages[-1]["content"] == "fail":
                raise RuntimeError("gone")
            return f"{len(messages)}:{messages[0]['content']}"

        return call

    return model, talker


model, talker = clients()


def run(spark, rows, **options):
    records = spark.createDataFrame(rows, SCHEMA).withColumn("input_type", routing.input_type(F.col("path")))
    templates = prompting.template_table(spark, {"p": "Sum: {input_text}"})
    return routed.run_stages(records, templates, model, talker, PROPS, "$.messages[0].content", "$.content[0].text", **options)


def talk(*said):
    messages = [{"role": "assistant" if i and i % 2 == 0 else "user", "content": m} for i, m in enumerate(said)]
    return json.dumps({"messages": messages}, ensure_ascii=False, separators=(",", ":"))


MAIL = "write a@b.com"
PAGE = "<html><body><p>Hi &amp; bye</p></body></html>"


def test_every_type_and_flag(spark):
    rows = [
        (1, "a.txt", MAIL, True, None, None, None, None, "p", "x"),
        (2, "a.txt", MAIL, False, "", False, None, None, "p", "x"),
        (3, "http://x/", PAGE, None, None, None, None, None, "p", "x"),
        (4, "quip://x", json.dumps({"html": PAGE}), False, "chat_only", False, ["q"], True, "p", "x"),
        (5, "a.mp3", json.dumps({"results": {"transcripts": [{"transcript": MAIL}]}}), True, "chat_first", False, ["q"], True, "p", "x"),
        (6, "a.pdf", "é", False, "sum_first", False, ["q", None, "r"], True, "p", "x"),
        (7, "a.pdf", "t", False, "chat_only", False, ["q"], False, "p", "x"),
        (8, "s3://b/k", None, True, None, True, None, None, "p", "x"),
        (9, "a.docx", "busy", False, None, False, None, None, "p", "x"),
        (10, "a.xlsx", "t", False, "chat_only", False, ["q", "fail", "r"], True, "p", "x"),
        (11, "a.png", MAIL, True, "chat_only", False, [], True, None, "x"),
    ]
    found = {r.id: (r.text, r.error) for r in run(spark, rows * 2).collect()}
    assert found == {
        1: ("<Sum: write a@b.com>", None),
        2: ("<Sum: write a@b.com>", None),
        3: ("<Sum: Hi & bye>", None),
        4: (talk("Hi & bye", "q", "2:Hi & bye"), None),
        5: ("<Sum: " + talk(MAIL, "q", "2:" + MAIL) + ">", None),
        6: (talk("<Sum: é>", "q", "2:<Sum: é>", "r", "4:<Sum: é>"), None),
        7: ("t", None),
        8: ("<Sum: >", None),
        9: (None, "busy"),
        10: (talk("t", "q", "2:t"), "gone"),
        11: (talk(MAIL), None),
    }


def test_the_model_sees_tokens_alone(spark):
    rows = [(1, "a.txt", MAIL, True, "chat_only", False, ["q"], True, "p", "x"), (2, "a.txt", MAIL, False, "chat_only", False, ["q"], True, "p", "x")]
    done = run(spark, rows).select("id", F.size("token_map").alias("n"), "stages").collect()
    assert {r.id: r.n for r in done} == {1: 1, 2: 0}
    assert {r.id: r.stages for r in done} == {1: ["read_text", "tokenize", "chat", "restore"], 2: ["read_text", "chat"]}


def test_one_scan_and_no_shuffle(spark, tmp_path):
    rows = [(i, p, "t", True, "sum_first", False, ["q"], True, "p", "x") for i, p in enumerate(["a.txt", "http://x", "quip://y", "a.mp3"])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "r"))
    records = spark.read.parquet(str(tmp_path / "r")).withColumn("input_type", routing.input_type(F.col("path")))
    templates = prompting.template_table(spark, {"p": "Sum: {input_text}"})
    done = routed.run_stages(records, templates, model, talker, PROPS, "$.messages[0].content", "$.content[0].text")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "SortMergeJoin" not in plan and plan.count("ArrowEvalPython") == 3


def test_compat_loses_model_and_chat(spark):
    rows = [(1, "a.txt", "t", True, "sum_first", False, ["q"], True, "p", "x"), (2, "a.txt", "t", False, "sum_first", False, ["q"], True, "p", "x")]
    found = {r.id: r.text for r in run(spark, rows, compat=True).collect()}
    assert found == {1: "Sum: t", 2: talk("<Sum: t>", "q", "2:<Sum: t>")}


def test_custom_records_have_insights(spark):
    records = spark.createDataFrame(
        [(1, "custom", "good good day", False), (2, "text_or_json", "t", False)], "id long, input_type string, payload string, anonymize boolean"
    ).selectExpr("*", "'' AS chat", "false AS clipboard", "array('q') AS questions", "true AS include_chat", "'p' AS prompt_name")
    templates = prompting.template_table(spark, {"p": "{input_text}"})
    done = routed.run_stages(
        records, templates, model, talker, PROPS, "$.messages[0].content", "$.content[0].text", lexicon={"good": 1}
    )
    found = {r.id: (r.text, r.insights and r.insights.sentiment) for r in done.collect()}
    assert found == {1: ("good good day", "POSITIVE"), 2: ("<t>", None)}


def test_unknown_type_ends_the_job(spark):
    rows = spark.createDataFrame([(1, "a.txt", "t", True, "", False, None, None, "p", "x")], SCHEMA).withColumn("input_type", F.lit("odd"))
    templates = prompting.template_table(spark, {"p": "{input_text}"})
    with pytest.raises(Exception, match="unsupported input type"):
        routed.run_stages(rows, templates, model, talker, PROPS, "$.messages[0].content", "$").collect()


def test_empty_table_and_chat_alone(spark):
    assert run(spark, []).count() == 0
    one = spark.createDataFrame([(None, ["q"], True)], "text string, questions array<string>, include_chat boolean")
    assert hold_chats(one, talker).first().text == talk(None, "q", "2:None")
