import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import jsonpath
from textloom.functions.prompts import reply_text, request_body

BODY = {
    "z": {"text": "z1", "more": {"text": "z2"}}, "a": {"text": "a1"}, "odd name": {"x-y": 3, "it's": 4},
    "list": [{"text": "l0"}, {"n": 1}, {"text": "l2", "list": [{"text": "deep"}]}], "numbers": [0, 1, 2, 3, 4, 5], "one": {"text": "o"},
    "empty": [], "none": None, "no": False, "blank": "", "zero": 0,
}

#: Paths with what a plain reading of the body gives, in order.
FOUND = [
    ("$.z.text", ["z1"]),
    ("z.more.text", ["z2"]),
    ("$['odd name']['x-y']", [3]),
    ('$["odd name"]["it\'s"]', [4]),
    ("$.'odd name'.x-y", [3]),
    ("$.list[0].text", ["l0"]),
    ("$.list[-1].text", ["l2"]),
    ("$.list[-4].text", []),
    ("$.list[*].text", ["l0", "l2"]),
    ("$.list[1:].text", ["l2"]),
    ("$.numbers[1:4]", [1, 2, 3]),
    ("$.numbers[-2:]", [4, 5]),
    ("$.numbers[:-4]", [0, 1]),
    ("$.numbers[::2]", [0, 2, 4]),
    ("$.numbers[::-2]", [5, 3, 1]),
    ("$.numbers[4:1:-1]", [4, 3, 2]),
    ("$.numbers[7:9]", []),
    ("$.one[*].text", ["o"]),
    ("$.one[0].text", []),
    ("$.empty[*]", []),
    ("$.missing[*].text", []),
    ("$.z['more','text']", [{"text": "z2"}, "z1"]),
    ("$..text", ["z1", "z2", "a1", "l0", "l2", "deep", "o"]),
    ("$.list..text", ["l0", "l2", "deep"]),
    ("$.z.*", ["z1", {"text": "z2"}]),
    ("$.*.text", ["z1", "a1", "o"]),
    ("$.list[*].*", ["l0", 1, "l2", [{"text": "deep"}]]),
    ("$..list[0].text", ["l0", "deep"]),
    ("$..[1]", [{"n": 1}, 1]),
]


@pytest.mark.parametrize("path, want", FOUND)
def test_matches(path, want):
    assert [box[key] for box, key in jsonpath.find(BODY, jsonpath.parse(path))] == want


def test_first_matches_in_spark(spark):
    df = spark.createDataFrame([(json.dumps(BODY),)], "r string")
    columns = [F.to_json(jsonpath.first_match(F.col("r"), path)).alias(f"c{i}") for i, (path, _) in enumerate(FOUND)]
    row = df.select(*columns).first()
    got = [None if row[f"c{i}"] is None else json.loads(row[f"c{i}"]) for i in range(len(FOUND))]
    assert got == [want[0] if want else None for _, want in FOUND]


@pytest.mark.parametrize("path", ["$.a[?(@.b)]", "$.a[", "$a.b c", "$.a[0:1:0]", "$.a.`len`", "$[]", "$.a..", "a b", "$..", "$.", "$text"])
def test_refused(path):
    with pytest.raises(ValueError):
        jsonpath.parse(path)


@pytest.mark.parametrize("path", ["$..text", "$.list[*].text", "$.*.text"])
def test_odd_replies(spark, path):
    deep = "[" * 300 + '{"text":"x"}' + "]" * 300
    rows = [(0, None), (1, "no json"), (2, "{}"), (3, "[]"), (4, '"text"'), (5, "7"), (6, '{"list":[{"text":""}],"b":{"text":""}}'), (7, deep)]
    got = dict(spark.createDataFrame(rows, "i int, r string").select("i", reply_text(F.col("r"), path)).collect())
    whole = {0: None, 1: None, 2: "{}", 3: "[]", 4: '"text"', 5: "7", 6: None}
    assert {i: t for i, t in got.items() if i < 7} == whole
    assert got[7] == ("x" if path == "$..text" else deep)


def test_repeated_keys_and_objects(spark):
    rows = [('{"a":{"t":1},"a":{"t":[1,2]}}',)]
    got = spark.createDataFrame(rows, "r string").select(reply_text(F.col("r"), "$..t").alias("t")).first()["t"]
    assert json.loads(got or "null") in ([1, 2], None)


def test_prompts_at_every_match(spark):
    props = '{"messages":[{"role":"user","content":""},{"role":"x"},{"content":"old"}],"prompt":"p","k":{"content":1}}'
    df = spark.createDataFrame([('say "hi"\n',)], "t string")

    def body(path):
        return json.loads(df.select(request_body(F.col("t"), props, path, "<{prompt_text}>")).first()[0])

    filled, plain = '<say "hi"\n>', json.loads(props)
    every = body("$.messages[*].content")
    assert [m.get("content") for m in every["messages"]] == [filled, None, filled] and every["k"] == {"content": 1}
    assert body("$..content")["k"] == {"content": filled} and body("$..content")["messages"] == every["messages"]
    assert body("$['prompt']")["prompt"] == filled and body("$.messages[-1].content")["messages"][2] == {"content": filled}
    assert body("$.absent[*].content") == plain and body("$") == plain
