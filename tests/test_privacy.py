import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import names, privacy

TEXT = "Mail a.b@example.com or +1 (499) 555-6503, again a.b@example.com on 2024-01-31."
SPANS = "doc_id long, begin int, end int, type string"


def texts(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def test_detect_number_and_splice(spark):
    df = texts(spark, (1, TEXT), (2, "nothing here"), (3, "😀 x@y.org"), (4, ""))
    spans = sorted(tuple(r) for r in privacy.detect_spans(df).collect())
    for doc, begin, end, _, value in spans:
        assert {1: TEXT, 3: "😀 x@y.org"}[doc][begin:end] == value
    assert [s[3] for s in spans] == ["EMAIL", "PHONE", "EMAIL", "DATE", "EMAIL"]
    rows = {r["doc_id"]: r for r in privacy.tokenize(df).collect()}
    assert rows[1]["text"] == "Mail T1 or T2, again T1 on T3."
    assert [(e["token"], e["value"], e["type"]) for e in rows[1]["token_map"]] == [
        ("T1", "a.b@example.com", "EMAIL"),
        ("T2", "+1 (499) 555-6503", "PHONE"),
        ("T3", "2024-01-31", "DATE"),
    ]
    assert rows[2]["token_map"] == [] and rows[4]["text"] == ""


def test_types_can_be_limited(spark):
    row = privacy.tokenize(texts(spark, (1, TEXT)), types=("PHONE",)).first()
    assert row["text"] == TEXT.replace("+1 (499) 555-6503", "T1")


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{i % 20_000}@b.org" for i in range(30_000))
    tokenized = privacy.tokenize(texts(spark, (1, text)))
    row = tokenized.first()
    assert len(row["token_map"]) == 20_000
    assert row["text"] == " ".join(f"T{i % 20_000 + 1}" for i in range(30_000))
    assert privacy.restore(tokenized).first()["text"] == text


def test_long_runs_take_linear_time(spark):
    row = privacy.tokenize(texts(spark, (1, "a" * 300_000 + "1" * 300_000 + "@"))).first()
    assert row["token_map"] == []


@pytest.mark.parametrize(
    "text, spans, tokenized",
    [
        ("0123456789", [(8, 10, "NAME"), (0, 2, "NAME")], "T1234567T2"),
        ("0123456789", [(0, 4, "NAME"), (2, 6, "DATE"), (0, 2, "NAME")], "T1456789"),
        ("0123456789", [(0, 2, "NAME"), (2, 4, "NAME")], "T1T2456789"),
        ("😀Ann😀Ann", [(1, 4, "NAME"), (5, 8, "EMAIL")], "😀T1😀T1"),
        ("Ann and Bob", [(0, 3, "OTHER"), (8, 11, "NAME")], "Ann and T1"),
        ("Ann and Bob", [], "Ann and Bob"),
    ],
)
def test_given_spans(spark, text, spans, tokenized):
    table = spark.createDataFrame([(1, *s) for s in spans], SPANS)
    row = privacy.restore(privacy.tokenize_spans(texts(spark, (1, text)), table).withColumn("kept", F.col("text"))).first()
    assert row["kept"] == tokenized and row["text"] == text


def test_many_tokens_in_long_text_restore(spark):
    parts = [f"person{i:03d}" for i in range(300)]
    text = " é😀 ".join(parts) + "x" * 3000
    spans, at = [], 0
    for part in parts:
        at = text.index(part, at)
        spans.append((1, at, at + len(part), "NAME"))
    table = spark.createDataFrame(spans, SPANS)
    tokenized = privacy.tokenize_spans(texts(spark, (1, text)), table)
    row = tokenized.first()
    assert row["text"].startswith("T1 é😀 T2 ") and len(row["token_map"]) == 300
    assert privacy.restore(tokenized).first()["text"] == text


def test_many_overlapping_spans(spark):
    text = "ab" * 3000
    spans = [(1, i, i + 2, "NAME") for i in range(5998)]
    row = privacy.tokenize_spans(texts(spark, (1, text)), spark.createDataFrame(spans, SPANS)).first()
    assert row["text"] == "T1" * 2999 + "ab" and len(row["token_map"]) == 1


def test_round_trip_of_random_spans(spark):
    rng = random.Random(11)
    docs, spans = [], []
    for doc in range(150):
        text = "".join(rng.choices("abAB é😀\n.", k=rng.randrange(1, 80)))
        docs.append((doc, text))
        for _ in range(rng.randrange(6)):
            begin = rng.randrange(len(text))
            spans.append((doc, begin, rng.randrange(begin + 1, len(text) + 1), "NAME"))
    tokenized = privacy.tokenize_spans(texts(spark, *docs), spark.createDataFrame(spans, SPANS))
    assert {r["doc_id"]: r["text"] for r in privacy.restore(tokenized).collect()} == dict(docs)


def entries(*values):
    return [(f"T{i}", v, "NAME") for i, v in enumerate(values, 1)]


MAP = "doc_id long, text string, token_map array<struct<token:string,value:string,type:string>>"


def test_restore_is_one_pass_and_knows_t10(spark):
    values = [f"v{i}" for i in range(12)]
    rows = [
        (1, "T1 T10 T12 T13 T0 T01 T", entries(*values)),
        (2, "T1 T2", entries("T2", "b")),
        (3, None, entries("a")),
        (4, "T1", []),
        (5, "T19", entries("a")),
        (6, "T99999999999999999999", entries("a")),
    ]
    df = spark.createDataFrame(rows, MAP)
    got = {r["doc_id"]: r for r in privacy.restore(df).collect()}
    assert got[1]["text"] == "v0 v9 v11 v03 T0 T01 T"
    assert got[2]["text"] == "T2 b"
    assert got[3]["text"] is None and got[3]["error"]
    assert got[4]["text"] == "T1"
    assert got[5]["text"] == "a9"
    assert got[6]["text"] == "T99999999999999999999"
    in_order = {r["doc_id"]: r["text"] for r in privacy.restore(df, in_order=True).collect()}
    assert in_order[1].startswith("v0 v00 v02") and in_order[2] == "b b"


def test_look_alike_tokens_are_flagged(spark):
    df = texts(spark, (1, "T1 said a@b.org"), (2, "x a@b.org")).withColumn("original", F.col("text"))
    flags = privacy.flag_reversible(privacy.tokenize(df), "original").collect()
    assert {r["doc_id"]: r["reversible"] for r in flags} == {1: False, 2: True}


def test_stored_maps(spark):
    df = texts(spark, (1, TEXT), (2, "none"))
    tokenized = privacy.tokenize(df)
    stored = privacy.explode_token_map(tokenized)
    joined = privacy.attach_token_map(tokenized.drop("token_map"), stored)
    rows = {r["doc_id"]: r for r in privacy.restore(joined).collect()}
    assert rows[1]["text"] == TEXT and rows[1]["error"] is None
    assert rows[2]["text"] == "none" and rows[2]["error"] == "token map is missing"
    with pytest.raises(Exception, match="token map is missing"):
        privacy.attach_token_map(tokenized.drop("token_map"), stored, strict=True).collect()


GAZETTEER = [("Acme", "ORG"), ("Acme Bank", "ORG"), ("Ann Lee", "NAME"), ("C++ (Inc)", "ORG"), ("Customer", "ORG")]


@pytest.mark.parametrize("limits", [{}, {"max_inline": 0}, {"max_inline": 0, "max_broadcast": 0}])
def test_names_by_every_join(spark, limits):
    gazetteer = spark.createDataFrame(GAZETTEER, "name string, type string")
    df = texts(spark, (1, "Ann Lee left Acme\nBank, not Acmes."), (2, "no one"), (3, "(Acme) C++ (Inc) Acme"))
    found = names.find_names(df, gazetteer, **limits)
    listed = {r["doc_id"]: [n["name"] for n in r["names"]] for r in found.collect()}
    assert listed[1] == ["Ann Lee", "Acme Bank", "Acme"]
    assert listed[2] == [] and listed[3] == ["Acme", "C++ (Inc"]
    row = {r["doc_id"]: r for r in privacy.tokenize(found, names="names", types=("NAME", "ORG")).collect()}[1]
    assert row["text"] == "T1 left T2, not Acmes."
    assert privacy.tokenize(found, names="names").where("doc_id = 1").first()["text"] == "T1 left Acme\nBank, not Acmes."


def test_organizations_are_replaced_everywhere(spark):
    gazetteer = spark.createDataFrame(GAZETTEER, "name string, type string")
    df = texts(spark, (1, "Acme and Acme Bank and Acmes"), (2, "Ann Lee"))
    found = names.find_names(df, gazetteer)
    assert {r["doc_id"]: r["text"] for r in names.anonymize(found).collect()} == {
        1: "[Customer] and [Customer] and [Customer]s",
        2: "Ann Lee",
    }
    in_order = names.anonymize(found, in_order=True, replacement="X").where("doc_id = 1").first()["text"]
    assert in_order == "X and X Bank and Xs"


def test_empty_gazetteer(spark):
    gazetteer = spark.createDataFrame([], "name string, type string")
    df = texts(spark, (1, "Acme a@b.org"), (2, None))
    for limits in ({}, {"max_inline": -1}):
        found = names.find_names(df, gazetteer, **limits)
        assert [r["names"] or [] for r in found.collect()] == [[], []]
        done = {r["doc_id"]: r["text"] for r in privacy.tokenize(names.anonymize(found), names="names").collect()}
        assert done == {1: "Acme T1", 2: None}
