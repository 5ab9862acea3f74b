import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, url_filter
from textloom.llm.common import hot_join

from .conftest import rows


def expected(texts, best):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    out = []
    for i, t in texts:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = best(ids) if ids else None
        size = len(groups[t or ""])
        out.append((i, keep, size, i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep,best", [("max", max), ("min", min)])
def test_exact_groups(docs, texts, keep, best):
    assert rows(exact_dedup.exact_groups(docs, keep=keep)) == expected(texts, best)


def test_equal_hashes_do_not_join_texts(docs, texts):
    found = exact_dedup.exact_groups(docs, hashed=lambda t: F.unhex(F.substring(F.md5(t.cast("binary")), 1, 1)))
    assert rows(found) == expected(texts, max)
    kept = exact_dedup.keep_one(docs, hashed=lambda t: F.lit(b"same"))
    assert len({t or "" for _, t in texts}) == kept.count()


def test_keep_one(docs, texts):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    best = {}
    for i, t in texts:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert {(r.text or ""): -1 if r.doc_id is None else r.doc_id for r in kept.collect()} == best
    smallest = {r.text or "": r.doc_id for r in exact_dedup.keep_one(docs, keep="min").collect()}
    assert smallest[texts[0][1]] == 0


def test_empty(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert exact_dedup.keep_one(no_docs).count() == 0


def test_hot_join_serves_heavy_light_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr("textloom.llm.common.HEAVY_KEYS", 2)
    left = spark.createDataFrame([(i, i % 5 if i % 7 else None) for i in range(200)], "i int, k int")
    right = spark.createDataFrame([(k, 10 * k, f"v{k}") for k in range(4)], "k int, w int, v string")
    got = {r.i: r.v for r in hot_join(left, right, ["k"], "w", ["v"]).collect()}
    assert got == {i: f"v{i % 5}" if i % 7 and i % 5 < 4 else None for i in range(200)}


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


URLS = [
    "http://a.example.com/en/x?q#f", "HTTP://WWW.EXAMPLE.COM/en/1", "https://example.com/en", "https://example.com/en/",
    "http://notexample.com/en/", "https://x.net/es/1", "https://x.net/ES/1", "https://net/es/", "http://anet/es/", "http://com",
    "http://com/", "http://a.com?x=/en/", "http://a.com#/en/", None, "", "no scheme", "://", "x://y://z.com/", "http://İ.com/a",
    "http://a.com:80/x", "http://a.com/\nline?x", "http://" + "a." * 500 + "com/" + "p" * 5000, "http://a.com/", "http://a.com/",
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, _key string")
    rules = spark.createDataFrame([*RULES, RULES[0]], "host string, path string, verdict string")
    for blocks in (1, 4096):
        got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, rules, blocks=blocks).collect()}
        assert got == {i: judge(u) for i, u in enumerate(URLS)}


def test_urls_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, URLS[0]), (None, URLS[0])], "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    found = url_filter.judge_urls(pages, rules, default="block").collect()
    assert [(r.rule, r.verdict) for r in found] == [(None, "block")] * 2
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(RULES, rules.schema)).count() == 0


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = url_filter.bloom_filter(keys, "key", 256).scalar()
    tried = spark.range(6000).select("id", F.concat(F.lit("k"), "id").alias("key")).withColumn("f", words)
    passed = {r.id for r in tried.where(url_filter.may_contain(F.col("f"), F.col("key"), 256)).select("id").collect()}
    assert set(range(3000)) <= passed and len(passed) < 3300
