import html
import random

from pyspark.sql import functions as F

from textloom.functions.arrays import run_counts
from textloom.functions.chunks import chunk_texts
from textloom.functions.insights import STOP_WORDS, key_phrases, majority, phrases, sentiment
from textloom.functions.text import PUNCTUATION, WHITESPACE, bare_words, decode_entities, ngrams, words

ALPHABET = list("ab.,-(T1é😀ß ") + [" ", "\n", "\t", " ", "　", "\x1c", " ", "\r"]


def random_texts(n=200, length=60, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(length))) for _ in range(n)]


def test_words_split_like_python(values):
    texts = ["", "  ", WHITESPACE, "a", *random_texts()]
    assert values(texts, words) == [t.split() for t in texts]


def test_bare_words(values):
    texts = ["", "--", "a -- b", "(don't) stop, now...", *random_texts()]
    expected = [[w for w in (x.strip(PUNCTUATION) for x in t.split()) if w] for t in texts]
    assert values(texts, bare_words) == expected


def test_ngrams_longest_first(values):
    assert values(["New York, City"], lambda t: ngrams(t, [1, 2])) == [
        ["New York", "New", "York, City", "York", "City"]
    ]


def test_entities_decode_once_from_left_to_right(values):
    texts = ["a &amp;lt; b", "&quot;x&quot; &copy;&middot;", "&#65;&#x1F600;", "&nosuch; & &;", "&eacute;&nbsp;&euro;"]
    assert values(texts, decode_entities) == [html.unescape(t) for t in texts]
    assert values(["&#0;x&#xD800;", "&amp &copy=1 &#65 &#x42"], decode_entities) == ["x", "&amp &copy=1 A B"]


def chunk_model(text, limit):
    chunks, now, size = [], [], 0
    for word in text.split():
        n = len(word.encode())
        if size + n > limit:
            chunks.append(" ".join(now))
            now, size = [], 0
        now.append(word)
        size += n
    return chunks + ([" ".join(now)] if now else [])


def test_chunks_match_a_model(values):
    texts = [
        "", " \n ", "x" * 11, "xxxxxxxxxxx a b", "a xxxxxxxxxxx b", "aaaaa bbbbb c", "ééééé ß", "a b c",
        *random_texts(seed=3),
    ]
    assert values(texts, lambda t: chunk_texts(t, 10)) == [chunk_model(t, 10) for t in texts]


def test_chunks_of_long_texts_match_a_model(values):
    texts = random_texts(n=20, length=4000, seed=4) + [" ".join(["abc", "é" * 30, "x" * 150] * 300), "a " * 9000]
    for limit in (1, 100, 4000):
        assert values(texts, lambda t, n=limit: chunk_texts(t, n)) == [chunk_model(t, limit) for t in texts]


def test_chunks_hold_all_words_within_the_limit(values):
    text = " ".join(f"wörd{i}" for i in range(5000))
    (chunks,) = values([text], chunk_texts)
    assert " ".join(chunks) == text
    assert all(len(c.replace(" ", "").encode()) <= 4000 for c in chunks) and len(chunks) > 5


def test_run_counts(spark):
    df = spark.sql("select array('b', null, 'a', 'b', null) v, cast(array() as array<string>) e")
    row = df.select(run_counts(F.col("v")).alias("v"), run_counts(F.col("e")).alias("e")).first()
    assert [tuple(r) for r in row["v"]] == [(None, 2), ("a", 1), ("b", 2)]
    assert row["e"] == []


def phrase_model(text):
    out, now = [], []

    def close():
        if now:
            out.append(" ".join(now))
        now.clear()

    for word in text.lower().split():
        core = word.strip(PUNCTUATION)
        if not core or core in STOP_WORDS:
            close()
            continue
        if not word.startswith(core):
            close()
        now.append(core)
        if not word.endswith(core):
            close()
    close()
    return out


def test_phrases_match_a_model(values):
    rng = random.Random(5)
    pool = ["the", "of", "(the", "red", "fox,", "well-known", "--", "Of.", "and", "x y", "'quick'", "fox"]
    texts = ["", " . ", *(" ".join(rng.choices(pool, k=rng.randrange(30))) for _ in range(200)), *random_texts()]
    assert values(texts, phrases) == [phrase_model(t) for t in texts]


def test_key_phrases_score_and_order(values):
    (found,) = values(["Red fox and red fox, the cat. A cat is a cat"], key_phrases)
    assert [tuple(f) for f in found] == [("red fox", 4.0), ("cat", 3.0)]
    assert len(values(["a1 the b1 the c1"], lambda t: key_phrases(t, 2))[0]) == 2


def test_sentiment_labels(values):
    texts = ["Good, great!", "bad", "good bad", "table", "", "great great bad"]
    assert values(texts, sentiment) == ["POSITIVE", "NEGATIVE", "MIXED", "NEUTRAL", "NEUTRAL", "POSITIVE"]


def test_majority_ties_and_missing_labels(spark):
    rows = [(["P", "N", "P"],), (["P", "N"],), ([None, None, "P"],), ([None, "P"],)]
    df = spark.createDataFrame(rows, "v array<string>").select(majority(F.col("v")).alias("m"))
    assert [r["m"] for r in df.collect()] == ["P", "N", None, "P"]
