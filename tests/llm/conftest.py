import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n long, key string, _hash string, id int, hash string"


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Documents with every odd case: null, empty, blank, long, repeated, near copies, foreign letters."""
    base, passage = sentence(1, 120), sentence(2, 40)
    words = base.split()
    near = words[:60] + ["changed"] + words[61:]
    rows = [
        (0, base),
        (1, base),
        (2, " ".join(near)),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (6, "12 34 !!"),
        (7, "word"),
        (8, "one two"),
        (9, f"{sentence(3, 30)} {passage} {sentence(4, 10)}"),
        (10, f"{sentence(5, 5)}\n{passage}\tend"),
        (11, "Ünï çödé \u00a0 x\u2028y \u0085 z 漢字 <|endoftext|> <|startoftext|>don't I'll"),
        (12, "ab " * 9_000),
        (13, "x" * 30_000),
        (14, sentence(6, 5_000)),
        (None, base),
        (None, passage),
        (17, passage),
        (17, passage),
        (18, sentence(7, 13)),
        (19, "  two  blanks   three \x1c\x0b "),
        (20, sentence(7, 13)),
        (21, sentence(8, 12)),
        (22, sentence(8, 12) + "."),
    ]
    return rows + [(100 + i, sentence(1000 + i, 5 + i)) for i in range(20)]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents with extra columns whose names clash with those that operators use."""
    langs = ["en", "de", None]
    rows = [(i, t, langs[k % 3], "s", k, "k", "h", k, "h") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "n")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df) -> list[tuple]:
    """Rows in an order that holds nulls."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
