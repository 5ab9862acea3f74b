"""Language identification with error-correcting output codes.

Every language has a codeword. For each bit a binary naive Bayes classifier over hashed n-grams tells the
languages with a 1 from those with a 0. Decoding sums a loss over the bits, weighted by how well each
classifier told its two sides apart, and takes the nearest codeword. A text whose two nearest codewords are about
equally far is ambiguous; how near that is, is measured on a fold of the documents that are learned from.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from textloom.llm.common import batches, stored

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Bytes whose n-grams are held at a time; a longer text is read in overlapping stretches.
STRETCH = 1 << 20
#: Labels that a model may have.
MAX_LANGS = 1_000
#: N-grams of a text up to which their weights are looked up one by one, instead of a product over all buckets.
GATHERED = 2_000
#: Languages up to which all splits into two sides are used; beyond, random splits.
ALL_SPLITS = 7
#: One in FOLDS documents, by text, measures how far apart the two nearest codewords of texts with a known language are. All but
#: the share LOWEST of them lie above a distance; a text that has less than CLOSE of it is ambiguous.
FOLDS, LOWEST, CLOSE = 5, 0.001, 0.5

COUNTS = pa.schema([("lang", pa.string()), ("fold", pa.bool_()), ("bucket", pa.int32()), ("n", pa.int64())])
JUDGED = pa.schema(
    [
        ("lang_pred", pa.string()),
        ("score", pa.float64()),
        ("ambiguous", pa.bool_()),
    ]
)


def buckets_of(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of bytes of the lower-cased text, all orders together, by stretches."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), np.uint8)
    for start in range(0, len(data), STRETCH):
        part = data[start : start + STRETCH + max(ORDERS) - 1].astype(np.uint32)
        found, value = [], np.zeros(len(part), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            # A stretch owns the n-grams that start in it.
            size = min(len(part) - order + 1, STRETCH)
            if size <= 0:
                break
            value = value[: len(part) - order + 1] * np.uint32(257) + part[order - 1 :]
            if order in ORDERS:
                mixed = (value[:size] + np.uint32(order * 0x3C6EF35F & 0xFFFFFFFF)) * np.uint32(2654435761)
                found.append((mixed >> np.uint32(17)).astype(np.intp))
        if found:
            yield np.concatenate(found)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(langs: list[str]) -> np.ndarray:
    """A row of -1 and 1 per language. Up to ALL_SPLITS languages every split into two sides is a column."""
    n = len(langs)
    if n < 2:
        return np.ones((n, 1))
    if n <= ALL_SPLITS:
        return np.array([[1 if c >> i & 1 else -1 for c in range(1, 2 ** (n - 1))] for i in range(n)], float)
    width = 15 + 10 * math.ceil(math.log2(n))
    code = np.empty((n, width))
    for i, lang in enumerate(langs):
        for b in range(width):
            code[i, b] = 1 if hashlib.md5(f"{lang}/{b}".encode()).digest()[0] & 1 else -1
    mixed = np.abs(code.sum(axis=0)) < n
    return code[:, mixed]


def _count(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        counts: dict[tuple[str, bool], np.ndarray] = {}

        def flush():
            for (lang, fold), held in counts.items():
                for bucket in np.nonzero(held)[0].tolist():
                    yield {"lang": lang, "fold": fold, "bucket": bucket, "n": int(held[bucket])}
            counts.clear()

        for table in tables:
            keys = zip(table.column("lang").to_pylist(), table.column("fold").to_pylist())
            for key, text in zip(keys, table.column("text")):
                text = text.as_py()
                if has_letter(text):
                    if key not in counts:
                        if len(counts) >= 64:
                            yield from flush()
                        counts[key] = np.zeros(BUCKETS, np.int64)
                    for found in buckets_of(text):
                        counts[key] += np.bincount(found, minlength=BUCKETS)
        yield from flush()

    yield from batches(rows(), COUNTS)


class Model:
    """Binary classifiers, one per bit, and the decoder."""

    def __init__(self, langs: list[str], counts: np.ndarray, bound: float = 0.0):
        """``counts``: a row of n-gram counts per language; ``bound``: the distance of codewords up to which a text is ambiguous."""
        self.langs, self.code, self.bound = langs, codewords(langs), bound
        if len(langs) < 2:
            return
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        ones, zeros = self.code.T > 0, self.code.T < 0
        one = np.stack([share[side].mean(axis=0) for side in ones])
        zero = np.stack([share[side].mean(axis=0) for side in zeros])
        self.weights = np.ascontiguousarray((np.log(one) - np.log(zero)).T.astype(np.float32))
        # Mean margin of each language under each classifier; the worst one tells how far a bit can be trusted.
        margins = share @ self.weights
        self.trust = np.clip((margins * self.code).min(axis=0), 1e-6, None)
        self.trust = self.trust / self.trust.max()
        self.scale = np.abs(margins).mean(axis=0) + 1e-9

    def judge(self, text: str) -> tuple[str, float, float]:
        """Language, score from 0 to 1, and how much nearer the nearest codeword is than the next."""
        if len(self.langs) < 2:
            return self.langs[0], 1.0, 1.0
        total, n = np.zeros(self.code.shape[1]), 0
        for found in buckets_of(text):
            if len(found) < GATHERED:
                total += self.weights[found].sum(axis=0)
            else:
                total += np.bincount(found, minlength=BUCKETS).astype(np.float32) @ self.weights
            n += len(found)
        margin = total / n / self.scale
        loss = (self.trust * np.log1p(np.exp(-2 * margin * self.code))).sum(axis=1) / self.trust.sum()
        order = np.argsort(loss, kind="stable")
        odds = np.exp(-(loss - loss[order[0]]) * 4)
        score = float(odds[order[0]] / odds.sum())
        return self.langs[order[0]], score, float(loss[order[1]] - loss[order[0]])


def _judge(model):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = model.value
        for table in tables:
            rows = []
            for text in table.column("text"):
                text = text.as_py()
                lang, score, nearer = "und", 0.0, np.inf
                if decoder.langs and has_letter(text):
                    lang, score, nearer = decoder.judge(text)
                rows.append((lang, score, bool(nearer <= decoder.bound)))
            columns = zip(*rows) if rows else ([], [], [])
            arrays = [pa.array(c, f.type) for c, f in zip(columns, JUDGED)]
            yield pa.RecordBatch.from_arrays([*(table.column(c) for c in ("id", "held_out")), *arrays], ["id", "held_out", *JUDGED.names])

    return run


def held_out(id_col: str) -> Column:
    """A fifth of the documents, by id. Documents without id are not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _model(found: pa.Table, bound: float = 0.0) -> Model:
    langs = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    rows = np.array([langs.index(x) for x in found.column("lang").to_pylist()], int)
    np.add.at(counts, (rows, found.column("bucket").to_numpy()), found.column("n").to_numpy())
    return Model(langs, counts, bound)


def _apart(shared):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for table in tables:
            apart = []
            for lang, text in zip(table.column("lang").to_pylist(), table.column("text")):
                text = text.as_py()
                if has_letter(text):
                    said, _, nearer = model.judge(text)
                    apart += [nearer] if said == lang else []
            yield pa.RecordBatch.from_arrays([pa.array(apart, pa.float64())], names=["apart"])

    return run


def train(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_langs: int = MAX_LANGS, close: float = CLOSE
) -> Model:
    """Counts n-grams of all given documents per language; the driver gets 2 * BUCKETS sums per language at most.

    A model of the other folds judges one in FOLDS documents. Of those that it tells rightly, all but LOWEST have their two
    nearest codewords further apart than some distance; ``close`` times that is the bound of the model that is returned,
    which knows all documents. Null labels and
    texts teach nothing; repeated rows count each. More than ``max_langs`` labels end with an error before any sum is fetched.
    """
    fold = (F.pmod(F.xxhash64(F.col(text_col)), F.lit(FOLDS)) == 0).alias("fold")
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    labelled = labelled.select(F.col(lang_col).alias("lang"), fold, F.col(text_col).alias("text"))
    counted = labelled.mapInArrow(_count, "lang string, fold boolean, bucket int, n bigint")
    sums = stored(counted.groupBy("lang", "fold", "bucket").agg(F.sum("n").alias("n")))
    if sums.select("lang").distinct().limit(max_langs + 1).count() > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    found = sums.toArrow()
    trial = _model(found.filter(pc.invert(found.column("fold"))))
    if len(trial.langs) < 2:
        return _model(found)
    shared = docs.sparkSession.sparkContext.broadcast(trial)
    apart = labelled.where("fold").select("lang", "text").mapInArrow(_apart(shared), "apart double")
    return _model(found, close * (apart.agg(F.percentile_approx("apart", LOWEST, 100_000)).first()[0] or 0.0))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``lang_pred``, ``score``, ``ambiguous``.

    ``und`` with score 0 for null texts, texts without a letter, and where nothing was learned; these are not ``ambiguous``.
    Codewords that are equally near go to the first language by name. Repeated rows and null ids stay, ids keep their type; a
    null id is held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kinds = f"id {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return rows.mapInArrow(_judge(shared), kinds).withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, then judge all, repeated rows and null ids too; see ``train``, ``predict``."""
    return predict(docs, train(docs.where(~held_out(id_col)), text_col, lang_col), id_col, text_col)


def flag_rejected(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input with a boolean ``_rejected``: no language (``und``), or ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def rejected(texts):
        decoder = shared.value

        def one(text):
            return not decoder.langs or not has_letter(text) or decoder.judge(text)[2] <= decoder.bound

        return texts.map(one).astype(bool)

    return docs.withColumn("_rejected", rejected(F.col(text_col)))
