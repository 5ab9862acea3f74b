"""Token counts: pieces once per distinct pre-token, joined to the pre-token counts of each document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from textloom.llm.common import stored

#: Pre-tokens that every task knows: the most frequent ones, this many at most, each of this many characters at most.
COMMON = 100_000
COMMON_LENGTH = 64
#: Entries of a task's dictionaries before they are emptied.
HELD = 500_000

COUNTED = pa.schema([("piece", pa.string()), ("freq", pa.int64())])
SIZED = pa.schema([("piece", pa.string()), ("freq", pa.int64()), ("n", pa.int64())])
UNKNOWN = pa.struct([("piece", pa.string()), ("times", pa.int64())])
ROWS = pa.schema(
    [
        ("part", pa.int32()),
        ("row", pa.int64()),
        ("id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("known", pa.int64()),
        ("unknown", pa.list_(UNKNOWN)),
    ]
)

#: Blanks beside other white space, and white space that is rare: such texts are left to the library as a whole.
UNEVEN = ("  ", " \n", "\n ", "\n\n")
RARE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Words of Latin letters, with punctuation after them (no apostrophe): two pre-tokens, or one.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


class Splitter:
    """Cuts texts into chunks that the pre-tokenizer treats alone, and chunks into pre-tokens.

    A chunk is a word with the blank before it (left out here), or a line end with the word after it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = list(tokenizer.get_added_tokens_decoder().values())
        if tokenizer.normalizer is not None or any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("only tokenizers without normalizer and with plain added tokens")
        self.pre, self.model = tokenizer.pre_tokenizer, tokenizer.model
        names = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def listed(self, text: str) -> list[str]:
        """Pre-tokens of a text by the library."""
        return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]

    def chunks(self, text: str) -> tuple[int, list[str], list[str]]:
        """Special tokens of a text, its chunks, and pre-tokens of the parts that cannot be cut into chunks."""
        parts = self.special.split(text) if self.special and self.special.search(text) else [text]
        chunks, pieces = [], []
        for part in parts:
            if not part:
                continue
            ends = part[0] in " \n" or part[-1] in " \n"
            if ends or RARE.search(part) or any(x in part for x in UNEVEN):
                pieces += self.listed(part)
            else:
                first, *others = part.replace("\n", " \n").split(" ")
                chunks += others
                pieces += self.listed(first)
        return len(parts) - 1, chunks, pieces

    def pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk."""
        line = chunk[0] == "\n"
        word = chunk[1:] if line else chunk
        simple = SIMPLE.fullmatch(word)
        if not simple:
            return ["\n", *self.listed(word)] if line else self.listed(" " + word)
        letters, rest = simple.groups()
        if line:
            return [x for x in ("\n", letters, rest) if x]
        return [" " + letters, rest] if letters and rest else [" " + word]

    def size(self, piece: str) -> int:
        """Tokens of a pre-token."""
        return sum(len(self.model.tokenize(p)) for p, _ in self.pre.pre_tokenize_str(piece))


def _frequencies(path: str):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        chunks, pieces = Counter(), Counter()

        def flush():
            for chunk, times in chunks.items():
                for piece in splitter.pieces(chunk):
                    pieces[piece] += times
            names, freqs = list(pieces), list(pieces.values())
            chunks.clear()
            pieces.clear()
            for at in range(0, len(names), 20_000):
                part = slice(at, at + 20_000)
                yield pa.RecordBatch.from_pydict({"piece": names[part], "freq": freqs[part]}, COUNTED)

        for table in tables:
            for text in table.column(0):
                _, found, others = splitter.chunks(text.as_py())
                chunks.update(found)
                pieces.update(others)
                if len(chunks) + len(pieces) > HELD:
                    yield from flush()
        yield from flush()

    return run


def _sizes(path: str):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        for table in tables:
            n = [splitter.size(piece) for piece in table.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*table.columns, pa.array(n, pa.int64())], schema=SIZED)

    return run


class Known(dict):
    """By chunk: its tokens, or where not all pre-tokens are known, (tokens of the known ones, the others)."""

    def __init__(self, splitter: Splitter, sizes: dict[str, int]):
        super().__init__()
        self.splitter, self.sizes = splitter, sizes

    def __missing__(self, chunk: str):
        known, others = self.of(self.splitter.pieces(chunk))
        found = (known, others) if others else known
        if len(self) < HELD and len(chunk) <= COMMON_LENGTH:
            self[chunk] = found
        return found

    def of(self, pieces: list[str]) -> tuple[int, list[str]]:
        sizes = self.sizes
        return sum(sizes.get(p, 0) for p in pieces), [p for p in pieces if p not in sizes]


def _rows(path: str, common):
    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(path)
        of = Known(splitter, common.value)
        part, row = TaskContext.get().partitionId(), 0
        for whole in tables:
            for at in range(0, whole.num_rows, 1_000):
                table = whole.slice(at, 1_000)
                sizes, knowns, offsets, names, times = [], [], [0], [], []
                for text in table.column("text"):
                    text = text.as_py()
                    known, chunks, pieces = splitter.chunks(text)
                    more, unknown = of.of(pieces)
                    known += more
                    for chunk in chunks:
                        found = of[chunk]
                        if found.__class__ is int:
                            known += found
                        else:
                            known += found[0]
                            unknown += found[1]
                    counted = Counter(unknown)
                    names += counted
                    times += counted.values()
                    offsets.append(len(names))
                    knowns.append(known)
                    sizes.append(len(text.encode()))
                pairs = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int64())], fields=list(UNKNOWN))
                arrays = [
                    pa.array([part] * len(sizes), pa.int32()),
                    pa.array(range(row, row + len(sizes)), pa.int64()),
                    table.column("id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(knowns, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=ROWS.names)
                row += len(sizes)

    return run


def piece_table(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Distinct pre-tokens of all texts: ``piece``, ``freq`` in the corpus, ``n`` tokens."""
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_frequencies(path), "piece string, freq bigint")
    total = counted.groupBy("piece").agg(F.sum("freq").alias("freq"))
    return total.mapInArrow(_sizes(path), "piece string, freq bigint, n bigint")


def token_counts(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    common: int = COMMON,
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``path`` is a byte-level BPE file of the tokenizers library, in the same place on all machines. Pre-tokens are counted per task
    and then over the corpus, and each distinct one is split into tokens once. A task knows the sizes of the ``common`` most
    frequent ones, of COMMON_LENGTH characters at most; the rest of a document's counts is joined by
    pre-token and summed. No token ids are kept. Special tokens inside a text count as one token.

    A null text counts as empty: no bytes, no tokens. Repeated rows and null ids stay as they are.
    """
    spark = docs.sparkSession
    pieces = stored(piece_table(docs, path, text_col))
    top = pieces.where(F.length("piece") <= COMMON_LENGTH).orderBy(F.desc("freq"), "piece").limit(common)
    sizes = spark.sparkContext.broadcast({r["piece"]: r["n"] for r in top.select("piece", "n").toLocalIterator()})
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kinds = "part int, row bigint, id bigint, n_bytes bigint, known bigint, unknown array<struct<piece:string,times:bigint>>"
    rows = texts.mapInArrow(_rows(path, sizes), kinds)
    one = rows.select("part", "row", "id", "n_bytes", "known", F.explode_outer("unknown").alias("u"))
    # Documents without a rest have no pre-token to join: they are spread by row.
    salt = F.when(F.col("u").isNull(), F.pmod(F.xxhash64("part", "row"), F.lit(1 << 20)) + 1).otherwise(0).cast("int")
    left = one.withColumns({"piece": F.col("u.piece"), "_salt": salt})
    joined = left.join(pieces.select("piece", "n", F.lit(0).alias("_salt")), ["piece", "_salt"], "left")
    rest = F.sum(F.coalesce(F.col("u.times") * F.col("n"), F.lit(0)))
    counted = joined.groupBy("part", "row", "id", "n_bytes", "known").agg(rest.alias("rest"))
    n_tokens = F.col("known") + F.col("rest")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit")
    )
