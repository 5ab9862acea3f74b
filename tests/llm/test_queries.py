"""The registered queries over whole tables: against their SQL, or against brute force where SQL cannot tell."""

import hashlib
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as entry
from textloom.llm import warc

from .test_near_and_repeats import fingerprint, removed, smallest_reachable

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    def read(name, columns):
        return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet' ORDER BY 1").fetchall()

    return {
        "documents": read("documents", "doc_id, coalesce(text, ''), lang"),
        "pages": read("pages", "page_id, coalesce(html, '')"),
        "benchmark": read("benchmark", "item_id, text"),
    }


def rows_of(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, SF).collect()]


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = db.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    ours = sorted((tuple(r[c] for c in columns) for r in rows_of(spark, name)), key=repr)
    assert ours == sorted(result.fetchall(), key=repr)


def test_op3(spark, tables):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: (len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t, _ in tables["documents"]}
    found = rows_of(spark, "op3_token_counts")
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in found} == want and len(found) == len(want)
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)


def test_op4(spark, tables):
    langs = {i: lang for i, _, lang in tables["documents"]}
    found = rows_of(spark, "op4_language_id")
    out = [r for r in found if r["held_out"]]
    assert len(found) == len(langs) and {r["doc_id"] for r in out} == {i for i in langs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in out]) >= 0.97


def test_op5(spark, tables):
    found = {(r["doc_id"], r["item_id"]) for r in rows_of(spark, "op5_decontamination")}
    held = {(i, k) for i, t, _ in tables["documents"] for k, item in tables["benchmark"] if item in t}
    assert held and held <= found
    words = {k: set(zip(*(item.lower().split()[j:] for j in range(8)))) for k, item in tables["benchmark"]}
    texts = {i: t.lower().split() for i, t, _ in tables["documents"]}
    assert all(words[k] & set(zip(*(texts[i][j:] for j in range(8)))) for i, k in found)


def test_op6(spark, tables):
    ids, fps = [i for i, _, _ in tables["documents"]], [fingerprint(t) for _, t, _ in tables["documents"]]
    comps = smallest_reachable(ids, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op6_simhash")}
    assert found == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, comps)}


def test_op8(spark, tables):
    found = rows_of(spark, "op8_substring_dedup")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found), key=repr)
    assert got == removed([(i, t) for i, t, _ in tables["documents"]])


def test_op9(spark, tables):
    ids = defaultdict(list)
    for i, html in tables["pages"]:
        ids[html].append(i)
    want = set()
    for i, html in tables["pages"]:
        first = min(ids[html])
        kind = ("response", None) if i == first else ("revisit", first)
        want.add((i, len(html.encode()), warc.digest_of(html.encode()), *kind))
    found = rows_of(spark, "op9_warc")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert {tuple(r[c] for c in columns) for r in found} == want and len(found) == len(want)


def test_op10(spark, tables):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t, _ in tables["documents"]:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            want[i, at // 2048] = (at, len(part), zlib.crc32(part.tobytes()))
    found = rows_of(spark, "op10_best_fit_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(sequences) <= 1.01 * sum(r["length"] for r in found) / 2048 + 1


def test_op11(spark, tables):
    model = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for i, t, _ in tables["documents"]:
        ids = model.encode(t, add_eos=True)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), model.decode(ids))]
        want[i] = (len(ids), *digests)
    found = rows_of(spark, "op11_sentencepiece")
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found} == want and len(found) == len(want)
