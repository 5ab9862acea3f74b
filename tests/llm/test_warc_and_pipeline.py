import gzip
import struct

import pytest
import zstandard

import corpus_pipeline
from textloom.llm import language_id, warc

from .conftest import rows, sentence
from .test_near_and_repeats import fingerprint, smallest_reachable

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (0, None, "<p>same</p>"), (3, "http://a/\r\nX: y", ""), (4, "", None),
    (5, "u", "é漢" * 20_000), (6, "u", "\0\r\n\r\nWARC/1.1\r\n"), (7, "u", "short"), (7, "u", "short"), (None, "u", "short"), (None, "u", "alone"),
    (-8, "u", "x" * 300_000),
]
SCHEMA = "page_id long, url string, html string, key string, first_id long"


@pytest.fixture(scope="module")
def pages(spark):
    more = [(100 + i, f"http://b/{i}", f"<html>{sentence(i, 60)}</html>") for i in range(120)]
    return spark.createDataFrame([(*p, "k", 1) for p in PAGES + more], SCHEMA)


def expected(pages, min_bytes=0):
    known = pages.collect()
    out = []
    for p in known:
        payload = (p.html or "").encode()
        ids = [q.page_id for q in known if (q.html or "") == (p.html or "") and q.page_id is not None]
        first = min(ids, default=None)
        revisit = first is not None and p.page_id != first and len(payload) >= min_bytes
        out.append((p.page_id, len(payload), warc.digest_of(payload), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes", [0, 8])
def test_round_trip(pages, min_bytes):
    read = warc.archive_pages(pages, min_bytes=min_bytes).cache()
    assert rows(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == expected(pages, min_bytes)
    payloads = {r.page_id: r.payload.decode() for r in read.where("record_type = 'response'").collect()}
    assert all(payloads[p.page_id] == (p.html or "") for p in pages.collect() if p.page_id in payloads and p.page_id is not None)


def test_archives_are_dictionary_and_frames(spark, pages, tmp_path):
    warc.write_archives(pages.coalesce(1), str(tmp_path / "a"))
    (archive,) = [p.read_bytes() for p in (tmp_path / "a").glob("part-*")]
    magic, size = struct.unpack_from("<II", archive)
    assert magic == warc.DICTIONARY_MAGIC and size > 100
    assert len(list(warc.records_of(archive))) == pages.count()
    assert warc.read_archives(spark, str(tmp_path / "a")).where("error is null").count() == pages.count()


def frames(*records, dictionary=None):
    compressor = zstandard.ZstdCompressor(dict_data=dictionary)
    return b"".join(compressor.compress(r) for r in records)


def test_other_writers():
    samples = [warc.record(i, "u", sentence(i, 80).encode(), None, False) for i in range(300)]
    trained = zstandard.train_dictionary(4096, samples)
    packed = zstandard.ZstdCompressor().compress(trained.as_bytes())
    head = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed
    found = list(warc.records_of(head + struct.pack("<II", 0x184D2A5F, 3) + b"abc" + frames(*samples, dictionary=trained)))
    assert [r["page_id"] for r in found] == list(range(300)) and not any(r["error"] for r in found)
    assert [r["payload"] for r in found] == [sentence(i, 80).encode() for i in range(300)]


GOOD = warc.record(1, "u", b"payload", None, False)


@pytest.mark.parametrize(
    "broken",
    [
        GOOD.replace(b"WARC/1.1", b"WARC/9"), GOOD.replace(b"payload", b"payloaD"), GOOD + b"x", GOOD[:-4], GOOD[:-1],
        GOOD.replace(b"Content-Length: ", b"Content-Length: 1"), GOOD.replace(b"WARC-Type: response", b"WARC-Type: other"),
        GOOD.replace(b"WARC-Record-ID", b"X"), b"", b"no record", GOOD.replace(b"Content-Length: 7", b"Content-Length: 8"),
        warc.record(1, "u", b"payload", 0, True).replace(b"WARC-Refers-To", b"X"),
    ],
)
def test_broken_records_are_reported(broken):
    found = list(warc.records_of(frames(GOOD, broken, GOOD)))
    assert [r["error"] is None for r in found] == [True, False, True]


@pytest.mark.parametrize("cut", [1, 7, 30])
def test_cut_archives_are_reported(cut):
    found = list(warc.records_of(frames(GOOD, GOOD)[:-cut]))
    assert found[0]["error"] is None and found[1]["error"]
    assert list(warc.records_of(gzip.compress(GOOD)))[0]["error"]
    assert list(warc.records_of(b"")) == []


def test_broken_archive_ends_the_query(spark, tmp_path, monkeypatch):
    (tmp_path / "x").write_bytes(frames(GOOD + b"x"))
    assert warc.read_archives(spark, str(tmp_path)).where("error is not null").count() == 1


def test_no_pages(spark, pages):
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_pipeline_on_odd_documents(spark, docs, texts, tmp_path):
    passage = sentence(2, 40)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns, name

    model = language_id.train(docs)

    def has_letter(t):
        return any(c.isalpha() for c in t or "") and model.judge(t)[2] > model.bound

    kept = {}
    for i, t in texts:
        if has_letter(t):
            kept[t] = i if i is not None and (kept.get(t) is None or i > kept[t]) else kept.get(t)
    left = list(kept.items())
    fps = {t: fingerprint(t) for t in kept}
    comps = smallest_reachable([i for _, i in left], lambda a, b: (fps[left[a][0]] ^ fps[left[b][0]]).bit_count() <= 3)
    gone = {t for (t, i), c in zip(left, comps) if i is not None and i != c}
    want = {t for t in kept if t not in gone and " ".join(passage.split()) not in " ".join(t.split())}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.text for r in stage.collect()} == want
    assert {r.doc_id for r in packed.collect()} == {kept[t] for t in want}


def test_pipeline_on_no_documents(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
