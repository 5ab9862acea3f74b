from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textloom.operators import ledger, lookup


def counting_client(folder, fails="", stops=""):
    """A client that leaves a file per call, whatever process it runs in."""

    def make():
        def call(body):
            import uuid

            Path(folder, uuid.uuid4().hex).write_text(body)
            if stops and stops in body and not Path(folder, "mended").exists():
                raise SystemExit("the executor is lost")
            if fails and fails in body and not Path(folder, "mended").exists():
                raise RuntimeError("busy")
            return body.upper()

        return call

    return make


def calls(folder):
    return sorted(p.read_text() for p in Path(folder).iterdir() if p.name != "mended")


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "ledger"), str(tmp_path / "calls")


def table(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "doc_id long, body string").repartition(3)


BODIES = ["a", "b", "a", None, "c", "a", ""]


def test_equal_requests_are_asked_once_and_a_second_run_asks_none(spark, folders):
    folder, seen = folders
    for _ in range(2):
        done = ledger.call_model_once(table(spark, BODIES), counting_client(seen), folder)
        assert {r.doc_id: (r.reply, r.error) for r in done.collect()} == {
            i: (None if b is None else b.upper(), None) for i, b in enumerate(BODIES)
        }
    assert calls(seen) == ["", "a", "b", "c"]
    assert ledger.ask_once(table(spark, [*BODIES, "d"]), counting_client(seen), folder) == 1
    assert calls(seen) == ["", "a", "b", "c", "d"]


def test_failed_requests_are_asked_again(spark, folders):
    folder, seen = folders
    first = ledger.call_model_once(table(spark, BODIES), counting_client(seen, fails="b"), folder)
    assert {(r.reply, r.error) for r in first.where("body = 'b'").collect()} == {(None, "busy")}
    Path(seen, "mended").touch()
    again = ledger.call_model_once(table(spark, BODIES), counting_client(seen, fails="b"), folder)
    assert {(r.reply, r.error) for r in again.where("body = 'b'").collect()} == {("B", None)}
    assert calls(seen) == ["", "a", "b", "b", "c"]


def test_a_run_that_ends_early_keeps_its_waves(spark, folders):
    """The wave in which the run stopped is asked again, earlier ones are not."""
    folder, seen = folders
    bodies = [f"r{i}" for i in range(60)]
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of a dead worker
        ledger.ask_once(table(spark, bodies), counting_client(seen, stops="r59"), folder, wave=10, task=5)
    kept = ledger.read_ledger(spark, folder).count()
    before = len(calls(seen))
    Path(seen, "mended").touch()
    assert ledger.ask_once(table(spark, bodies), counting_client(seen, stops="r59"), folder, wave=10, task=5) == 60 - kept
    assert len(calls(seen)) - before == 60 - kept
    assert ledger.attach_replies(table(spark, bodies), folder).where("reply = upper(body)").count() == 60


def test_two_writers_leave_one_reply(spark, folders):
    folder, seen = folders
    ledger.ask_once(table(spark, ["x"]), counting_client(seen), folder)
    rows = spark.createDataFrame([(ledger_digest(spark, "x"), "other", None, "zz"), (ledger_digest(spark, "y"), None, "busy", "a")], ledger.SCHEMA)
    rows.write.mode("append").parquet(folder)
    got = {r.body: (r.reply, r.error) for r in ledger.attach_replies(table(spark, ["x", "y", "z"]), folder).collect()}
    assert got == {"x": ("X", None), "y": (None, "busy"), "z": (None, None)}


def ledger_digest(spark, body):
    return spark.range(1).select(F.sha2(F.lit(body), 256)).first()[0]


def test_no_requests(spark, folders):
    folder, seen = folders
    assert ledger.call_model_once(table(spark, []), counting_client(seen), folder).count() == 0
    assert ledger.ask_once(table(spark, [None]), counting_client(seen), folder) == 0 and calls(seen) == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_large_lookup_tables(spark, how):
    """Beyond the limit: one key with a third of the rows, nulls, and keys without an entry."""
    rows = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else f"k{i % 40}", i % 2) for i in range(600)]
    entries = [("hot", 1, "h")] + [(f"k{i}", i, None if i == 4 else f"v{i}") for i in range(30)] + [("unused", 9, "u")]
    left = spark.createDataFrame(rows, "i int, key string, n int").repartition(4)
    right = spark.createDataFrame(entries, "key string, no int, value string")
    got = lookup.lookup_join(left, right, ["key"], how, max_rows=5, heavy_keys=3)
    want = left.join(F.broadcast(right), ["key"], how)
    assert got.columns == want.columns and got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
