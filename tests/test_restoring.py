import re

from pyspark.sql import functions as F

from textloom.operators import privacy
from textloom.streaming.restoring import restore_arriving, restore_stored

MAPS = "doc_id long, token string, value string, type string"


def maps(spark, rows):
    return spark.createDataFrame(rows, MAPS)


ENTRIES = [(1, "T1", "a@b.com", "EMAIL"), (1, "T2", "2024-01-02", "DATE"), (4, "T1", "c@d.com", "EMAIL")]
REPLIES = [(1, "T2 and T1 and T10", "x"), (1, "T1", "x"), (2, "T1 lost", "x"), (3, "plain", "x"), (4, None, "x"), (None, "T1", "x"), (None, "p", "x")]


def test_states_and_repeated_maps(spark):
    replies = spark.createDataFrame(REPLIES, "doc_id long, text string, value string")
    done = restore_stored(replies, maps(spark, ENTRIES * 2))
    assert sorted(done.columns) == ["doc_id", "error", "state", "text", "value"]
    assert sorted(((r.doc_id, r.text, r.state, r.error) for r in done.collect()), key=repr) == sorted(
        [
            (1, "2024-01-02 and a@b.com and a@b.com0", "restored", None),
            (1, "a@b.com", "restored", None),
            (2, "T1 lost", "quarantine", "token map is missing"),
            (3, "plain", "restored", None),
            (4, None, "quarantine", "no text to restore"),
            (None, "T1", "quarantine", "no key"),
            (None, "p", "quarantine", "no key"),
        ],
        key=repr,
    )
    assert restore_stored(replies.limit(0), maps(spark, ENTRIES)).count() == 0
    late = restore_stored(done.where("state = 'quarantine'"), maps(spark, [*ENTRIES, (2, "T1", "found", "NAME")]))
    assert {(r.doc_id, r.text) for r in late.where("state = 'restored'").collect()} == {(2, "found lost")}


def test_stream_counts_every_file_once_and_sees_new_maps(spark, tmp_path):
    folder = {n: str(tmp_path / n) for n in ("replies", "maps", "out", "state")}

    def arrive(rows):
        spark.createDataFrame(rows, "doc_id long, text string").write.mode("append").parquet(folder["replies"])

    def run():
        query = restore_arriving(spark, folder["replies"], "doc_id long, text string", folder["maps"], folder["out"], folder["state"])
        query.awaitTermination()
        return sorted((r.doc_id, r.text, r.state) for r in spark.read.parquet(folder["out"]).collect())

    maps(spark, ENTRIES).write.parquet(folder["maps"])
    arrive([(1, "T1"), (2, "T1")])
    first = [(1, "a@b.com", "restored"), (2, "T1", "quarantine")]
    assert run() == first and run() == first
    maps(spark, [(2, "T1", "e@f.com", "EMAIL")]).write.mode("append").parquet(folder["maps"])
    arrive([(2, "T1 again"), (4, "T1")])
    assert run() == sorted([*first, (2, "e@f.com again", "restored"), (4, "c@d.com", "restored")])


def test_texts_without_spans_do_not_move(spark, tmp_path):
    rows = [(i, f"mail{i}@b.com in {i}" if i % 50 == 0 else f"text {i}", "k") for i in range(1_000)] + [(None, "x", "k"), (5, "text 5", "k")]
    spark.createDataFrame(rows, "doc_id long, text string, type string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    spans = privacy.detect_spans(docs).drop("value")
    want = {(r.doc_id, r.text, len(r.token_map)) for r in privacy.tokenize(docs).collect()}
    for bits in (1 << 26, 1 << 15):
        done = privacy.tokenize_spans(docs, spans, filter_bits=bits)
        assert done.columns == ["doc_id", "text", "type", "token_map"]
        found = done.collect()
        assert {(r.doc_id, r.text, len(r.token_map)) for r in found} == want and len(found) == len(rows)
    # The branch of texts without spans has no exchange but the one of the filter, and few rows pass the other.
    plan = done._jdf.queryExecution().executedPlan().toString()
    still = plan[plan.rindex("NOT coalesce") :] if "NOT coalesce" in plan else plan[plan.rindex("Union") :]
    assert re.search("BroadcastHashJoin", still)
    flagged = privacy._flag_listed(docs, spans, "doc_id", 1 << 26)
    assert flagged.where("_listed").count() <= 21
    assert flagged.where(F.col("_listed") & F.col("text").contains("@")).count() == 20
    assert privacy.tokenize_spans(docs, spans.limit(0)).count() == len(rows)
