"""Time the headline queries; prints one JSON line.

Every query runs once to warm up and then three times; the median counts. Results go to a
no-op sink, so all rows are computed and none is collected. The tables are first rewritten in as many
files as there are cores, as tables of a cluster are: a table in one file of one row group has one split.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from textloom.checks.queries import QUERIES
from textloom.session import local_session

HEADLINE = (
    "html_text", "pii_spans", "pii_tokenized", "pii_roundtrip", "org_anonymized", "chunks", "doc_sentiment",
    "chunk_key_phrases", "doc_insights", "prompt_default", "request_bodies", "model_answers",
    "extractive_summary", "chat_requests", "chat_full", "line_rebuild", "sheet_text", "glossary_placed",
)


def in_files(spark, sf_dir: str, files: int) -> str:
    folder = tempfile.mkdtemp(prefix="bench-")
    for table in sorted(Path(sf_dir).glob("*.parquet")):
        spark.read.parquet(str(table)).repartition(files).write.parquet(f"{folder}/{table.name}")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = sys.argv[1:] or list(HEADLINE)
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    folder = in_files(spark, sf_dir, int(cpus))
    seconds = {}
    for name in names:
        times = []
        for _ in range(4):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
