import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from textloom.session import local_session

    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate one expression over a list of texts, in order."""
    from pyspark.sql import functions as F

    def run(texts, expression):
        df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        rows = df.select("i", expression(F.col("text")).alias("v")).collect()
        return [r["v"] for r in sorted(rows, key=lambda r: r["i"])]

    return run
