import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslab.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Values of a column expression over a list of texts."""
    from pyspark.sql import functions as F

    def run(rule, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        return [r[0] for r in rows.orderBy("i").select(rule(F.col("text"))).collect()]

    return run
