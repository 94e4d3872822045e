import os
import sys

import pytest
from hard_rows import HARD

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, run int, kept string, n int, word string"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def table(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), with extra columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None, "x", 7, None, 3, "w") for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def hard(table):
    return table(HARD)


@pytest.fixture(scope="session")
def empty(table):
    return table([])
