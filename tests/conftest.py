import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillstone.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def texts(spark):
    """Applies a Column function to a list of texts, in order."""
    def run(column, values):
        df = spark.createDataFrame(list(enumerate(values)), "i int, text string")
        return [r[0] for r in df.orderBy("i").select(column(F.col("text")).alias("v")).collect()]
    return run


@pytest.fixture(scope="session")
def plan():
    def run(df):
        return df._jdf.queryExecution().executedPlan().toString()
    return run
