import os
import sys
import tempfile

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
# Python workers import the package and the test modules too.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [os.path.dirname(HERE), HERE, *filter(None, [os.environ.get("PYTHONPATH")])]
)

from tagloom.session import build_session  # noqa: E402


# Started on import: test modules build column expressions at their top level.
SESSION = build_session(
    "tagloom-tests",
    **{
        "spark.master": "local[8]",
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tagloom-tests-"),
    },
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate an expression over a list of single values."""

    def run(expression, items, kind):
        df = spark.createDataFrame(list(enumerate(items)), f"i long, v {kind}")
        rows = df.select("i", expression.alias("r")).orderBy("i").collect()
        return [row["r"] for row in rows]

    return run
