import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from plantwatch.session import build
    s = build("plantwatch-tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def tables(spark):
    from plantwatch.plans.tables import Tables
    return Tables(spark, SF)


def multiset(df):
    """Rows as a sorted list of texts, floats to nine digits."""
    def show(v):
        if isinstance(v, float):
            return f"{v:.9g}" if abs(v) > 1e-9 else "0"
        return repr(v)
    cols = sorted(df.columns)
    return sorted(tuple(show(r[c]) for c in cols) for r in df.collect())
