import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="palimpsest-test-"), "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="palimpsest-test-"),
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def oracle(small):
    """Runs SQL over the small tables in DuckDB."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con


def rows_of(frame, columns):
    """Rows of a pandas frame as sorted tuples that compare across engines."""
    import pandas as pd

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "-"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else f"{v:.8g}"
        return str(v)

    return sorted(tuple(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    """Asserts that a Spark result and a DuckDB result hold the same rows."""

    def check(got, want):
        got, want = got.toPandas(), want.df()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        assert rows_of(got, columns) == rows_of(want, columns)

    return check
