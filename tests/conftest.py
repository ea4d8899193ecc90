import os
import tempfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def same(found: pd.DataFrame, expected: pd.DataFrame) -> None:
    """Equal rows in any order, columns by name; doubles to six places."""
    assert sorted(found.columns) == sorted(expected.columns)
    assert len(found) == len(expected)

    def plain(value):
        if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and value != value):
            return "~"
        if hasattr(value, "__len__") and not isinstance(value, str):
            return str([plain(v) for v in value])
        if isinstance(value, bool) or type(value).__name__ == "bool_":
            return str(bool(value))
        if isinstance(value, (int, float)) or hasattr(value, "dtype"):
            return f"{round(float(value), 6) + 0.0:.6f}"
        return str(value)

    def rows(frame):
        return sorted(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))

    assert rows(found) == rows(expected)
