import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("cellgrain-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Small text table from a header line and rows."""

    def make(columns, rows, schema=None):
        schema = schema or ", ".join(f"`{c}` string" for c in columns)
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return make


@pytest.fixture
def large_path(monkeypatch):
    """Force the paths that are meant for tables too large for one task."""
    from cellgrain.operators import ordering

    monkeypatch.setattr(ordering, "SINGLE_TASK_ROWS", 0)
    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", 40)
    monkeypatch.setattr(ordering, "WHOLE_KEY_ROWS", 50)
