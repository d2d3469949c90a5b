from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(frame):
    """Rows as sorted lists of comparable text, columns by name."""
    import pandas as pd

    def one(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v or v is pd.NA:
            return ""
        if isinstance(v, bool):
            return str(v)
        return f"{float(v):.9g}" if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted([one(v) for v in row] for row in frame[columns].astype(object).itertuples(index=False, name=None))
