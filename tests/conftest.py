"""One small Spark session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def same(ours, theirs):
    """Do two pandas frames hold the same rows, whatever their order?"""
    import pandas as pd

    assert sorted(ours.columns) == sorted(theirs.columns)

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        shown = lambda v: "" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
        return sorted(tuple(shown(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else shown(v) for v in r) for r in df.itertuples(index=False))

    return rows(ours) == rows(theirs)
