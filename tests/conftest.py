import decimal
import math
import os
import sys

import numpy as np
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    """A value in a form that both engines share."""
    import pandas as pd

    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool) or type(value).__name__ in ("bool", "bool_"):
        return bool(value)
    if hasattr(value, "isoformat"):
        return str(pd.Timestamp(value))
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        return int(value) if float(value).is_integer() and abs(value) < 2**53 else float(value)
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    return value if isinstance(value, str) else str(value)


def alike(a, b):
    """Equal, or floats that differ by rounding only."""
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return type(a) is type(b) and a == b


def same(spark_df, result):
    """All values alike, row by row; integers, texts and times exactly. ``result`` is a DuckDB result or a frame."""
    if hasattr(result, "fetchall"):
        names = [d[0] for d in result.description]
        rows = result.fetchall()
    else:
        names, rows = list(result.columns), list(result.astype(object).itertuples(index=False, name=None))
    columns = sorted(spark_df.columns)
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    key = lambda r: tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r)
    got = [tuple(plain(v) for v in r) for r in map(tuple, spark_df.select(*(f"`{c}`" for c in columns)).collect())]
    want = [tuple(plain(r[i]) for i in at) for r in rows]
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert all(map(alike, a, b)), (a, b)
