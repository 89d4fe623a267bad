"""One small session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config(map={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    """A value that is equal for equal results of the two engines."""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def bag(columns: list[str], rows) -> Counter:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="session")
def agree(spark, sf):
    """Runs a query and its SQL over the same tables; both must give the same columns and rows."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")

    def check(query, sql: str) -> None:
        df = query(spark, sf)
        got = con.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(df.columns) == sorted(names)
        mine, theirs = bag(df.columns, df.collect()), bag(names, got.fetchall())
        assert mine == theirs, f"only here: {list((mine - theirs).items())[:3]}; only in SQL: {list((theirs - mine).items())[:3]}"

    return check
