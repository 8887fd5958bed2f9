"""One local session for all tests; a checkpoint folder is left unset, as on a laptop."""

import os
import sys
from pathlib import Path

import pandas as pd
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from loomline.session import local_session

    session = local_session("tests", cpus=int(os.environ.get("TEST_CPUS", "4")))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime().replace(tzinfo=None)
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    return value.item() if hasattr(value, "item") else value


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted((repr(tuple(_plain(v) for v in row)) for row in frame[columns].astype(object).itertuples(index=False)))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL over the smallest tables."""

    def check(query, sql):
        got, want = query(spark, SMALL).toPandas(), duck.sql(sql).df()
        assert rows_of(got) == rows_of(want)

    return check
