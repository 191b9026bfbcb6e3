"""One local session for all tests; the driver's small tables are the inputs."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tracelens.session import local_session

    session = local_session(cores=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def compare(spark, name, data=DATA):
    """A registered query against its SQL in DuckDB: columns and rows."""
    import math

    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    ours = entry.queries()[name](spark, data)
    theirs = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in theirs.description]

    def plain(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "null"
        return repr(round(float(value), 6)) if isinstance(value, (int, float)) and not isinstance(value, bool) or type(value).__name__ == "Decimal" else str(value)

    def rows(names, found):
        order = sorted(range(len(names)), key=lambda k: names[k])
        return sorted(tuple(plain(r[k]) for k in order) for r in found)

    assert sorted(columns) == sorted(ours.columns)
    assert rows(ours.columns, ours.collect()) == rows(columns, theirs.fetchall())
