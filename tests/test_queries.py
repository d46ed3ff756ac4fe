"""Every registered query against its SQL on the small tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.verify import normal

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert normal(cur.fetchall(), names) == got


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["parcel_id", "date", "idx", "value"]
    assert df.count() > 0
