"""Every graph query against its SQL, and the entry point."""

import duckdb
import pytest

import __spark_entry__
from edgeloom.plans.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    if name not in ORACLE_SQL:
        assert got.num_rows > 0
        return
    want = duck.sql(ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.schema.names) == sorted(want.schema.names)
    tidy = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in sorted(t.schema.names)], strict=True)))
    assert tidy(got) == tidy(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
