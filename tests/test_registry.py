"""The registered queries of the engine against their oracles on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from foldlog.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(value):
    return None if value is None or value != value else round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, name):
    found = registry.queries()[name](spark, SF)
    wanted = duck.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    own = sorted(repr([same(r[c]) for c in columns]) for r in found.collect())
    at = [wanted.columns.index(c) for c in columns]
    assert own == sorted(repr([same(r[i]) for i in at]) for r in wanted.fetchall())


def test_every_query_is_registered_once():
    assert set(registry.oracle_sql()) <= set(registry.queries()) <= set(__spark_entry__.queries())
