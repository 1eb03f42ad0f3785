"""Registered queries equal their oracle SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from labelwise.plans import registry

ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


# queries without SQL: the first two are compared with brute force in test_operators, the others only run
WITHOUT_SQL = {"phrase_window_score", "heal_vocabulary", "clean_documents", "extract_contact_documents"}
CORE = [n for n in QUERIES if n in registry.QUERIES]


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, sf, name):
    verdict, _ = check.compare(spark, con, sf, name, QUERIES[name], ORACLE.get(name))
    assert verdict.startswith("ok") or (name in WITHOUT_SQL and verdict.startswith("rows-only")), verdict
