"""Every registered spatial query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from lodestrata.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return c


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr([None if v != v else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in r]) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, D).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())


def test_entry_without_a_session_lists_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
