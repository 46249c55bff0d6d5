import duckdb
import pytest

from babelshelf import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(row, order):
    return repr(tuple(float(row[i]) if type(row[i]).__name__ == "Decimal" else row[i] for i in order))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sf, oracle, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = sorted(plain(r, columns) for r in df.collect())
    if name not in catalog.ORACLES:
        assert found
        return
    want = oracle.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert found == sorted(plain(r, order) for r in want.fetchall())


def test_entry_is_early_stopping(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
