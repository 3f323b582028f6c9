"""Every core query at the smallest scale, against DuckDB where it has SQL."""

import duckdb
import pytest

from layerloom import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def lines(frame, columns):
    cleaned = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(str, cleaned.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), duck.execute(core.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert lines(got, columns) == lines(want, columns)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_gives_rows(spark, name):
    assert core.QUERIES[name](spark, SF).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
