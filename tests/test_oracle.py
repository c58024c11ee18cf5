"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from vecstrata import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(tables):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")

    def run(text):
        c = con.execute(text)
        names = [d[0] for d in c.description]
        return sorted(repr(sorted(zip(names, r, strict=True))) for r in c.fetchall())

    return run


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_same_rows(spark, tables, sql, name):
    got = sorted(repr(sorted(r.asDict().items())) for r in Q.QUERIES[name](spark, tables).collect())
    assert got == sql(Q.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
