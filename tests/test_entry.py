import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def core_queries():
    """Those with SQL; the subpackage's are compared in its own tests."""
    from wordloom.queries import ORACLE_SQL

    return sorted(ORACLE_SQL)


def same(a, b):
    """Rows in order, doubles to the last digits (rounded values may differ by one unit where sums were made in another order)."""
    return len(a) == len(b) and all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 1e-9 * max(1, abs(x))) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", core_queries())
def test_query_and_oracle_agree(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    rows = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key)
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=key)
    assert same(rows, expected)
