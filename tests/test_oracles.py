"""Every query that SQL can express equals DuckDB on the smallest tables."""

import duckdb
import pytest

from cartosea.plans import registry

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _plain(v):
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_duckdb(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    rel = con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    want = sorted(tuple(_plain(r[cols.index(c)]) for c in names) for r in rel.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
