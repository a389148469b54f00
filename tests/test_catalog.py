"""Every query that has SQL gives the SQL's rows at the smallest scale; the others give rows."""

from pathlib import Path

import duckdb
import pytest

from sievemill.plans.catalog import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def ordered(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(tidy(r[i]) for i in at) for r in rows), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, str(DATA))
    want = sql.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    assert ordered(df.collect(), df.columns) == ordered(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, str(DATA))
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
