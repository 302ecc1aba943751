"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from helixframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    with duckdb.connect() as con:
        for name in TABLES.split():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
        yield con


def settled(value):
    return f"{value:.9g}" if isinstance(value, float) and not math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(settled(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(settled(r[k]) for k in at) for r in found.fetchall())


def test_queries_without_sql(spark):
    """Their results are tested elsewhere; here they run over whole tables."""
    rest = registry.queries().keys() - registry.oracle_sql().keys()
    assert all(registry.queries()[name](spark, SF).count() > 0 for name in sorted(rest))
