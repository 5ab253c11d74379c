"""Every registered query of the engine itself against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def plain(rows):
    return sorted(tuple("~" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in row) for row in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    found = catalogue.QUERIES[name](spark, DIR)
    columns = sorted(found.columns)
    rows = [tuple(r) for r in found.select(*columns).collect()]
    if name in catalogue.ORACLE:
        truth = db.sql(catalogue.ORACLE[name]).df()
        assert sorted(truth.columns) == columns
        assert plain(rows) == plain(truth[columns].astype(object).itertuples(index=False))
    else:
        assert rows
