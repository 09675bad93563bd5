"""Every registered query against its SQL counterpart."""

import duckdb
import pytest

from graphloom.plans import catalog_domains, catalog_scale, catalog_sources, catalog_views  # noqa: F401
from graphloom.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name not in ORACLES:
        assert df.count() > 0
        return
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    key = str
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(cur.fetchall(), key=key)
