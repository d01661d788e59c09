"""Every catalog query with SQL gives DuckDB's rows on the smallest data."""

import math
import os

import duckdb
import pytest

from leafmill.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    found = got.collect()
    assert found or name in ("render_findings", "missing_spans")
    if name in catalog.ORACLES:
        want = duck.sql(catalog.ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(found, got.columns) == rows(want.fetchall(), want.columns)
