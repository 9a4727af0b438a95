"""Every registered query over logs against its SQL, on the smallest tables."""

import duckdb
import pytest
from conftest import DATA

from petrilake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(rows):
    number = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(number(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name in registry.ORACLES:
        want = duck.sql(f"select {', '.join(columns)} from ({registry.ORACLES[name]})").fetchall()
        assert plain(rows) == plain(want)
    else:
        assert rows
