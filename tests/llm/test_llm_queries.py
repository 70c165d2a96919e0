"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from tests.conftest import SF
from turnmill.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cursor = db.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    want = {tuple(r[names.index(c)] for c in df.columns) for r in cursor.fetchall()}
    got = df.collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_shares_add_up(spark):
    rows = queries.QUERIES["p7_shares"](spark, SF).collect()
    assert abs(sum(r["actual_share"] for r in rows) - 1) < 1e-9
