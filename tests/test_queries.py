"""Every registered query against its SQL on the small tables, and the query language's rules."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from turnmill.operators import predicate, query
from turnmill.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*columns).collect()]
    if name not in catalog.SQL:
        assert got or name in ("t_path_families",)
        return
    cursor = db.execute(catalog.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    key = lambda r: tuple((v is None, v or "") for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_entry(spark):
    assert entry.entry(spark).columns == ["session_key", "turn_key", "delta_id", "revision"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_predicates_are_checked():
    leaf = {"field": "a", "op": "eq", "value": "x"}
    deep = leaf
    for _ in range(predicate.MAX_DEPTH):
        deep = {"not": deep}
    for bad in ({"and": []}, {"field": "a", "op": "like", "value": "x"}, {"field": "a", "op": "exists", "value": 1}, {"field": "a", "op": "in", "value": []}, {"field": "a", "op": "between", "value": ["x"]}, deep, 7):
        with pytest.raises(predicate.InvalidQuery):
            predicate.leaves(bad)
    edge = {"field": "repositoryKey", "op": "eq", "value": "r"}
    assert predicate.guarantees({"and": [leaf, edge]}, "repositoryKey") and not predicate.guarantees({"or": [leaf, edge]}, "repositoryKey") and not predicate.guarantees({"not": edge}, "repositoryKey")


def test_three_valued_logic_and_literal_patterns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("A%_\\b",), ("ab",), (None,)], "a string")
    kept = lambda n, **k: [r[0] for r in rows.where(predicate.compile_predicate(n, {"a": F.col("a")}, **k)).collect()]
    assert kept({"not": {"field": "a", "op": "eq", "value": "ab"}}) == ["A%_\\b"]
    assert kept({"field": "a", "op": "prefix", "value": "a%_"}) == ["A%_\\b"]
    assert kept({"field": "a", "op": "contains", "value": "a"}, case_sensitive=True) == ["ab"]
    assert kept({"field": "a", "op": "not-in", "value": ["x"]}) == ["A%_\\b", "ab"]


def test_requests_are_checked():
    base = {"resource": "event", "shape": {"kind": "records", "fields": ["eventKey"]}}
    query.validate(base)
    for bad in (
        base | {"resource": "x"}, base | {"limit": 51}, base | {"shape": {"kind": "records", "fields": []}}, base | {"shape": {"kind": "aggregate", "metrics": [{"name": "n", "op": "sum", "field": "turnKey"}]}},
        base | {"where": {"field": "tool.output", "op": "eq", "value": "x"}}, {"resource": "delivery-edge", "shape": {"kind": "records", "fields": ["fromKey"]}},
        {"resource": "session", "shape": {"kind": "records", "fields": ["sessionKey"]}, "where": {"field": "turnKey", "op": "eq", "value": "x"}},
    ):
        with pytest.raises(query.InvalidQuery):
            query.validate(bad)


def test_cursors_are_bound():
    request = {"resource": "event", "limit": 2}
    token = query.seal_cursor(request, "v1", {"eventKey": "k"}, b"s")
    assert query.open_cursor(token, request, "v1", b"s") == {"eventKey": "k"}
    for args in ((request | {"limit": 3}, "v1", b"s"), (request, "v2", b"s"), (request, "v1", b"t")):
        with pytest.raises(query.InvalidQuery):
            query.open_cursor(token, *args)


def test_budgets_reject(spark):
    rows = spark.createDataFrame([(str(i),) for i in range(9)], "provider string")
    request = {"resource": "event", "shape": {"kind": "aggregate", "groupBy": ["provider"], "metrics": [{"name": "n", "op": "count"}]}}
    assert query.aggregate(rows, request, max_groups=9, max_candidates=9).count() == 9
    for budget in ({"max_groups": 8}, {"max_candidates": 8}):
        with pytest.raises(query.BudgetExceeded):
            query.aggregate(rows, request, **budget)


def test_filters_and_columns_reach_the_scan(spark):
    from turnmill.sources import facts

    request = {"resource": "event", "where": {"field": "event.kind", "op": "eq", "value": "token-usage"}, "shape": {"kind": "records", "fields": ["eventKey", "event.kind"]}}
    plan = query.records(facts.source("event", spark, SF), request)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_kind,token-usage)" in plan.split("PushedFilters")[1].split("]")[0]
    assert "input_text" not in plan.split("ReadSchema")[1].split("\n")[0]
