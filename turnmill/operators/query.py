"""Typed queries over resources: records with stable order and keyset pages, and exact aggregates."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators.predicate import InvalidQuery, compile_predicate, guarantees, leaves
from turnmill.operators.registry import REGISTRY, Resource

MAX_FIELDS, MAX_KEYS, MAX_METRICS, MAX_LIMIT = 64, 3, 8, 50
METRICS = ("count", "distinct-count", "sum", "min", "max", "average")


class BudgetExceeded(RuntimeError):
    """More candidates or groups than the budget; nothing is sampled or cut instead."""


def validate(request: Mapping[str, Any]) -> Resource:
    """The resource of a request; raises InvalidQuery with the reason if it can't be planned."""
    resource = REGISTRY.get(request.get("resource", ""))
    if resource is None:
        raise InvalidQuery(f"unknown resource {request.get('resource')}")
    where = request.get("where")
    if where is not None:
        allowed = resource.columns("F")
        for leaf in leaves(where):
            if leaf["field"] not in allowed and leaf["op"] != "match":
                raise InvalidQuery(f"{leaf['field']} can't be filtered")
    if resource.required and (where is None or not guarantees(where, resource.required)):
        raise InvalidQuery(f"{resource.name} needs {resource.required} by eq or in on every branch")
    shape = request.get("shape") or {}
    if shape.get("kind") == "records":
        names = shape.get("fields") or []
        if not 1 <= len(names) <= MAX_FIELDS or len(set(names)) != len(names) or not set(names) <= set(resource.columns("S")):
            raise InvalidQuery("fields must be unique and selectable")
        if shape.get("payloadMode", "inline") not in ("omit", "reference", "inline"):
            raise InvalidQuery("payloadMode is omit, reference or inline")
    elif shape.get("kind") == "aggregate":
        keys, metrics = shape.get("groupBy", []), shape.get("metrics") or []
        if len(keys) > MAX_KEYS or not 1 <= len(metrics) <= MAX_METRICS or not set(keys) <= set(resource.columns("G")):
            raise InvalidQuery("at most 3 group fields and 1 to 8 metrics")
        names = [m.get("name") for m in metrics]
        if len(set(names)) != len(names) or None in names:
            raise InvalidQuery("metrics need unique names")
        for m in metrics:
            if m.get("op") not in METRICS or (m["op"] == "count") != ("field" not in m):
                raise InvalidQuery(f"not a metric: {m}")
            if "field" in m and m["field"] not in resource.columns("#" if m["op"] in ("sum", "average") else "G"):
                raise InvalidQuery(f"{m['field']} has no {m['op']}")
    else:
        raise InvalidQuery("shape.kind is records or aggregate")
    if not 1 <= request.get("limit", MAX_LIMIT) <= MAX_LIMIT:
        raise InvalidQuery(f"limit is 1 to {MAX_LIMIT}")
    return resource


def public(name: str) -> str:
    return name.replace(".", "_")


def _payload(column: Column, mode: str) -> Column:
    """omit: null; reference: length and digest; inline: the text with both."""
    if mode == "omit":
        return F.lit(None).cast("string")
    raw = F.encode(column, "utf-8")
    parts = [F.octet_length(column).cast("bigint").alias("byteLength"), F.sha2(raw, 256).alias("sha256")]
    return F.when(column.isNotNull(), F.to_json(F.struct(*parts, *([column.alias("inline")] if mode == "inline" else []))))


def stable_order(resource: Resource) -> list[Column]:
    """Newest first, unknown times last, then the key."""
    return [F.col(resource.time).desc_nulls_last(), *(F.col(k).asc() for k in resource.key)]


def filtered(rows: DataFrame | Callable[[Column | None], DataFrame], request: Mapping[str, Any], matches: Callable[[DataFrame, dict], DataFrame] | None = None) -> DataFrame:
    """The rows that a request's predicate keeps. match leaves may stand at the top or under ANDs; each becomes a semi-join.

    rows may be a function of the predicate's Column, which then decides how early it is applied."""
    resource = validate(request)
    where = request.get("where")
    if where is None:
        return rows(None) if callable(rows) else rows
    texts = [n for n in ([where, *where["and"]] if "and" in where else [where]) if n.get("op") == "match"]
    rest = [n for n in (where["and"] if "and" in where else [where]) if n.get("op") != "match"]
    condition = compile_predicate({"and": rest}, resource.columns("F")) if rest else None
    if callable(rows):
        rows = rows(condition)
    elif condition is not None:
        rows = rows.where(condition)
    for leaf in texts:
        if matches is None:
            raise InvalidQuery("no text index")
        rows = matches(rows, leaf)
    return rows


def after_position(resource: Resource, position: Mapping[str, Any]) -> Column:
    """Rows behind a position of the stable order: position has the time and the key columns of the last row seen."""
    time, at = F.col(resource.time), position[resource.time]
    tail, same = F.lit(False), F.lit(True)
    for k in resource.key:
        tail = tail | (same & (F.col(k) > F.lit(position[k])))
        same = same & (F.col(k) == F.lit(position[k]))
    if at is None:
        return time.isNull() & tail
    return (time < F.lit(at)) | time.isNull() | ((time == F.lit(at)) & tail)


def records(rows: DataFrame | Callable, request: Mapping[str, Any], position: Mapping[str, Any] | None = None, matches: Callable | None = None) -> DataFrame:
    """A page of records in stable order. Payloads are made only for the rows of the page."""
    resource = validate(request)
    shape, limit = request["shape"], request.get("limit", MAX_LIMIT)
    page = filtered(rows, request, matches)
    if position is not None:
        page = page.where(after_position(resource, position))
    page = page.orderBy(*stable_order(resource)).limit(limit)
    mode = shape.get("payloadMode", "inline")
    columns = resource.columns("S")
    return page.select(*(_payload(columns[f], mode).alias(public(f)) if f in resource.payloads else columns[f].alias(public(f)) for f in shape["fields"]))


def probed(rows: DataFrame | Callable, request: Mapping[str, Any], position: Mapping[str, Any] | None = None, matches: Callable | None = None) -> DataFrame:
    """records() with `more`: whether rows follow the page. One row more than asked for is read to tell."""
    resource = validate(request)
    limit = request.get("limit", MAX_LIMIT)
    page = filtered(rows, request, matches)
    if position is not None:
        page = page.where(after_position(resource, position))
    page = page.orderBy(*stable_order(resource)).limit(limit + 1)
    numbered = page.withColumn("_n", F.row_number().over(Window.orderBy(*stable_order(resource))))  # over limit + 1 rows
    numbered = numbered.withColumn("more", (F.max("_n").over(Window.partitionBy(F.lit(1))) > limit).cast("int")).where(F.col("_n") <= limit)
    columns, mode = resource.columns("S"), request["shape"].get("payloadMode", "inline")
    return numbered.select(*(_payload(columns[f], mode).alias(public(f)) if f in resource.payloads else columns[f].alias(public(f)) for f in request["shape"]["fields"]), "more")


def exact_count(rows: DataFrame | Callable, request: Mapping[str, Any], matches: Callable | None = None) -> DataFrame:
    """One row `n`: how many rows the predicate of a request keeps, whatever its page."""
    return filtered(rows, request, matches).agg(F.count(F.lit(1)).alias("n"))


def newest(rows: DataFrame, at: str, key: list[str], window: tuple[int, int], most: int = 10_000, days: int = 366) -> DataFrame:
    """All rows with at in [after, before), newest first, ties by key: complete or not at all. A window of more than `days` days, or more than `most`
    rows in it, raises BudgetExceeded; a page of a complete order never hides newer rows that weren't looked at."""
    after, before = window
    if not after < before <= after + days * 86_400_000_000:
        raise BudgetExceeded(f"a window of at most {days} days")
    kept = rows.where((F.col(at) >= after) & (F.col(at) < before))
    if kept.limit(most + 1).count() > most:
        raise BudgetExceeded(f"more than {most} matches")
    return kept.orderBy(F.desc(at), *key)


def visible(rows: DataFrame, hidden: DataFrame, session: str = "sessionKey", visibility: str | None = None) -> DataFrame:
    """Rows of sessions that aren't hidden (purged or excluded), and of those only the active ones where they have a visibility. Rows without session stay."""
    kept = rows if visibility is None else rows.where(F.col(visibility) == "active")
    return kept.join(hidden.select(session).distinct(), session, "left_anti")


#: What search and analyses can be narrowed by: the column, and how it is compared.
FILTERS = {"providers": "provider", "projectKeys": "projectKey", "sessionKeys": "sessionKey", "capabilityKeys": "capabilityKey", "turnKeys": "turnKey", "eventKinds": "kind"}


def validate_filters(filters: Mapping[str, Any], allowed: set[str] | None = None, most: int = 64) -> None:
    """Raises InvalidQuery unless filters are lists of 1 to `most` strings, sorted and without repeats, and a window [after, before) of integers."""
    for name, value in filters.items():
        if name not in (FILTERS.keys() | {"window"}) or (allowed is not None and name not in allowed):
            raise InvalidQuery(f"{name} is no filter here")
        if name == "window":
            if not isinstance(value, list) or len(value) != 2 or any(isinstance(v, bool) or not isinstance(v, int) for v in value) or value[0] >= value[1]:
                raise InvalidQuery("window is [after, before)")
        elif not isinstance(value, list) or not 1 <= len(value) <= most or any(not isinstance(v, str) for v in value) or value != sorted(set(value)):
            raise InvalidQuery(f"{name} takes 1 to {most} strings, sorted and without repeats")


def narrowed(rows: DataFrame, filters: Mapping[str, Any], allowed: set[str] | None = None, at: str = "observedAt") -> DataFrame:
    """Rows that all filters keep; null values are kept by none."""
    validate_filters(filters, allowed)
    for name, value in filters.items():
        if name == "window":
            rows = rows.where((F.col(at) >= value[0]) & (F.col(at) < value[1]))
        else:
            rows = rows.where(F.col(FILTERS[name]).isin(value))
    return rows


def _metric(m: Mapping[str, Any], columns: Mapping[str, Column]) -> Column:
    c = columns.get(m.get("field", ""))
    exact = lambda: F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    return {
        "count": lambda: F.count(F.lit(1)), "distinct-count": lambda: F.count_distinct(c), "sum": exact, "min": lambda: F.min(c), "max": lambda: F.max(c),
        "average": lambda: F.when(F.count(c) > 0, F.struct(exact().alias("sum"), F.count(c).alias("count"))),
    }[m["op"]]().alias(m["name"])


def aggregate(rows: DataFrame | Callable, request: Mapping[str, Any], max_groups: int | None = None, max_candidates: int | None = None, matches: Callable | None = None, max_distinct: int | None = None) -> DataFrame:
    """Exact aggregates per group: sums in decimals (empty: 0), averages as sum and count (none: null), nulls ignored.

    Ordered by one metric if the request names one, missing values first as the least, then by all keys with null keys first. Budgets
    count with one extra job and raise BudgetExceeded; they never sample."""
    resource = validate(request)
    shape = request["shape"]
    kept = filtered(rows, request, matches)
    if max_candidates is not None and kept.limit(max_candidates + 1).count() > max_candidates:
        raise BudgetExceeded(f"more than {max_candidates} candidates")
    columns = resource.columns("G") | resource.columns("#")
    keys = [columns[k].alias(public(k)) for k in shape.get("groupBy", [])]
    for m in shape["metrics"] if max_distinct is not None else ():
        if m["op"] == "distinct-count" and kept.select(*keys, columns[m["field"]]).distinct().limit(max_distinct + 1).count() > max_distinct:
            raise BudgetExceeded(f"more than {max_distinct} distinct values of {m['field']}")
    out = kept.groupBy(*keys).agg(*(_metric(m, columns) for m in shape["metrics"]))
    if max_groups is not None and out.limit(max_groups + 1).count() > max_groups:
        raise BudgetExceeded(f"more than {max_groups} groups")
    order = []
    if by := shape.get("orderBy"):
        kind = next(m["op"] for m in shape["metrics"] if m["name"] == by["metric"])
        value = F.col(by["metric"])
        if kind == "average":  # as exact as 38 digits are
            value = F.col(f"{by['metric']}.sum").cast("decimal(38,6)") / F.col(f"{by['metric']}.count")
        order.append(value.desc_nulls_last() if by.get("direction", "desc") == "desc" else value.asc_nulls_first())
    order += [F.col(public(k)).asc_nulls_first() for k in shape.get("groupBy", [])]
    out = out.orderBy(*order) if order else out
    if shape.get("offset"):
        out = out.offset(shape["offset"])
    return out.limit(request["limit"]) if "limit" in request else out


def digest(request: Mapping[str, Any]) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in request.items() if k != "cursor"}, sort_keys=True).encode()).hexdigest()


def seal_cursor(request: Mapping[str, Any], snapshot: str, position: Mapping[str, Any], secret: bytes) -> str:
    """An opaque page token, bound to the request and the snapshot it was read from."""
    body = json.dumps({"d": digest(request), "s": snapshot, "p": dict(position)}, sort_keys=True).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, body, hashlib.sha256).digest() + body).decode()


def open_cursor(token: str, request: Mapping[str, Any], snapshot: str, secret: bytes) -> dict[str, Any]:
    raw = base64.urlsafe_b64decode(token)
    mac, body = raw[:32], raw[32:]
    if not hmac.compare_digest(mac, hmac.new(secret, body, hashlib.sha256).digest()):
        raise InvalidQuery("cursor was changed")
    held = json.loads(body)
    if held["d"] != digest(request) or held["s"] != snapshot:
        raise InvalidQuery("cursor belongs to another request or snapshot")
    return held["p"]


#: Completeness of events, best first.
COMPLETENESS = ("full", "summary", "unloaded", "truncated", "unavailable")


def coverage(rows: DataFrame) -> DataFrame:
    """One row on how complete the events that a query reads are."""
    missing = {"observedAt": "missingTime", "turnKey": "missingTurn", "projectKey": "missingProject", "sessionKey": "missingSession"}
    return rows.agg(
        F.count(F.lit(1)).alias("events"), *(F.count_if(F.col("completeness") == k).alias(k) for k in COMPLETENESS),
        *(F.count_if(F.col(c).isNull()).alias(n) for c, n in missing.items()), F.count_distinct("sessionKey").alias("sessions"),
        F.coalesce(F.bool_or((F.col("completeness") != "full") | F.col("observedAt").isNull()), F.lit(False)).cast("int").alias("degraded"),
    )


def session_coverage(rows: DataFrame, sessions: DataFrame, hidden: DataFrame) -> DataFrame:
    """One row on the sessions of the events that a query reads: how many are known, unknown, hidden, and have only complete events."""
    own = rows.where("sessionKey is not null").groupBy("sessionKey").agg(F.bool_and(F.col("completeness") == "full").alias("_full"))
    one = own.join(sessions.select("sessionKey", F.lit(1).alias("_known")), "sessionKey", "left").join(hidden.select("sessionKey", F.lit(1).alias("_hidden")).distinct(), "sessionKey", "left")
    return one.agg(F.count(F.lit(1)).alias("sessions"), F.count("_known").alias("known"), F.count_if(F.col("_known").isNull()).alias("unknown"), F.count("_hidden").alias("hidden"), F.count_if("_full").alias("complete"))


def with_coverage(rows: DataFrame, result: DataFrame, label: str) -> DataFrame:
    """A result with the coverage of exactly the rows that it was made from beside it: provenance, events, degraded. label is recorded, derived or estimated.

    The coverage is one row, read as a scalar subquery."""
    if label not in ("recorded", "derived", "estimated"):
        raise InvalidQuery("provenance is recorded, derived or estimated")
    one = coverage(rows)
    return result.withColumns({"provenance": F.lit(label), "coverageEvents": one.select("events").scalar(), "degraded": one.select("degraded").scalar()})
