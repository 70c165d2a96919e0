"""Typed predicate trees compiled to Columns.

A node is {"and": [...]}, {"or": [...]}, {"not": node} or {"field": f, "op": o, "value": v}. The grammar is
closed: fields come from a registry, operators from OPS, and bounds are checked before anything is planned.
Catalyst sees plain Column expressions, so everything that can be pushed into the scan is.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, MAX_LEAVES, MAX_VALUES = 8, 64, 64
OPS = ("eq", "ne", "lt", "lte", "gt", "gte", "in", "not-in", "exists", "between", "prefix", "contains", "match")


class InvalidQuery(ValueError):
    """A request that can't be planned."""


def leaves(node: Any, depth: int = 1) -> list[dict]:
    """All leaves of a tree; raises InvalidQuery if it isn't one."""
    if depth > MAX_DEPTH:
        raise InvalidQuery(f"deeper than {MAX_DEPTH}")
    if not isinstance(node, Mapping):
        raise InvalidQuery("a node is an object")
    if set(node) in ({"and"}, {"or"}):
        (children,) = node.values()
        if not isinstance(children, list) or not children:
            raise InvalidQuery("and/or need a nonempty list")
        return [leaf for child in children for leaf in leaves(child, depth + 1)]
    if set(node) == {"not"}:
        return leaves(node["not"], depth + 1)
    if not {"field", "op"} <= set(node) <= {"field", "op", "value"} or node["op"] not in OPS:
        raise InvalidQuery(f"not a predicate: {dict(node)}")
    op, value = node["op"], node.get("value")
    if op == "exists":
        if value is not None:
            raise InvalidQuery("exists takes no value")
    elif op in ("in", "not-in"):
        if not isinstance(value, list) or not 1 <= len(value) <= MAX_VALUES or any(not isinstance(v, str) for v in value):
            raise InvalidQuery(f"{op} takes 1 to {MAX_VALUES} strings")
    elif op == "between":
        if not isinstance(value, list) or len(value) != 2:
            raise InvalidQuery("between takes two bounds")
    elif not isinstance(value, (str, int)) or isinstance(value, bool):
        raise InvalidQuery(f"{op} takes a string or an integer")
    return [dict(node)]


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf_column(column: Column, op: str, value: Any, case_sensitive: bool = False) -> Column:
    """One comparison. Null on either side is unknown and never matches; bounds of between are half-open; prefix and
    contains take their value literally and fold ASCII case unless told otherwise."""
    if op in ("prefix", "contains"):
        fold = (lambda c: c) if case_sensitive else _ascii_lower
        text, part = fold(column), fold(F.lit(value))
        return F.startswith(text, part) if op == "prefix" else F.contains(text, part)
    simple = {
        "eq": lambda: column == value, "ne": lambda: column != value, "lt": lambda: column < value, "lte": lambda: column <= value, "gt": lambda: column > value, "gte": lambda: column >= value,
        "in": lambda: column.isin(value), "not-in": lambda: ~column.isin(value), "exists": column.isNotNull, "between": lambda: (column >= value[0]) & (column < value[1]),
    }
    return simple[op]()


def compile_predicate(node: Any, fields: Mapping[str, Column], case_sensitive: bool = False) -> Column:
    """The Column of a tree. NOT keeps three-valued logic: what is unknown stays out."""
    for leaf in leaves(node):
        if leaf["op"] == "match":
            raise InvalidQuery("match is planned as a semi-join, not as a column")
        if leaf["field"] not in fields:
            raise InvalidQuery(f"unknown field {leaf['field']}")

    def build(n: Mapping[str, Any]) -> Column:
        if "and" in n:
            return reduce(and_, map(build, n["and"]))
        if "or" in n:
            return reduce(or_, map(build, n["or"]))
        if "not" in n:
            return ~build(n["not"])
        return leaf_column(fields[n["field"]], n["op"], n.get("value"), case_sensitive)

    return build(node)


def guarantees(node: Any, field: str) -> bool:
    """Whether every match of the tree is limited to given values of a field: any branch of an AND, all of an OR, never under NOT."""
    if "and" in node:
        return any(guarantees(n, field) for n in node["and"])
    if "or" in node:
        return all(guarantees(n, field) for n in node["or"])
    return node.get("field") == field and node.get("op") in ("eq", "in")
