"""Day rollups: partial aggregates kept per day, merged when they are read.

Counts and sums of days add up. Distinct members don't, so their partial is the set of (day, group, member) itself and the merge counts it again:
the result is always that of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def day_counts(rows: DataFrame, keys: list[str], at: str, sums: list[str]) -> DataFrame:
    """(day, keys, n, per summed column its total and how many rows have it). Rows without time are in no day."""
    day = F.floor(F.col(at) / DAY_US).cast("bigint").alias("day")
    parts = [x for c in sums for x in (F.sum(F.col(c).cast("decimal(20,0)")).alias(f"{c}_sum"), F.count(c).alias(f"{c}_present"))]
    return rows.where(F.col(at).isNotNull()).groupBy(day, *keys).agg(F.count(F.lit(1)).alias("n"), *parts)


def day_members(rows: DataFrame, keys: list[str], at: str, member: str) -> DataFrame:
    """Distinct (day, keys, member)."""
    day = F.floor(F.col(at) / DAY_US).cast("bigint").alias("day")
    return rows.where(F.col(at).isNotNull() & F.col(member).isNotNull()).select(day, *keys, member).distinct()


def merged(counts: DataFrame, members: Mapping[str, DataFrame], keys: list[str], sums: list[str], days: tuple[int, int]) -> DataFrame:
    """(keys, n, totals, presence, distinct members) over the days [first, last). Groups are null-safe: a null key is a group."""
    inside = (F.col("day") >= days[0]) & (F.col("day") < days[1])
    parts = [x for c in sums for x in (F.coalesce(F.sum(f"{c}_sum"), F.lit(0)).cast("decimal(38,0)").alias(f"{c}_sum"), F.sum(f"{c}_present").alias(f"{c}_present"))]
    out = counts.where(inside).groupBy(*keys).agg(F.sum("n").alias("n"), *parts)
    for member, rows in members.items():
        if not keys:
            out = out.withColumn(f"{member}s", rows.where(inside).agg(F.count_distinct(member).alias("n")).scalar())
            continue
        distinct = rows.where(inside).groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(F.count_distinct(member).alias(f"{member}s"))
        joined = out.join(distinct, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*(f"_{k}" for k in keys))
        out = joined.withColumn(f"{member}s", F.coalesce(f"{member}s", F.lit(0)))
    return out


def serves(request: Mapping[str, Any], keys: Mapping[str, str], sums: Mapping[str, str]) -> tuple[int, int] | None:
    """The days [first, last) if a request can be answered from day_counts exactly: its groups are keys, its metrics counts and sums of rolled columns, and
    its only condition is a window of whole days. keys and sums: field -> column."""
    shape, where = request.get("shape", {}), request.get("where")
    if shape.get("kind") != "aggregate" or not set(shape.get("groupBy", [])) <= set(keys):
        return None
    if any(m["op"] not in ("count", "sum") or (m["op"] == "sum" and m["field"] not in sums) for m in shape["metrics"]):
        return None
    if not isinstance(where, Mapping) or where.get("field") != "observedAt" or where.get("op") != "between":
        return None
    after, before = where["value"]
    return (after // DAY_US, before // DAY_US) if after % DAY_US == before % DAY_US == 0 else None


def shortcut(request: Mapping[str, Any], counts: DataFrame, keys: Mapping[str, str], sums: Mapping[str, str]) -> DataFrame | None:
    """The answer of query.aggregate from day_counts, or None where serves() says no."""
    days = serves(request, keys, sums)
    if days is None:
        return None
    shape = request["shape"]
    columns = [F.sum("n").alias(m["name"]) if m["op"] == "count" else F.coalesce(F.sum(f"{sums[m['field']]}_sum"), F.lit(0)).cast("decimal(38,0)").alias(m["name"]) for m in shape["metrics"]]
    groups = [F.col(keys[k]).alias(k.replace(".", "_")) for k in shape.get("groupBy", [])]
    return counts.where((F.col("day") >= days[0]) & (F.col("day") < days[1])).groupBy(*groups).agg(*columns)
