"""Windows over ordered events. Partitions are entities; where an order is global it is cut into buckets first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Width of a stretch of an order whose first column is a byte offset: rows of one stretch and entity are one window partition.
STRETCH = 1 << 20


def numbered(rows: DataFrame, entity: list[str], order: list[str], size: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """rows with `row_no` (from 1) and `row_count` of each entity in order and, if a size column is named, `end_size`, the sum of it up to and with the row.

    The first order column is a number; an entity is cut into stretches of `stretch` of it, each a window partition, so the entity with most of the rows is many tasks. What a
    stretch begins with comes from one row a stretch. Null order values come first; null entities are entities; null sizes count 0."""
    cut_at = rows.withColumn("_b", F.coalesce(F.floor(F.col(order[0]) / stretch), F.lit(-(2**62))))
    keys = [F.col(k) for k in entity]
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    grow = inside.rowsBetween(Window.unboundedPreceding, 0)
    amount = F.coalesce(F.col(size).cast("bigint"), F.lit(0)) if size else F.lit(0)
    own = cut_at.withColumn("_n", F.row_number().over(inside))
    if size:
        own = own.withColumn("_s", F.sum(amount).over(grow))
    ends = cut_at.groupBy(*(F.col(k).alias(f"_e{i}") for i, k in enumerate(entity)), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_k"), F.sum(amount).alias("_a"))
    names = [f"_e{i}" for i in range(len(entity))]
    before = Window.partitionBy(*names).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*names, "_c", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_k0"), F.coalesce(F.sum("_a").over(before), F.lit(0)).alias("_a0"), F.sum("_k").over(Window.partitionBy(*names)).alias("row_count"))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(entity, names, strict=True)] + [F.col("_b") == F.col("_c")]
    out = own.join(carry, on).withColumn("row_no", F.col("_n") + F.col("_k0"))
    if size:
        out = out.withColumn("end_size", F.col("_s") + F.col("_a0"))
    return out.select(*rows.columns, "row_no", "row_count", *(["end_size"] if size else []))


def top_k(rows: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows per group with their rank. Catalyst turns the filter on row_number into a group limit before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def retries(uses: DataFrame, scope: list[str], order: list[str], failed: list[str]) -> DataFrame:
    """(scope..., failed_count, same_input_repeat_count, retry_after_failure_count) per scope and capability.

    A use repeats if an earlier one in scope has the same capability and input fingerprint, and is a retry if the one just before it is in `failed`.
    Uses without fingerprint never repeat and take no part in the window."""
    line = Window.partitionBy(*scope, "capabilityKey", "inputFingerprint").orderBy(*order)
    known = uses.where("inputFingerprint is not null").withColumn("before", F.lag("terminalState").over(line))
    lone = uses.where("inputFingerprint is null").withColumn("before", F.lit(None).cast("string"))
    return known.unionByName(lone).groupBy(*scope, "capabilityKey").agg(
        F.count_if(F.col("terminalState") == "failed").alias("failed_count"), F.count_if(F.col("before").isNotNull()).alias("same_input_repeat_count"), F.count_if(F.col("before").isin(failed)).alias("retry_after_failure_count")
    )


def context_switches(rows: DataFrame, at: str, key: str, value: str, bucket_us: int = 3_600_000_000) -> DataFrame:
    """rows with `switched` = 1 where value differs from the last non-null value before it in the global order (at, key).

    The order is cut into time buckets that are worked on apart; what a bucket begins with comes from a second window over one row a
    bucket. Rows without time come first, in a bucket of their own; rows without a value never switch."""
    cut = F.coalesce(F.floor(F.col(at) / bucket_us), F.lit(-(2**60))).alias("_b")
    placed = rows.select("*", cut)
    inside = Window.partitionBy("_b").orderBy(F.col(at).asc_nulls_first(), key)
    ends = placed.where(F.col(value).isNotNull()).groupBy("_b").agg(F.max_by(value, F.struct(at, key)).alias("_last"))
    carried = ends.withColumn("_carry", F.lag("_last").over(Window.orderBy("_b"))).drop("_last")  # one row a bucket
    before = F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    out = placed.withColumn("_before", before).join(carried, "_b", "left")
    previous = F.coalesce("_before", "_carry")
    return out.withColumn("switched", F.coalesce((F.col(value) != previous).cast("int"), F.lit(0))).drop("_b", "_before", "_carry")


def run_lengths(rows: DataFrame, entity: str, order: list[str], value: str, stretch: int = STRETCH) -> DataFrame:
    """(entity, run_no, value, length): consecutive equal values as runs, numbered from 0; nulls are equal to each other.

    Entities are worked on in stretches of the order (see numbered); each gives its runs, and a run that a stretch ends with goes on in the next if the values are equal."""
    cut_at = rows.select(entity, value, *[c for c in order if c not in (entity, value)]).withColumn("_b", F.coalesce(F.floor(F.col(order[0]) / stretch), F.lit(-(2**62))))
    line = Window.partitionBy(entity, "_b").orderBy(*order)
    starts = F.when(F.row_number().over(line) == 1, 0).otherwise((~F.lag(value).over(line).eqNullSafe(F.col(value))).cast("int"))
    local = cut_at.select(entity, "_b", value, starts.alias("_s"), *[c for c in order if c not in (entity, value)]).withColumn("_r", F.sum("_s").over(line))
    runs = local.groupBy(entity, "_b", "_r", value).agg(F.count(F.lit(1)).alias("_n"))
    # one row a stretch: its first and last value, and how many runs it has
    ends = runs.groupBy(entity, "_b").agg(F.min_by(F.struct(value), "_r").alias("_first"), F.max_by(F.struct(value), "_r").alias("_last"), F.max("_r").alias("_m"))
    along = Window.partitionBy(entity).orderBy("_b")
    goes_on = F.coalesce(F.lag("_last").over(along)[value].eqNullSafe(F.col("_first")[value]) & (F.row_number().over(along) > 1), F.lit(False))
    ends = ends.withColumn("_on", goes_on.cast("int"))
    # a stretch of m + 1 runs adds m + 1 numbers, one less where its first run goes on
    first = F.sum(F.col("_m") + 1 - F.col("_on")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    carry = ends.select(F.col(entity).alias("_e"), F.col("_b").alias("_c"), (F.coalesce(first, F.lit(0)) - F.col("_on")).alias("_k0"))
    placed = runs.join(carry, F.col(entity).eqNullSafe(F.col("_e")) & (F.col("_b") == F.col("_c")))
    return placed.groupBy(entity, (F.col("_r") + F.col("_k0")).cast("bigint").alias("run_no"), value).agg(F.sum("_n").alias("length"))


def length_bucket(length: Column) -> Column:
    return F.when(length == 1, "1").when(length <= 3, "2-3").otherwise("4+")


def bigrams(runs: DataFrame, entity: str, order: str, node: str) -> DataFrame:
    """(entity, first, second): neighbouring nodes of each entity."""
    line = Window.partitionBy(entity).orderBy(order)
    return runs.select(entity, F.col(node).alias("first"), F.lead(node).over(line).alias("second")).where("second is not null")


def overlaps(rows: DataFrame, group: str, start: str, end: str, key: str) -> DataFrame:
    """rows with `overlaps` = 1 where an interval begins no later than an earlier one of its group ends; intervals without bounds are out."""
    line = Window.partitionBy(group).orderBy(start, key).rowsBetween(Window.unboundedPreceding, -1)
    known = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull() & F.col(group).isNotNull())
    return known.withColumn("overlaps", F.coalesce((F.max(end).over(line) >= F.col(start)).cast("int"), F.lit(0)))


def packed(rows: DataFrame, entity: str, order: list[str], size: str, limit: int) -> DataFrame:
    """rows with `chunk_no`: whole rows packed greedily, in order, into chunks of at most `limit`; a larger row is a chunk of its own.

    Greedy packing depends on all rows before, so each entity is read in order, but as a stream: only the fill of the open chunk is held."""
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk_no", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, fill, any_yet = None, 0, 0, False
        for batch in batches:
            out = []
            for who, n in zip(batch.column(batch.schema.get_field_index(entity)).to_pylist(), batch.column(batch.schema.get_field_index(size)).to_pylist(), strict=True):
                n = n or 0
                if not any_yet or who != now:
                    now, chunk, fill, any_yet = who, 0, n, True
                elif fill + n > limit:
                    chunk, fill = chunk + 1, n
                else:
                    fill += n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "chunk_no"])

    return rows.repartition(entity).sortWithinPartitions(entity, *order).mapInArrow(run, schema)
