"""Joins with a meaning beyond equality, each as one shuffle on its keys where that is enough."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.session import cut

#: Rows of a relation given as values by a caller.
MAX_VALUES = 10_000
#: Left and right sets of one task at most, about, and bytes of its bitmaps; see unique_overlap.
LEFT_SETS, RIGHT_SETS, BITMAPS = 65_536, 131_072, 1 << 27


def first_by(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The payload of the first row per key: the correlated top-1 lookup as one aggregate, combined before the shuffle.

    Null order values come first; equal orders are decided by the payload."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *payload)).alias("_f")).select(*keys, *(F.col(f"_f.{p}").alias(p) for p in payload))


def next_later(rows: DataFrame, chain: list[str], order: list[str], wanted: Column, payload: Column, name: str) -> DataFrame:
    """Adds the payload of the next row behind each one in its chain for which wanted holds; null if none.

    Strictly behind in the lexicographic order of `order`, which must be unique in a chain. The chain is read backwards, so the
    frame only grows and long chains stay linear."""
    back = Window.partitionBy(*chain).orderBy(*(F.col(c).desc_nulls_last() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(F.when(wanted, payload), ignorenulls=True).over(back))


def co_occurrence(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(item, other, groups): in how many groups two different items occur together, both ways round.

    Items are made distinct per group first, so a group of n rows gives no more pairs than its few distinct items; null items and groups are out."""
    one = rows.where(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(group).agg(F.collect_set(item).alias("_items"))
    left = one.select(F.explode("_items").alias(item), "_items")
    pairs = left.select(item, F.explode("_items").alias("other")).where(F.col(item) != F.col("other"))
    return pairs.groupBy(item, "other").agg(F.count(F.lit(1)).alias("groups"))


def prefix_unique(prefixes: DataFrame, scope: str, prefix: str, ids: DataFrame, id_column: str, shortest: int = 7, longest: int = 39) -> DataFrame:
    """prefixes with the one id of the same scope that starts with them; ambiguous and unknown prefixes are out.

    The range-like condition becomes equality: ids give the prefixes of just the lengths that are asked for."""
    asked = prefixes.where(F.length(prefix).between(shortest, longest)).select(scope, prefix).distinct()
    lengths = asked.groupBy(scope).agg(F.collect_set(F.length(prefix)).alias("_lengths"))
    cut = ids.select(scope, id_column).distinct().join(lengths, scope).select(scope, id_column, F.explode("_lengths").alias("_n"))
    cut = cut.withColumn(prefix, F.expr(f"left({id_column}, _n)"))
    hits = cut.join(asked, [scope, prefix], "left_semi").groupBy(scope, prefix).agg(F.count(F.lit(1)).alias("_k"), F.min(id_column).alias(id_column))
    return prefixes.join(hits.where("_k = 1").drop("_k"), [scope, prefix])


def beside(points: DataFrame, marks: DataFrame, keys: list[str], at: str, payload: list[str], bucket_us: int = 86_400_000_000) -> DataFrame:
    """marks with `_last` and `_next`: the points of equal keys that stand at or before each mark and behind it, as struct(at, payload...); null if none.

    points: keys, at and payload; marks: keys, at and other columns. Of points at one time the least payload is taken. No pairs are made: points and marks lie in
    one order, which is cut into buckets of time, so a key with most of the rows is many tasks; what a bucket begins and ends with comes from one row a bucket."""
    own = [c for c in marks.columns if c not in keys and c != at]
    point = points.where(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.min(F.struct(*payload)).alias("_p")).select(*keys, at, F.struct(F.col(at), *(F.col(f"_p.{c}").alias(c) for c in payload)).alias("_point"))
    rows = point.withColumns({"_own": F.lit(None).cast(marks.select(F.struct(*own).alias("s")).schema["s"].dataType), "_side": F.lit(0)}).unionByName(
        marks.where(F.col(at).isNotNull()).select(*keys, at, F.lit(None).cast(point.schema["_point"].dataType).alias("_point"), F.struct(*own).alias("_own"), F.lit(1).alias("_side"))
    ).withColumn("_b", F.floor(F.col(at) / bucket_us))
    up, down = Window.partitionBy(*keys, "_b").orderBy(at, "_side"), Window.partitionBy(*keys, "_b").orderBy(F.desc(at), F.desc("_side"))
    inside = rows.withColumns({"_last": F.last("_point", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.last("_point", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))})
    ends = rows.groupBy(*keys, "_b").agg(F.max("_point").alias("_high"), F.min("_point").alias("_low"))  # structs are compared by time first
    line, back = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys).orderBy(F.desc("_b"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, "_b", F.last("_high", ignorenulls=True).over(before(line)).alias("_from"), F.last("_low", ignorenulls=True).over(before(back)).alias("_to"))
    out = inside.where("_side = 1").join(carry, [*keys, "_b"])
    return out.select(*keys, at, "_own.*", F.coalesce("_last", "_from").alias("_last"), F.coalesce("_next", "_to").alias("_next"))


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, end: str, right_id: str) -> DataFrame:
    """For each left row the right row of equal keys that is nearest to `end`: one inside [start, end] first, then by the least distance, then by id.

    left has keys and the columns start and end (microseconds); right has keys, at and right_id. Left rows without end, or without any right row, are out.
    Adds right_id, gap (how far it is outside of [start, end], 0 inside) and in_window."""
    own = [c for c in left.columns if c not in keys]
    marks = left.withColumn(at, F.col(end)).withColumn("_row", F.struct(*own)).select(*keys, at, "_row")
    found = beside(right.select(*keys, at, right_id), marks, keys, at, [right_id]).select(*keys, "_row.*", "_last", "_next")
    inside = F.coalesce(F.col(f"_last.{at}") >= F.col(start), F.lit(False))
    far = lambda p: F.when(F.col(p).isNotNull(), F.struct(F.abs(F.col(f"{p}.{at}") - F.col(end)).alias("far"), F.col(f"{p}.{right_id}").alias("id"), F.col(f"{p}.{at}").alias("at")))
    best = F.when(inside, far("_last")).otherwise(F.least(far("_last"), far("_next")))
    return found.withColumn("_n", best).where("_n is not null").select(*keys, *own, F.col("_n.id").alias(right_id), F.greatest(F.col(start) - F.col("_n.at"), F.col("_n.at") - F.col(end), F.lit(0)).alias("gap"), inside.cast("int").alias("in_window"))


def full_compare(now: DataFrame, before: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Both windows' values per key of either: (keys, current, baseline, change); a key missing from a window counts 0 there."""
    a = now.select(*keys, F.col(value).alias("current"))
    b = before.select(*keys, F.col(value).alias("baseline"))
    both = a.join(b, keys, "full_outer").select(*keys, F.coalesce("current", F.lit(0)).alias("current"), F.coalesce("baseline", F.lit(0)).alias("baseline"))
    return both.withColumn("change", F.col("current") - F.col("baseline"))


def with_values(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose column is one of the values a caller asks for, in the caller's order number. The list is bounded, so it is broadcast."""
    if len(values) > MAX_VALUES:
        raise ValueError(f"more than {MAX_VALUES} values")
    asked = rows.sparkSession.createDataFrame([(v, i) for i, v in enumerate(dict.fromkeys(values))], f"{column} string, asked_no int")
    return rows.join(F.broadcast(asked), column)


def _counts(bitmaps: list[np.ndarray]) -> list[np.ndarray]:
    """The number of bitmaps that have each bit, as planes of binary digits, lowest first: full adders over whole bitmaps."""
    planes, here = [], bitmaps
    while here:
        above, here = [], list(here)
        while len(here) > 2:
            x, y, z = here.pop(), here.pop(), here.pop()
            odd = x ^ y
            carry = x & y
            carry |= odd & z
            odd ^= z
            here.append(odd)
            above.append(carry)
        if len(here) == 2:
            above.append(here[0] & here[1])
            here = [here[0] ^ here[1]]
        planes.append(here[0])
        here = above
    return planes


def _most(planes: list[np.ndarray]) -> tuple[int, np.ndarray]:
    """The greatest of the counts, and the positions that have it."""
    most, at = 0, None
    for n in range(len(planes) - 1, -1, -1):
        here = planes[n] if at is None else at & planes[n]
        if here.any():
            most, at = most | 1 << n, here
    words = np.flatnonzero(at) if at is not None else np.empty(0, np.int64)
    word, bit = np.divmod(np.flatnonzero(np.unpackbits(at[words].view(np.uint8), bitorder="little")) if len(words) else words, 64)
    return most, words[word] * 64 + bit


def _top_sets(least: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For each left set of a cell the greatest overlap with its right sets, how many ids have it (_k) and one set that does (_no)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("_ha", pa.list_(pa.field("element", pa.string()))), ("overlap", pa.int64()), ("_k", pa.int64()), ("_no", pa.int64())])
        none = schema.empty_table()
        if not left.num_rows or not right.num_rows:
            return none
        rights, lefts = right["_hb"].combine_chunks(), left["_ha"].combine_chunks()
        terms = pc.unique(rights.flatten())
        code = lambda sets: pc.index_in(sets.flatten(), terms)
        of_left, of_right = code(lefts).fill_null(-1).to_numpy(), code(rights).to_numpy()
        row = pc.list_parent_indices(rights).to_numpy()
        ends = np.cumsum(pc.list_value_length(lefts).to_numpy())
        number, k = right["_no"].to_numpy(), right["_k"].to_numpy()
        wide = max(64, min(right.num_rows, BITMAPS * 8 // len(terms)) // 64 * 64 + 64)  # more terms than bitmaps have room for: fewer sets at a time
        out = []
        for first in range(0, right.num_rows, wide):
            lo, hi = np.searchsorted(row, [first, first + wide])
            bits = np.zeros((len(terms), wide // 8), np.uint8)
            at = row[lo:hi] - first
            np.bitwise_or.at(bits, (of_right[lo:hi], at >> 3), np.left_shift(1, at & 7).astype(np.uint8))
            maps, used = bits.view(np.uint64), np.bincount(of_right[lo:hi], minlength=len(terms)) > 0
            found, overlap, many, one, begin = [], [], [], [], 0
            for i, end in enumerate(ends):
                own = of_left[begin:end]
                begin = end
                most, where = _most(_counts([maps[t] for t in own[own >= 0] if used[t]]))
                if most >= least and most:
                    where = where + first
                    found.append(i)
                    overlap.append(most)
                    many.append(int(k[where].sum()))
                    one.append(number[where[0]])
            out.append(pa.table([lefts.take(pa.array(found, pa.int64())), pa.array(overlap, pa.int64()), pa.array(many, pa.int64()), pa.array(one, pa.int64())], names=schema.names).cast(schema))
        return pa.concat_tables(out)

    return run


def _top_by_set(a_sets: DataFrame, b_sets: DataFrame, left_id: str, right_id: str, least: int) -> DataFrame | None:
    """(left_id, _id, overlap, _k): the greatest overlaps with the right sets, one row for each block of these. None without sets.

    Equal sets are one set; each pair of a piece of the left and a block of the right sets is a cell, and its counts are bit operations on bitmaps of the terms."""
    sets = cut(a_sets.select("_ha").distinct())
    kinds = cut(b_sets.groupBy("_hb").agg(F.count(F.lit(1)).alias("_k"), F.min(right_id).alias("_id")).withColumn("_no", F.monotonically_increasing_id()))
    n_left, n_right = sets.count(), kinds.count()
    if not n_left or not n_right:
        return None
    pieces, blocks = max(math.ceil(n_left / LEFT_SETS), min(6, math.ceil(n_left / 4096))), math.ceil(n_right / RIGHT_SETS)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_n")
    left = sets.select("_ha", every(blocks)).select((part("_ha", pieces) * blocks + F.col("_n")).alias("_cell"), "_ha")
    right = kinds.select("*", every(pieces)).select((F.col("_n") * blocks + part("_hb", blocks)).alias("_cell"), "_hb", "_k", "_no")  # ids stay behind, as each piece gets all sets
    top = left.groupBy("_cell").cogroup(right.groupBy("_cell")).applyInArrow(_top_sets(least), "_ha array<string>, overlap bigint, _k bigint, _no bigint")
    return top.join(kinds.select("_no", "_id"), "_no").join(a_sets, "_ha").select(left_id, "_id", "overlap", "_k")


def unique_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, term: str, least: int = 2, hot: int = 1000) -> DataFrame:
    """(left_id, right_id, overlap): for each left id the right id with which it shares most distinct terms, if at least `least` and without a tie.

    Both sides are (id, term) rows. Pairs are only made over terms that at most `hot` right ids have; how many of the others a pair shares is read from both ids' sets.
    Right ids that share only common terms count by their set of these: ids with the same set tie anyway. These sets aren't joined by term either, since all may share one;
    the greatest overlap of each comes from bitmaps of the terms, so a pair of sets costs some bit operations a term. The result is exact for any `hot`."""
    given = lambda rows, key: rows.select(key, term).where(F.col(key).isNotNull() & F.col(term).isNotNull())
    b = cut(given(right, right_id).groupBy(right_id).agg(F.collect_set(term).alias("_all")))  # sets by id: rows of an id that lie together are one before the shuffle
    one_by_one = b.select(right_id, F.explode("_all").alias(term))
    common = cut(one_by_one.groupBy(term).agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df") > hot).select(term, F.lit(True).alias("_common")))
    common = F.broadcast(common) if common.count() <= MAX_VALUES else common
    split = lambda rows, key, often, rare: cut(
        rows.join(common, term, "left").groupBy(key).agg(F.array_sort(F.collect_set(F.when(F.col("_common"), F.col(term)))).alias(often), F.collect_set(F.when(F.col("_common").isNull(), F.col(term))).alias(rare))
    )
    a, b = split(given(left, left_id), left_id, "_ha", "_ra"), split(one_by_one, right_id, "_hb", "_rb")
    a_sets, b_sets = a.where("size(_ha) > 0").select(left_id, "_ha"), b.where("size(_hb) > 0").select(right_id, "_hb")
    rare = a.select(left_id, F.explode("_ra").alias(term)).join(b.select(right_id, F.explode("_rb").alias(term)), term).groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("_n"))
    shared = F.coalesce(F.size(F.array_intersect("_ha", "_hb")), F.lit(0))
    by_id = rare.join(a_sets, left_id, "left").join(b_sets, right_id, "left").select(left_id, F.col(right_id).alias("_id"), (F.col("_n") + F.greatest(shared, F.lit(0))).alias("overlap"), F.lit(1).cast("bigint").alias("_k"))
    by_set = _top_by_set(a_sets, b_sets, left_id, right_id, least)
    pairs = (by_id if by_set is None else by_id.unionByName(by_set)).where(F.col("overlap") >= least)
    # the greatest overlap, how many ids have it, and one of them: combined before the shuffle by way of one row per overlap
    top = pairs.groupBy(left_id, "overlap").agg(F.sum("_k").alias("_k"), F.min("_id").alias(right_id))
    best = top.groupBy(left_id).agg(F.max(F.struct("overlap", "_k", right_id)).alias("_b"))
    return best.where("_b._k = 1").select(left_id, F.col(f"_b.{right_id}").alias(right_id), F.col("_b.overlap").alias("overlap"))


def unique_bridge(links: DataFrame, key: str, group: str) -> DataFrame:
    """(key, group) of the keys all of whose links lead to one group."""
    return links.groupBy(key).agg(F.count_distinct(group).alias("_k"), F.count_if(F.col(group).isNull()).alias("_void"), F.min(group).alias(group)).where("_k = 1 and _void = 0").select(key, group)
