"""Parent links to hierarchies: roots, depths, cycles, reachability, paths and descendants.

Nodes are range-partitioned by (namespace, order column, id) into chunks of about CHUNK rows, so that most
parents lie in the chunk of their children. Each chunk builds a weighted disjoint-set forest of its own links:
every node gets the top of its local tree, the offset to it and the least id on the way. Only the tops whose
parent lies elsewhere stay for the merge; there each round doubles the span of chunks a forest covers.
Two paths that never end are cycles: their root is the least id on the cycle.
No task holds more than a chunk, whatever the size of a namespace or the depth of a tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.session import cut

#: Nodes of one chunk, about.
CHUNK = 32_768
#: Ids of one path segment at most.
SEGMENT = 16

_FOREST = "ns string, id string, chunk int, idx int, parent string, local_parents array<int>, far_parents array<string>, top string, off bigint, low string, cyclic boolean, local_parent int"


def local_forest(parent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted union of all links i -> parent[i] (-1: none): (top, offset to it, index of the least rank on the way, in a cycle).

    Where the way runs into a cycle, top is the node of least rank on that cycle.
    """
    n = len(parent)
    top = np.where(parent >= 0, parent, np.arange(n))
    off = (parent >= 0).astype(np.int64)
    low = np.where(rank[top] < rank, top, np.arange(n))
    for _ in range(max(1, math.ceil(math.log2(n + 1))) + 1):  # each round doubles the way that is compressed
        low = np.where(rank[low[top]] < rank[low], low[top], low)
        off = off + off[top]
        top = top[top]
    cyclic = parent[top] >= 0
    # Once more than n steps are covered, top is on the cycle and its own way covers the whole cycle.
    top = np.where(cyclic, low[top], top)
    return top, np.where(cyclic, 0, off), low, cyclic


def _forest_of_chunk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    parts = list(frames)
    df = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
    if df.empty:
        return
    keys = list(zip(df["ns"], df["id"], strict=True))
    at = {k: i for i, k in enumerate(keys)}
    parent = np.fromiter((at.get((ns, p), -1) if p is not None else -1 for ns, p in zip(df["ns"], df["parent"], strict=True)), np.int64, len(df))
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df["id"].to_numpy(object), kind="stable")] = np.arange(len(df))
    top, off, low, cyclic = local_forest(parent, rank)
    ids = df["id"].to_numpy(object)
    near, far = [], []
    for ns, parents in zip(df["ns"], df["parents"], strict=True):
        found = [(at.get((ns, p)), p) for p in parents]
        near.append([i for i, _ in found if i is not None])
        far.append([p for i, p in found if i is None])
    yield pd.DataFrame({
        "ns": df["ns"], "id": ids, "chunk": np.int32(TaskContext.get().partitionId()), "idx": np.arange(len(df), dtype=np.int32), "parent": df["parent"],
        "local_parents": near, "far_parents": far, "top": ids[top], "off": off, "low": ids[low], "cyclic": cyclic, "local_parent": parent.astype(np.int32),
    })


def forest(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The local forests of nodes(ns, id, parents array, seq), cut from their lineage.

    Several rows of one (ns, id) count as one, with the parents of the row of greatest (seq, parents).
    Rows without ns or id are dropped; blank or null parents are no parents.
    """
    parents = F.filter(F.coalesce(F.col("parents"), F.array().cast("array<string>")), lambda p: p.isNotNull() & (F.trim(p) != ""))
    one = nodes.where("ns is not null and id is not null").groupBy("ns", "id").agg(F.max(F.struct("seq", parents.alias("parents"))).alias("v"))
    one = one.select("ns", "id", "v.seq", "v.parents", F.try_element_at("v.parents", F.lit(1)).alias("parent"))
    pieces = max(1, math.ceil(nodes.count() / chunk))
    placed = one.repartitionByRange(pieces, "ns", "seq", "id") if pieces > 1 else one.coalesce(1)
    return cut(placed.select("ns", "id", "parents", "parent").mapInPandas(_forest_of_chunk, _FOREST))


def top_links(local: DataFrame) -> DataFrame:
    """Tops with a parent in another chunk: (ns, top, parent, next, weight, low, cyclic), next being the top of the parent's tree."""
    ends = local.select("ns", F.col("id").alias("parent"), F.col("top").alias("next"), F.col("off").alias("w"), F.col("low").alias("l"), F.col("cyclic").alias("c"))
    rows = local.where("id = top and not cyclic and parent is not null").select("ns", "top", "parent").join(ends, ["ns", "parent"])
    return cut(rows.select("ns", "top", "parent", "next", (F.col("w") + 1).alias("weight"), F.least("top", "l").alias("low"), F.col("c").alias("cyclic")))


def merged_tops(direct: DataFrame) -> DataFrame:
    """Where tops with a parent in another chunk lead in the end: (ns, top, next, weight, cyclic)."""
    links = direct.drop("parent")
    size = links.count()
    if not size:
        return links.drop("low")
    for _ in range(math.ceil(math.log2(size + 1)) + 1):
        on = links.select("ns", F.col("top").alias("next"), F.col("next").alias("n2"), F.col("weight").alias("w2"), F.col("low").alias("l2"), F.col("cyclic").alias("c2"))
        links = cut(
            links.join(on, ["ns", "next"], "left").select(
                "ns", "top", F.coalesce("n2", "next").alias("next"), (F.col("weight") + F.coalesce("w2", F.lit(0))).alias("weight"),
                F.when(F.col("l2").isNull(), F.col("low")).otherwise(F.least("low", "l2")).alias("low"),
                F.coalesce("c2", "cyclic").alias("cyclic"), F.col("n2").isNotNull().alias("moved"),
            )
        )
        if links.where("moved").isEmpty():
            return links.drop("low", "moved")
    # What still moves after more steps than there are tops is on its way round a cycle.
    ring = links.where("moved").select("ns", F.col("top").alias("next"), F.col("low").alias("least"))
    return links.join(ring, ["ns", "next"], "left").select(
        "ns", "top", F.coalesce("least", "next").alias("next"), "weight", (F.col("cyclic") | F.col("least").isNotNull()).alias("cyclic")
    )


def rooted(local: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """(ns, id, chunk, idx, root, depth); depth is -1 where the way up runs into a cycle."""
    tops = merged_tops(top_links(local) if direct is None else direct).withColumnRenamed("cyclic", "ring")
    loops = F.col("cyclic") | F.coalesce("ring", F.lit(False))
    return local.select("ns", "id", "chunk", "idx", "top", "off", "cyclic").join(tops, ["ns", "top"], "left").select(
        "ns", "id", "chunk", "idx", F.coalesce("next", "top").alias("root"),
        F.when(loops, F.lit(-1)).otherwise(F.col("off") + F.coalesce("weight", F.lit(0))).cast("bigint").alias("depth"),
    )


def _closure(rows: pa.Table, seeds: pa.Table) -> pa.Array:
    """Positions of the rows of a chunk that the seeds lead to over local links."""
    idx, near = rows["idx"].to_pylist(), rows["local_parents"].to_pylist()
    at = {i: k for k, i in enumerate(idx)}
    todo = [at[i] for i in set(seeds["row"].to_pylist()) if i in at]
    hit = set(todo)
    while todo:
        for p in near[todo.pop()]:
            if (k := at[p]) not in hit:
                hit.add(k)
                todo.append(k)
    return pa.array(sorted(hit), pa.int64())


_IDS = pa.schema([("ns", pa.string()), ("id", pa.string())])


def _far_targets(rows: pa.Table, seeds: pa.Table) -> pa.Table:
    hit = rows.take(_closure(rows, seeds))
    pairs = sorted({(ns, p) for ns, far in zip(hit["ns"].to_pylist(), hit["far_parents"].to_pylist(), strict=True) for p in far})
    return pa.table([pa.array([x[i] for x in pairs], pa.string()) for i in (0, 1)], schema=_IDS)


def _reached(rows: pa.Table, seeds: pa.Table) -> pa.Table:
    hit = rows.take(_closure(rows, seeds))
    return pa.table([hit["ns"], hit["id"]], schema=_IDS)


def _jumps(direct: DataFrame) -> list[DataFrame]:
    """Where tops lead after 1, 2, 4, ... links: rows (ns, top, next), until none leads so far.

    A ring of tops is opened at its least top, since it leads on without end: so there are as many jumps as the longest way has doublings,
    not as all tops have. Who follows the jumps only misses links that lead to a door, and doors are closed over any parents anyway."""
    size = direct.count()

    def doubled(links: DataFrame) -> tuple[list[DataFrame], DataFrame]:
        out, jump = [], links.select("ns", "top", "next", F.col("top").alias("least"))
        for _ in range(math.ceil(math.log2(size + 1)) if size else 0):
            if jump.isEmpty():
                break
            out.append(jump.select("ns", "top", "next"))
            far = jump.select("ns", F.col("top").alias("next"), F.col("next").alias("n2"), F.col("least").alias("l2"))
            jump = cut(jump.join(far, ["ns", "next"]).select("ns", "top", F.col("n2").alias("next"), F.least("least", "l2").alias("least")))
        return out, jump

    out, endless = doubled(direct)
    if endless.isEmpty():
        return out
    # After as many links as there are tops all are on a ring, and have met the whole of it.
    first = endless.join(endless.select("ns", F.col("next").alias("top")).distinct(), ["ns", "top"], "left_semi").where("top = least")
    return doubled(cut(direct.join(first, ["ns", "top"], "left_anti")))[0]


def reachable(local: DataFrame, starts: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """Distinct (ns, id) that starts(ns, id) lead to over any parents, the starts included if they are nodes.

    Nodes that links from other chunks lead to are the doors of a chunk. In each round the doors just reached first pull in all doors on
    their first-parent ways, by doubling over the tops of the forests; then each chunk with new doors is closed from these, over any parents,
    and gives the doors its links lead to. So the rounds are the turns off a first-parent way that the way to a node takes, not its length.
    """
    direct = top_links(local) if direct is None else direct
    jumps = _jumps(direct)
    first = starts.select("ns", "id").distinct()
    far = local.select("ns", F.explode("far_parents").alias("id")).distinct()
    doors = cut(local.select("ns", "id", F.col("chunk").alias("piece"), F.col("idx").alias("row"), "top").join(first.unionByName(far).distinct(), ["ns", "id"]))
    rows = local.select("ns", "id", "chunk", "idx", "local_parents", "far_parents")
    new = doors.join(first, ["ns", "id"], "left_semi")
    seen = None
    while True:
        tops = new.select("ns", "top").distinct()
        for jump in jumps:
            # tops are read once here: a union of tops and what they lead to would double the plan with each jump
            tops = tops.join(jump, ["ns", "top"], "left").select("ns", F.explode(F.array_compact(F.array("top", "next"))).alias("top")).distinct()
        along = tops.join(direct.select("ns", "top", F.col("parent").alias("id")), ["ns", "top"]).select("ns", "id").distinct()
        new = new.unionByName(doors.join(along, ["ns", "id"], "left_semi")).distinct()
        new = cut(new if seen is None else new.join(seen, ["piece", "row"], "left_anti"))
        if new.isEmpty():
            break
        seen = new.select("piece", "row") if seen is None else seen.unionByName(new.select("piece", "row"))
        active = new.select(F.col("piece").alias("chunk")).distinct()
        led = rows.join(active, "chunk", "left_semi").groupBy("chunk").cogroup(new.select("piece", "row").groupBy("piece")).applyInArrow(_far_targets, "ns string, id string")
        new = doors.join(led.distinct(), ["ns", "id"], "left_semi").join(seen, ["piece", "row"], "left_anti")
    if seen is None:
        return rows.select("ns", "id").limit(0)
    return rows.groupBy("chunk").cogroup(seen.groupBy("piece")).applyInArrow(_reached, "ns string, id string")


def _subtree_totals(local: DataFrame, direct: DataFrame) -> DataFrame:
    """(ns, id, extra): nodes that hang below each node through links from other chunks. Totals of tops are added up to their ancestors by doubling."""
    size = direct.count()
    totals = cut(local.where("not cyclic").groupBy("ns", "top").agg(F.count(F.lit(1)).alias("total")))
    jump = direct.where("not cyclic").select("ns", "top", "next")
    for _ in range(math.ceil(math.log2(size + 1)) + 1 if size else 0):
        far = jump.select("ns", F.col("top").alias("next"), F.col("next").alias("n2"))
        gained = jump.join(totals, ["ns", "top"]).groupBy("ns", F.col("next").alias("top")).agg(F.sum("total").alias("more"))
        totals = cut(totals.join(gained, ["ns", "top"], "left").select("ns", "top", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total")))
        jump = cut(jump.join(far, ["ns", "next"]).select("ns", "top", F.col("n2").alias("next")))
        if jump.isEmpty():
            break
    return direct.join(totals, ["ns", "top"]).groupBy("ns", F.col("parent").alias("id")).agg(F.sum("total").alias("extra"))


_INDEX = "ns string, id string, descendants bigint, anchor string, segment array<string>"


def _index_of_chunk(key: tuple, rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("idx")
    ids, parent, off, cyclic, first, extra = (rows[c].to_pylist() for c in ("id", "local_parent", "off", "cyclic", "parent", "extra"))
    below = [e or 0 for e in extra]
    for i in sorted(range(len(ids)), key=lambda i: -off[i]):
        if parent[i] >= 0 and not cyclic[i]:
            below[parent[i]] += below[i] + 1
    anchors, segments = [], []
    for i in range(len(ids)):
        if cyclic[i]:  # one link at a time, as there is no top to count from
            anchors.append(first[i])
            segments.append([])
            continue
        way, at = [], parent[i]
        while at >= 0 and parent[at] >= 0 and off[at] % SEGMENT:
            way.append(ids[at])
            at = parent[at]
        anchors.append(ids[at] if at >= 0 else first[i])
        segments.append(way[::-1])
    return pa.table({"ns": rows["ns"], "id": rows["id"], "descendants": pa.array([None if c else b for b, c in zip(below, cyclic, strict=True)], pa.int64()), "anchor": pa.array(anchors, pa.string()), "segment": pa.array(segments, pa.list_(pa.string()))})


def path_index(local: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """(ns, id, descendants, anchor, segment): the path of a node is that of its anchor, the anchor, the segment and the node.

    A segment has fewer than SEGMENT ids, so the index is linear in the nodes even where paths are long. Anchors that are no nodes
    end a path. Nodes whose way runs into a cycle of their chunk have their parent as anchor and no count of descendants."""
    extra = _subtree_totals(local, top_links(local) if direct is None else direct)
    rows = local.select("ns", "id", "chunk", "idx", "local_parent", "off", "cyclic", "parent").join(extra, ["ns", "id"], "left")
    return rows.groupBy("chunk").applyInArrow(_index_of_chunk, _INDEX)


def _ways(links: DataFrame) -> DataFrame:
    """(ns, id, way) of links(ns, id, up, way): a way has the ids from a node up to the one below up; joined by doubling until there is no up or an id would come again."""
    state = cut(links.select("ns", "id", "up", "way"))
    while not state.where("up is not null").isEmpty():
        on = state.select("ns", F.col("id").alias("up"), F.col("up").alias("u2"), F.col("way").alias("w2"))
        both = F.concat("way", F.coalesce("w2", F.array().cast("array<string>")))
        state = cut(
            state.join(on, ["ns", "up"], "left").select("ns", "id", "u2", both.alias("both"), F.array_distinct(both).alias("way"))
            .select("ns", "id", F.when(F.size("way") == F.size("both"), F.col("u2")).alias("up"), "way")
        )
    return state.select("ns", "id", "way")


def full_paths(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ns, id, path): root first, of the nodes(ns, id) that are asked for. The anchors' paths are joined by doubling, so the rounds are the logarithm of depth / SEGMENT.

    Where the way up runs into a cycle, the path begins with the last id before one would come again."""
    hubs = index.select("ns", F.col("anchor").alias("id")).where("id is not null").distinct()
    step = F.concat(F.array("id"), F.reverse("segment"))
    ways = _ways(index.join(hubs, ["ns", "id"], "left_semi").select("ns", "id", F.col("anchor").alias("up"), step.alias("way")))
    above = ways.select("ns", F.col("id").alias("anchor"), F.col("way").alias("above"))
    none = F.array().cast("array<string>")
    asked = nodes.select("ns", "id").distinct().join(index.select("ns", "id", "anchor", "segment"), ["ns", "id"], "left").join(above, ["ns", "anchor"], "left")
    way = F.concat(F.array("id"), F.reverse(F.coalesce("segment", none)), F.coalesce("above", none))
    return asked.select("ns", "id", F.reverse(F.array_distinct(way)).alias("path"))


def descendants_of(index: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ns, id, descendant) of the nodes(ns, id) that are asked for: those with the node in their segment or as anchor, then those anchored at these."""
    up = cut(index.where("anchor is not null").select("ns", F.col("id").alias("descendant"), F.explode(F.concat(F.array("anchor"), F.col("segment"))).alias("id")))
    anchored = index.where("anchor is not null").select("ns", F.col("anchor").alias("at"), F.col("id").alias("more"))
    seen = new = cut(nodes.select("ns", "id").distinct().join(up, ["ns", "id"]).select("ns", "id", "descendant").distinct())
    while not new.isEmpty():
        step = new.join(anchored, (new["ns"] == anchored["ns"]) & (new["descendant"] == anchored["at"])).select(new["ns"], "id", F.col("more").alias("descendant")).distinct()
        new = cut(step.join(seen, ["ns", "id", "descendant"], "left_anti"))
        seen = seen.unionByName(new)
    return seen.where("id != descendant")
