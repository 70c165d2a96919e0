"""Workflow paths: tool sequences of turns as run-length nodes, exact groups by fingerprint, and families of similar groups."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.operators import windows

#: Nodes of one path: its first HEAD and last TAIL ones.
HEAD, TAIL = 96, 32
#: Groups that families are built from (the most frequent), families that are reported, and the similarity that joins.
INPUTS, FAMILIES, SIMILAR = 200, 20, 0.70
#: Turns and independent sessions (copies of one count once) that a family usually needs.
LEAST_TURNS, LEAST_SESSIONS = 5, 3


def path_groups(uses: DataFrame, order: list[str], copies: DataFrame | None = None) -> DataFrame:
    """(fingerprint, nodes, turns, sessions): turns with the same path. Long paths keep their first 96 and last 32 nodes. copies: (sessionKey, groupKey); sessions of one group count once."""
    if copies is not None:
        group = F.coalesce("groupKey", "sessionKey").alias("_g")
        uses = uses.join(copies.select("sessionKey", group), "sessionKey", "left").withColumn("sessionKey", F.coalesce("_g", "sessionKey")).drop("_g")
    turn = uses.where("turnKey is not null").select("turnKey", "sessionKey", "capabilityName", *order)
    runs = windows.run_lengths(turn, "turnKey", order, "capabilityName")
    node = F.concat(F.coalesce("capabilityName", F.lit("?")), F.lit(":"), windows.length_bucket(F.col("length")))
    kept = windows_head_tail(runs.select("turnKey", "run_no", node.alias("node")))
    paths = kept.groupBy("turnKey").agg(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "node"))), lambda x: x["node"]).alias("nodes"))
    sessions = turn.groupBy("turnKey").agg(F.min("sessionKey").alias("sessionKey"))
    p = paths.join(sessions, "turnKey").withColumn("fingerprint", F.sha2(F.array_join("nodes", "\n"), 256))
    return p.groupBy("fingerprint").agg(F.first("nodes").alias("nodes"), F.count(F.lit(1)).alias("turns"), F.count_distinct("sessionKey").alias("sessions"))


def windows_head_tail(runs: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = F.max("run_no").over(Window.partitionBy("turnKey"))
    return runs.withColumn("_n", n).where((F.col("run_no") < HEAD) | (F.col("run_no") > F.col("_n") - TAIL)).drop("_n")


def families(groups: DataFrame, least_turns: int = 1, least_sessions: int = 1) -> DataFrame:
    """(family_no, medoid, fingerprint, turns): the most frequent groups joined greedily to the family whose medoid has the same ends and a weighted
    Jaccard similarity of bigrams of at least 0.70; bigrams weigh by their rarity. Families of under least_turns turns, or none of whose groups has least_sessions sessions, are left out. The input is the top INPUTS groups, so one task holds it."""
    top = groups.orderBy(F.desc("turns"), "fingerprint").limit(INPUTS)

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (-r["turns"], r["fingerprint"]))
        grams = [Counter(zip(r["nodes"], r["nodes"][1:], strict=False)) or Counter({(r["nodes"][0], ""): 1}) for r in rows]
        df = Counter(g for c in grams for g in c)
        idf = {g: math.log((len(rows) + 1) / (n + 1)) + 1 for g, n in df.items()}
        found: list[list[int]] = []
        for i, r in enumerate(rows):
            for f in found:
                m = rows[f[0]]
                if (m["nodes"][0], m["nodes"][-1]) == (r["nodes"][0], r["nodes"][-1]):
                    both = sum(idf[g] * min(grams[i][g], grams[f[0]][g]) for g in grams[i])
                    either = sum(idf[g] * max(grams[i][g], grams[f[0]][g]) for g in grams[i] | grams[f[0]])
                    if both / either >= SIMILAR:
                        f.append(i)
                        break
            else:
                found.append([i])
        found = [f for f in found if sum(rows[i]["turns"] for i in f) >= least_turns and max(rows[i]["sessions"] for i in f) >= least_sessions]
        found.sort(key=lambda f: (-sum(rows[i]["turns"] for i in f), rows[f[0]]["fingerprint"]))
        out = [(n, rows[f[0]]["fingerprint"], rows[i]["fingerprint"], rows[i]["turns"]) for n, f in enumerate(found[:FAMILIES]) for i in f]
        cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table({"family_no": pa.array(cols[0], pa.int64()), "medoid": pa.array(cols[1], pa.string()), "fingerprint": pa.array(cols[2], pa.string()), "turns": pa.array(cols[3], pa.int64())})

    return top.groupBy(F.lit(1).alias("one")).applyInArrow(run, "family_no bigint, medoid string, fingerprint string, turns bigint")
