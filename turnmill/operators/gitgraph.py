"""Commits and refs as nodes and starts of a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.operators import hierarchy
from turnmill.session import cut


def commit_nodes(commits: DataFrame) -> DataFrame:
    """(ns, id, parents, seq, time order) of commits; ids in lower case, all spellings of "no parent" as an empty array."""
    return commits.select(
        F.col("repository_id").alias("ns"),
        F.lower("object_id").alias("id"),
        F.from_json(F.lower("parent_object_ids_json"), "array<string>").alias("parents"),
        F.col("committer_timestamp").alias("seq"),
    )


def commit_forest(commits: DataFrame, refs: DataFrame, chunk: int = hierarchy.CHUNK) -> DataFrame:
    """One row per commit: (repository_id, object_id, root_object_id, tree_depth, is_reachable).

    Rows without repository or object id are dropped; parents that aren't in the table end the way up
    (the commit is a root of depth 0); JSON that can't be read means no parent; empty tables give no rows.
    """
    local = hierarchy.forest(commit_nodes(commits), chunk)
    direct = hierarchy.top_links(local)
    hit = hierarchy.reachable(local, refs.select(F.col("repository_id").alias("ns"), F.lower("object_id").alias("id")), direct)
    return hierarchy.rooted(local, direct).join(hit.withColumn("hit", F.lit(1)), ["ns", "id"], "left").select(
        F.col("ns").alias("repository_id"), F.col("id").alias("object_id"), F.col("root").alias("root_object_id"),
        F.col("depth").alias("tree_depth"), F.coalesce("hit", F.lit(0)).cast("bigint").alias("is_reachable"),
    )


def commit_hierarchy(commits: DataFrame, chunk: int = hierarchy.CHUNK) -> DataFrame:
    """One row per commit: (repository_id, object_id, root_object_id, tree_depth, descendants, anchor_object_id, segment); see hierarchy.path_index.

    descendants and anchor are null, and segment is empty, where the way up runs into a cycle."""
    local = hierarchy.forest(commit_nodes(commits), chunk)
    direct = hierarchy.top_links(local)
    placed = hierarchy.rooted(local, direct).join(hierarchy.path_index(local, direct), ["ns", "id"])
    return placed.select(
        F.col("ns").alias("repository_id"), F.col("id").alias("object_id"), F.col("root").alias("root_object_id"), F.col("depth").alias("tree_depth"),
        F.when(F.col("depth") >= 0, F.col("descendants")).alias("descendants"), F.when(F.col("depth") >= 0, F.col("anchor")).alias("anchor_object_id"),
        F.when(F.col("depth") >= 0, F.col("segment")).otherwise(F.array().cast("array<string>")).alias("segment"),
    )


def commit_paths(commits: DataFrame, chunk: int = hierarchy.CHUNK) -> DataFrame:
    """One row per commit: (repository_id, object_id, path), its whole first-parent path from the root to itself.

    Where the way up runs into a cycle, the path begins with the last id before one would come again."""
    index = cut(hierarchy.path_index(hierarchy.forest(commit_nodes(commits), chunk)))
    return hierarchy.full_paths(index, index).select(F.col("ns").alias("repository_id"), F.col("id").alias("object_id"), "path")


def commit_descendants(commits: DataFrame, chunk: int = hierarchy.CHUNK) -> DataFrame:
    """One row per commit and commit below it: (repository_id, object_id, descendant_object_id), those with the commit on their first-parent path.

    Commits on a cycle are descendants of each other, none of itself; commits without descendants have no row."""
    pairs = commit_paths(commits, chunk).select("repository_id", F.explode("path").alias("above"), "object_id")
    return pairs.where("above != object_id").select("repository_id", F.col("above").alias("object_id"), F.col("object_id").alias("descendant_object_id"))
