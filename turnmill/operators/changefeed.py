"""Rebuilding table state from a change feed.

`fold` is the general operator: a commutative, idempotent aggregate. Every change is a struct
(sequence, operation, payload); the state of a key is the greatest struct seen, deletions stay in the
state as tombstones, so a late insert with a lower sequence can't bring a row back. Folding a state
with more changes is the same aggregate again, so batches may come in any order and more than once.

`applied_deltas` orders generation-guarded deltas: it finds per stream the chain of deltas that starts
at generation 0, which gives every change its sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.session import cut

#: Expected generations of one chunk of a stream. At most this many links are in one row of the chunk table.
CHUNK = 4096

DELETE, UPSERT = 0, 1


def fold(changes: DataFrame, keys: list[str], sequence: list[str], payload: list[str], base: DataFrame | None = None) -> DataFrame:
    """State per key: `keys`, `change` = the greatest struct(sequence..., op, payload...).

    changes: keys, sequence columns, `op` (0 delete, 1 upsert) and payload columns.
    base: an earlier result of fold, tombstones included, or None.
    Null sequence values sort below all others; of changes equal in sequence an upsert wins over a
    delete and then the greater payload, so the result never depends on the order of arrival.
    Rows with a null key form a key of their own. Extra columns are ignored.
    """
    rows = changes.select(*keys, F.struct(*sequence, "op", *payload).alias("change"))
    if base is not None:
        rows = rows.unionByName(base.select(*keys, "change"))
    return rows.groupBy(*keys).agg(F.max("change").alias("change"))


def current(state: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """The rows of a fold's state that aren't deleted."""
    return state.where(F.col("change.op") == UPSERT).select(*keys, *(F.col(f"change.{c}").alias(c) for c in payload))


def number(text: Column) -> Column:
    """An unsigned number spelled with blanks, a plus or leading zeros; null for anything else."""
    plain = F.regexp_replace(F.trim(text), r"^\+", "")
    return F.when(plain.rlike(r"^[0-9]{1,38}$"), plain).try_cast("decimal(38,0)")


def _chunk(generation: Column) -> Column:
    return F.floor(generation / F.lit(CHUNK)).cast("decimal(38,0)")


def _canonical(generation: Column) -> Column:
    return generation.cast("string")


def chunk_table(deliveries: DataFrame, stream: str) -> DataFrame:
    """One row per stream and chunk: `links` holds for every expected generation the delta first received.

    The map side already keeps one delivery per expected generation, so neither a hot stream nor many
    deliveries of one delta make a large group.
    """
    expected, generation = number(F.col("expected_generation")), number(F.col("generation"))
    late = F.timestamp_micros(F.lit(2**62))
    link = F.struct(
        F.coalesce(F.col("received_at"), late).alias("first"), F.col("delta_id"), _canonical(generation).alias("target"),
        (F.col("delta_mode") == "replace-session").alias("replaces"), F.coalesce(F.col("turn_keys"), F.array().cast("array<string>")).alias("turn_keys"),
    )
    first = (
        deliveries.where(F.col(stream).isNotNull() & F.col("delta_id").isNotNull())
        .select(F.col(stream), expected.alias("expected"), link.alias("link"))
        .where("expected is not null and link.target is not null")
        .groupBy(stream, _chunk(F.col("expected")).alias("chunk"), "expected")
        .agg(F.min("link").alias("link"))
    )
    return first.groupBy(stream, "chunk").agg(
        F.collect_list(F.struct(_canonical(F.col("expected")).alias("at"), "link.delta_id", "link.target", "link.replaces", "link.turn_keys")).alias("links")
    )


def _walk(links: dict, start: str) -> Iterator[dict]:
    seen: set[str] = set()
    at = start
    while at in links and at not in seen:
        seen.add(at)
        yield links[at]
        at = links[at]["target"]


def _applied_kernel(stream: str, whole: bool = True):
    """Rows of applied deltas from chunk rows with `entries` (where the chain enters, and its rank there).

    A delta applies once, so the chain ends where it meets one again. If a row is not the whole stream, that second row is given too, for `_ended`."""
    schema = pa.schema([(stream, pa.string()), ("delta_id", pa.string()), ("rank", pa.int64()), ("floor", pa.int64()), ("replaces", pa.bool_()), ("turn_keys", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                links = {x["at"]: x for x in row["links"]}
                for entry in row["entries"]:
                    steps = list(_walk(links, entry["at"]))
                    ranks = range(entry["rank"], entry["rank"] + len(steps))
                    done: set[str] = set()
                    for n, x in enumerate(steps):
                        if x["delta_id"] in done:
                            steps = steps[: n + (not whole)]
                            break
                        done.add(x["delta_id"])
                    floor = max((r for r, x in zip(ranks, steps, strict=False) if x["replaces"]), default=0)
                    out += [(row[stream], x["delta_id"], r, floor, x["replaces"], x["turn_keys"]) for r, x in zip(ranks, steps, strict=False)]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run, f"`{stream}` string, delta_id string, rank bigint, floor bigint, replaces boolean, turn_keys array<string>"


def _contract_kernel(stream: str):
    """Rows (stream, at, target, weight): where a walk from each entry leaves its chunk, and after how many deltas."""
    schema = pa.schema([(stream, pa.string()), ("at", pa.string()), ("target", pa.string()), ("weight", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                links = {x["at"]: x["target"] for x in row["links"]}
                leaves: dict[str, tuple[str | None, int]] = {}  # each node is walked once
                for entry in row["entries"]:
                    path, at, on = [], entry["at"], set()
                    while at in links and at not in leaves and at not in on:
                        path.append(at)
                        on.add(at)
                        at = links[at]
                    end = leaves.get(at, (None, 0) if at in on else (at, 0))
                    for k, node in enumerate(reversed(path), 1):
                        leaves[node] = (end[0], end[1] + k)
                    out.append((row[stream], entry["at"], *leaves[entry["at"]]))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run, f"`{stream}` string, at string, target string, weight bigint"


def _entries_of_long_streams(chunks: DataFrame, stream: str) -> DataFrame:
    """Where the chains of streams with several chunks enter each chunk: rows (stream, chunk, entries)."""
    long_streams = chunks.where("chunk > 0").select(stream).distinct()
    own = chunks.join(long_streams, stream, "left_semi")
    links = own.select(stream, "chunk", F.explode("links").alias("x")).select(stream, "chunk", "x.at", "x.target")
    across = links.where(_chunk(F.col("target").cast("decimal(38,0)")) != F.col("chunk")).select(stream, F.col("target").alias("at")).distinct()
    start = long_streams.select(stream, F.lit("0").alias("at"))
    entries = across.join(links.select(stream, "at"), [stream, "at"], "left_semi").unionByName(start).distinct()
    entries = entries.withColumn("chunk", _chunk(F.col("at").cast("decimal(38,0)")))
    grouped = entries.groupBy(stream, "chunk").agg(F.collect_list(F.struct("at")).alias("entries"))
    kernel, schema = _contract_kernel(stream)
    jump = cut(own.join(grouped, [stream, "chunk"]).mapInArrow(kernel, schema).where("weight > 0 and target is not null"))
    reached, size = cut(start.withColumn("rank", F.lit(0).cast("bigint"))), -1
    while (now := reached.count()) != size:  # the reach doubles, so the rounds are the logarithm of the chunks on a chain
        size = now
        step = reached.join(jump, [stream, "at"]).select(stream, F.col("target").alias("at"), (F.col("rank") + F.col("weight")).alias("rank"))
        reached = cut(reached.unionByName(step).groupBy(stream, "at").agg(F.min("rank").alias("rank")))
        far = jump.select(stream, F.col("at").alias("target"), F.col("target").alias("far"), F.col("weight").alias("more"))
        jump = cut(jump.join(far, [stream, "target"]).select(stream, "at", F.col("far").alias("target"), (F.col("weight") + F.col("more")).alias("weight")))
    return reached.withColumn("chunk", _chunk(F.col("at").cast("decimal(38,0)"))).groupBy(stream, "chunk").agg(F.collect_list(F.struct("at", "rank")).alias("entries"))


def _ended(walked: DataFrame, stream: str) -> DataFrame:
    """The rows of chains walked in chunks up to where each chain first meets a delta again."""
    firsts = walked.groupBy(stream, "delta_id").agg(F.min("rank").alias("first"))
    ends = walked.join(firsts, [stream, "delta_id"]).where(F.col("rank") > F.col("first")).groupBy(stream).agg(F.min("rank").alias("end"))
    return walked.join(ends, stream, "left").where(F.col("end").isNull() | (F.col("rank") < F.col("end"))).drop("end")


def applied_deltas(deliveries: DataFrame, stream: str = "session_key") -> DataFrame:
    """Deltas that apply: (stream, delta_id, rank, turn_keys, floor).

    A delta applies only if its expected generation is the one reached so far, from 0; of several
    deltas that expect the same one the first received applies (ties: least delta_id), each at most once: where one comes again the chain ends.
    rank counts the applied deltas of a stream from 0. floor is the rank of the last delta that replaces
    the whole stream (0 if none): changes of lower rank no longer matter. Null or non-numeric generations,
    null streams and null delta ids never apply; a null received_at counts as the latest. Empty in, empty out.

    Streams are cut into chunks of CHUNK expected generations, and the chain is walked inside each chunk;
    only for streams that have several chunks are the walks joined, by doubling, so no task ever holds a whole long stream.
    """
    chunks = cut(chunk_table(deliveries, stream))
    kernel, schema = _applied_kernel(stream)
    first = F.array(F.struct(F.lit("0").alias("at"), F.lit(0).cast("bigint").alias("rank")))
    if chunks.where("chunk > 0").isEmpty():
        return chunks.where("chunk = 0").withColumn("entries", first).mapInArrow(kernel, schema).drop("replaces")
    long_streams = chunks.where("chunk > 0").select(stream).distinct()
    short = chunks.where("chunk = 0").join(long_streams, stream, "left_anti").withColumn("entries", first).mapInArrow(kernel, schema)
    walked = cut(chunks.join(_entries_of_long_streams(chunks, stream), [stream, "chunk"]).mapInArrow(_applied_kernel(stream, whole=False)[0], schema))
    ranked = cut(_ended(walked, stream).drop("floor"))
    floors = ranked.groupBy(stream).agg(F.coalesce(F.max(F.when(F.col("replaces"), F.col("rank"))), F.lit(0)).alias("floor"))
    return short.drop("replaces").unionByName(ranked.drop("replaces").join(floors, stream))


def turn_state(commits: DataFrame, upserts: DataFrame) -> DataFrame:
    """Fold of all turn changes, tombstones included: (session_key, turn_key, change).

    Inside a delta a whole-session replacement comes first, then removals, then upserts by upsert_no.
    Upserts of deltas that never apply or aren't in commits change nothing. Null turn keys are dropped.
    """
    applied = applied_deltas(commits).where("rank >= floor")
    removed = applied.select(
        "session_key", F.explode("turn_keys").alias("turn_key"), "rank", F.lit(0).alias("phase"), F.lit(0).alias("upsert_no"), F.lit(DELETE).alias("op"),
        "delta_id", F.lit(None).cast("string").alias("revision"),
    )
    written = (
        upserts.select("session_key", "delta_id", "upsert_no", "turn_key", "revision")
        .join(applied.select("session_key", "delta_id", "rank"), ["session_key", "delta_id"])
        .select("session_key", "turn_key", "rank", F.lit(1).alias("phase"), "upsert_no", F.lit(UPSERT).alias("op"), "delta_id", "revision")
    )
    changes = removed.unionByName(written).where("turn_key is not null")
    return fold(changes, ["session_key", "turn_key"], ["rank", "phase", "upsert_no"], ["delta_id", "revision"])


def held_turns(commits: DataFrame, upserts: DataFrame) -> DataFrame:
    """(session_key, turn_key, delta_id, revision) of every turn held after all deltas."""
    return current(turn_state(commits, upserts), ["session_key", "turn_key"], ["delta_id", "revision"])
