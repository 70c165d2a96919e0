"""Collapsing runs of identical or nearly identical consecutive events.

Events are range-partitioned by (session, position), so a hot session spans as many chunks as it needs.
In each chunk the run starts are gathered into one sorted array, every event finds its run by binary
search, and runs are aggregated. Runs that touch a chunk's first or last event are stitched over the chunks
from two boundary rows a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.session import cut

#: Events of one chunk, about.
CHUNK = 250_000

# What is volatile in an input, as Java patterns; what stands before a value stays.
VOLATILE = [
    r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",  # uuid
    r"(?i)(?<=\breq(?:uest)?[-_]?id[\"']{0,1}[\s]{0,3}[:=][\s]{0,3}[\"']{0,1})[\w.-]+",  # request id, as a value
    r"(?i)\breq[-_][0-9a-z]{6,}\b",  # request id, by its form
    r"(?:/var|/private)?/tmp/[^\s\"'|;,)]+",  # temporary file
    r"\btmp[._-]?[A-Za-z0-9]{6,}(?:\.\w+)?\b",
    r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?",  # date and clock time
    r"\b\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?\b",  # clock time
    r"(?<![\d+./-])1[4-9]\d{8}(?:\d{3}){0,3}(?![\d./-])",  # epoch stamp in s, ms, us or ns
    r"(?i)(?<=\bpid[\s:=#]{1,3})\d+",  # process id
    r"(?i)(?<=\b(?:attempt|retry|try)[\s:=#]{1,3})\d+(?:\s?(?:/|of)\s?\d+)?",  # attempt counter
]

_SCHEMA = pa.schema([
    ("chunk", pa.int32()), ("edge", pa.int32()), ("session_key", pa.string()), ("first_event_key", pa.string()), ("last_event_key", pa.string()),
    ("run_length", pa.int64()), ("first_at", pa.int64()), ("last_at", pa.int64()), ("capability_key", pa.string()),
    ("head_print", pa.string()), ("head_text", pa.string()), ("tail_print", pa.string()), ("tail_text", pa.string()),
])
_DDL = "chunk int, edge int, session_key string, first_event_key string, last_event_key string, run_length bigint, first_at bigint, last_at bigint, capability_key string, head_print string, head_text string, tail_print string, tail_text string"


def settled(text: Column) -> Column:
    """The text with volatile values masked and all white space taken out."""
    for pattern in VOLATILE:
        text = F.regexp_replace(text, pattern, "~")
    return F.regexp_replace(text, r"[\s\p{Z}]+", "")


def _equal_before(column: pa.Array) -> np.ndarray:
    """Whether each value is non-null and equals the one before; False for the first."""
    import pyarrow.compute as pc

    out = np.zeros(len(column), bool)
    if len(column) > 1:
        out[1:] = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    return out


def _runs_of_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    parts = list(batches)
    t = pa.Table.from_batches(parts).combine_chunks() if parts else None
    if t is None or not t.num_rows:
        return
    col = {c: pa.concat_arrays(t[c].chunks) for c in t.column_names}
    same_session = _equal_before(col["session_key"])
    fresh = ~(same_session & _equal_before(col["event_key"]))  # a repeated row lies next to its record
    if not fresh.all():
        keep = pa.array(np.flatnonzero(fresh))
        col = {c: x.take(keep) for c, x in col.items()}
        same_session = _equal_before(col["session_key"])
    n = len(col["session_key"])
    match = same_session & _equal_before(col["capability_key"]) & (_equal_before(col["input_fingerprint"]) | _equal_before(col["settled"]))
    starts = np.flatnonzero(~match)
    run = np.searchsorted(starts, np.arange(n), side="right") - 1
    length = np.bincount(run, minlength=len(starts))
    last = starts + length - 1
    at = col["at"].fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    up = np.maximum.reduceat(at, starts)
    low = np.minimum.reduceat(np.where(at == np.iinfo(np.int64).min, np.iinfo(np.int64).max, at), starts)
    edge = np.zeros(len(starts), np.int32)
    edge[0] |= 1
    edge[-1] |= 2
    k = np.flatnonzero((length > 1) | (edge > 0))
    s, e = pa.array(starts[k]), pa.array(last[k])
    void = up[k] == np.iinfo(np.int64).min
    take = lambda name, i: col[name].take(i)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(len(k), TaskContext.get().partitionId(), np.int32)), pa.array(edge[k]), take("session_key", s), take("event_key", s), take("event_key", e),
        pa.array(length[k].astype(np.int64)), pa.array(low[k], mask=void), pa.array(up[k], mask=void), take("capability_key", s),
        take("input_fingerprint", s), take("settled", s), take("input_fingerprint", e), take("settled", e),
    ], schema=_SCHEMA)


def runs(events: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per longest run of at least two matching capability invocations of a session.

    (session_key, capability_key, first_event_key, last_event_key, run_length, first_at, last_at, duration_ms).
    Order is (record_start_offset, content_index, event_ordinal, event_key); repeated rows of an event count
    once; other event kinds don't break a run. Two events match if capability_key is equal and not null and
    either input_fingerprint is equal and not null or the settled input_text is (empty texts are equal, null ones not).
    Rows without session or event key are dropped; null positions sort first; clocks don't matter for the
    order, first_at and last_at are the least and greatest times in the run, null if none is known.
    """
    calls = events.where("event_kind = 'capability-invocation' and session_key is not null and event_key is not null")
    order = ["session_key", "record_start_offset", "content_index", "event_ordinal", "event_key"]
    slim = calls.select(*order, "capability_key", "input_fingerprint", F.md5(settled(F.col("input_text"))).alias("settled"), F.unix_micros("observed_at").alias("at"))
    slim = cut(slim)  # one scan and one run of the patterns; counting and the sample of the range exchange read what is left
    pieces = max(1, math.ceil(slim.count() / chunk), int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = cut(slim.repartitionByRange(pieces, *order).sortWithinPartitions(*order).mapInArrow(_runs_of_chunk, _DDL))
    inner = found.where("edge = 0")
    # The first and the last run of every chunk, in order. A chunk that is one run has one row.
    line = Window.partitionBy("session_key").orderBy("chunk", "edge")
    before = lambda c: F.lag(c).over(line)
    joined = (
        (before("chunk") < F.col("chunk")) & (before("capability_key") == F.col("capability_key"))
        & ((before("tail_print") == F.col("head_print")) | (before("tail_text") == F.col("head_text")))
    )
    parts = found.where("edge > 0").withColumn("starts", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    parts = parts.withColumn("run", F.sum("starts").over(line)).withColumn("place", F.struct("chunk", "edge"))
    outer = parts.groupBy("session_key", "run").agg(
        F.min_by("first_event_key", "place").alias("first_event_key"), F.max_by("last_event_key", "place").alias("last_event_key"), F.sum("run_length").alias("run_length"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min("capability_key").alias("capability_key"),
    ).where("run_length > 1")
    columns = ["session_key", "capability_key", "first_event_key", "last_event_key", "run_length", "first_at", "last_at"]
    return inner.select(*columns).unionByName(outer.select(*columns)).select(
        *columns[:5], F.timestamp_micros("first_at").alias("first_at"), F.timestamp_micros("last_at").alias("last_at"),
        F.floor((F.col("last_at") - F.col("first_at")) / 1000).alias("duration_ms"),
    )
