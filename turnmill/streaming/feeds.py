"""Incremental processing with Structured Streaming.

Facts may be corrected however late, so nothing here drops by watermark: batches are folded into versioned state,
keyed and idempotent. Watermarks are only used where a result is final by definition (closed day buckets).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from turnmill.operators import changefeed
from turnmill.sources.versions import VersionedTable


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity of a stream, which its checkpoint was given at the start: a new checkpoint is another stream, even in the same folder."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def fold_stream(changes: DataFrame, table: VersionedTable, keys: list[str], sequence: list[str], payload: list[str], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Folds a stream of changes into a versioned state with tombstones. A batch that is replayed writes nothing new; a stream with another
    checkpoint folds into the same state from where that is. Only the buckets of keys that a batch has are read and written.

    trigger: as of writeStream.trigger, what is there now by default, or {"processingTime": "30 seconds"} to go on."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            touched = [r[0] for r in batch.select(table.bucket().alias("b")).distinct().collect()]  # at most as many as the table has buckets
            table.write(changefeed.fold(batch, keys, sequence, payload, base=table.read(touched)), stream_id(batch.sparkSession, checkpoint), batch_id, only=touched)
        finally:
            batch.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def tumbling(rows: DataFrame, at: str, width: str, lateness: str, offset: str | None = None) -> DataFrame:
    """(bucket_start, n): closed tumbling windows of a stream or table. Weeks from Monday: width 7 days, offset 4 days."""
    w = F.window(at, width, width, offset) if offset else F.window(at, width)
    return rows.withWatermark(at, lateness).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("bucket_start"), "n")


def change_log(log: DataFrame, owner: str, sequence: str, after: int | None = None) -> DataFrame:
    """What a projection must catch up on: the latest position per owner beyond a stored one."""
    rows = log if after is None else log.where(F.col(sequence) > after)
    return rows.groupBy(owner).agg(F.max(sequence).alias(sequence))


_TURNS = "source string, turn_no bigint, problem string, finalAnswer string, terminal string, messages bigint, closed int"


def assembled_turns(events: DataFrame, idle_ms: int, lateness: str) -> DataFrame:
    """Turns of growing logs, as a stream: (source, turn_no, problem, finalAnswer, terminal, messages, closed), as jsonl.log_turns gives them for whole logs.

    events: a stream of (source, at timestamp, line_start, kind, role, text, lifecycle); what is appended to a log comes in later batches. The open turn of each log waits in state: it is
    emitted with closed 1 when the next one begins, and with closed 0 when nothing came for idle_ms of event time; what comes later then still belongs to it and makes it be emitted again,
    so the last row of a turn holds. One small row of state stays for each log."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns = [c.split()[0] for c in _TURNS.split(", ")]

    def run(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"no": 0, "open": None, "last": 0, "told": True}
        out = []

        def emit(closed: int) -> None:
            if held["open"] is not None:
                out.append((key[0], held["no"], *held["open"], closed))

        if state.hasTimedOut:
            if not held["told"]:
                emit(0)
            held["told"] = True
        else:
            rows = pd.concat(list(frames)).sort_values("line_start", kind="stable")
            for kind, role, text, lifecycle, at in zip(*(rows[c].tolist() for c in ("kind", "role", "text", "lifecycle", "at_ms")), strict=True):
                held["last"] = max(held["last"], int(at))
                said = kind == "visible-message"
                if said and role == "user":
                    emit(1)
                    held["no"], held["open"] = held["no"] + 1, [text, None, None, 0]
                if held["open"] is not None:
                    turn = held["open"]
                    turn[3] += said
                    if said and role == "assistant":
                        turn[1] = text
                    if lifecycle in ("completed", "aborted"):
                        turn[2] = lifecycle
                    held["told"] = False
        state.update((json.dumps(held),))
        if not held["told"]:
            state.setTimeoutTimestamp(max(held["last"], state.getCurrentWatermarkMs()) + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=columns)

    rows = events.withWatermark("at", lateness).withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("source").applyInPandasWithState(run, _TURNS, "held string", "append", GroupStateTimeout.EventTimeTimeout)


def rolled_back(events: DataFrame, session: str, order: list[str], turn: str, sealed: str, rollback: str) -> DataFrame:
    """(session, turn, state): turns after replaying rollbacks in order. A rollback of n turns the last n active sealed turns into
    rolled-back ones; if there are fewer, those there are, and the rest of the session's open turns become unresolved.

    events: one row per seal (sealed is true, turn) or rollback (rollback is n). Read in order per session as a stream; only the
    stack of active turns of one session is held."""
    schema = pa.schema([(session, pa.string()), (turn, pa.string()), ("state", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, active, out = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=schema)
                out.clear()

        for batch in batches:
            for s, t, is_sealed, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (session, turn, sealed, rollback)), strict=True):
                if s != now:
                    out.extend((now, x, "active") for x in active)
                    now, active = s, []
                if n:
                    gone = active[-n:]
                    del active[-n:]
                    out.extend((s, x, "rolled-back") for x in gone)
                elif is_sealed:
                    active.append(t)
                elif t is not None:
                    out.append((s, t, "unresolved"))
            yield from flush()
        out.extend((now, x, "active") for x in active)
        yield from flush()

    columns = [session, *[c for c in order if c != session], *[c for c in (turn, sealed, rollback) if c not in order]]
    rows = events.select(*columns).repartition(session).sortWithinPartitions(session, *order)
    return rows.mapInArrow(run, f"`{session}` string, `{turn}` string, state string")
