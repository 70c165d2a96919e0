"""Rebuilding conversations from message rows with keyed streaming state.

The entries of a feed are read as a stream and buffered in keyed state until their conversation closes: when the event-time
watermark (of received_at) has passed its last delivery by IDLE, or when the feed ends. Then the state decides whether the
conversation is whole, emits it and forgets it. A key of the state is a bucket of conversations, so one call of Python serves many;
of a conversation no bucket holds more than BLOCK sequence numbers, longer ones lie in several buckets.

Deliveries may be late, repeated and in any order. What comes after a conversation was emitted makes a second piece of it; pieces of
one conversation, and blocks of long ones, are merged and judged again. No row is lost: if the engine drops one behind the watermark, an error is raised.
A table is replayed in order of received_at, as bounded files, so that a batch holds a stretch of time and the state only what is open then.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnmill.session import cut, discard, fresh_dir

#: Sequence numbers of one block of state.
BLOCK = 1024
#: The block of the closing mark, which no sequence number falls into.
CLOSE = -(2**63)
#: How late a delivery may be before the watermark drops it, and how long a conversation waits for another delivery.
LATENESS, IDLE_MS = "1 second", 4 * 24 * 60 * 60 * 1000
#: Rows of one file of a replay, about, and the least number of files.
FILE_ROWS, FILES = 250_000, 8
#: Batches of a replay, or as many more as a batch of FILES_A_CORE files for each core needs.
BATCHES, FILES_A_CORE = 4, 4

# What roles plainly mean.
ROLES = {"user": "u", "human": "u", "assistant": "a", "agent": "a", "ai": "a", "model": "a", "bot": "a", "system": "s"}

#: A piece: entries in order, and whether they are by themselves a whole conversation.
_OUT = "session_key string, block bigint, whole boolean, seq_nos array<bigint>, entry_ids array<string>, codes array<string>"
_ENTRY = "session_key string, block bigint, seq_no bigint, entry_id string, code string, at timestamp"
_SUMMARY = pa.schema([
    ("session_key", pa.string()), ("block", pa.int64()), ("messages", pa.list_(pa.struct([("seq_no", pa.int64()), ("entry_id", pa.string()), ("code", pa.string())]))),
    ("entries", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("broken", pa.bool_()), ("first_role", pa.string()), ("last_role", pa.string()), ("unanswered", pa.bool_()),
])
_SUMMARY_DDL = "session_key string, block bigint, messages array<struct<seq_no: bigint, entry_id: string, code: string>>, entries bigint, low bigint, high bigint, broken boolean, first_role string, last_role string, unanswered boolean"
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256", "spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.streaming.numRecentProgressUpdates": "1000000",
}


def entries(rows: DataFrame) -> DataFrame:
    """What the state needs of each row: (session_key, block, seq_no, entry_id, code, at).

    code: e for entries that are no message; for messages the role (u, a, s, ? if it isn't plain) and, if no text is visible, a minus.
    """
    role = F.lower(F.regexp_replace(F.coalesce("speaker_role", F.lit("")), r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))
    letter = F.lit("?")
    for name, code in ROLES.items():
        letter = F.when(role == name, code).otherwise(letter)
    visible = F.coalesce(F.col("markdown"), F.lit("")).rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}\x{2800}\x{3164}]")
    is_message = F.coalesce(F.lower(F.trim("entry_kind")) == "message", F.lit(False))
    epoch = F.timestamp_micros(F.lit(0))
    return rows.where("session_key is not null").select(
        "session_key", F.coalesce(F.floor(F.col("seq_no") / BLOCK), F.lit(-1)).cast("bigint").alias("block"), F.coalesce(F.col("seq_no").cast("bigint"), F.lit(-1)).alias("seq_no"),
        F.coalesce("entry_id", F.lit("")).alias("entry_id"), F.when(is_message, F.concat(letter, F.when(visible, "").otherwise("-"))).otherwise("e").alias("code"),
        F.least(F.greatest(F.coalesce(F.col("received_at").cast("timestamp"), F.col("created_at").cast("timestamp"), epoch), epoch), F.lit("2200-01-01").cast("timestamp")).alias("at"),
    )


def released(block: int, held: dict[str, list]) -> dict:
    """What is released of a block. held: seq_no -> [[entry_id, code], ...]"""
    messages, broken = [], bool(block < 0)
    numbers = sorted(map(int, held))
    for number in numbers:
        own = held[str(number)]
        broken |= len({e for e, _ in own}) > 1
        entry, code = min(own)
        broken |= code[0] == "?"
        if code in ("u", "a", "s"):
            messages.append({"seq_no": number, "entry_id": entry, "code": code})
    spoken = [m["code"] for m in messages if m["code"] != "s"]
    return {
        "messages": messages, "entries": len(numbers), "low": numbers[0], "high": numbers[-1], "broken": broken, "first_role": spoken[0] if spoken else None, "last_role": spoken[-1] if spoken else None,
        "unanswered": any(a == b == "u" for a, b in zip(spoken, spoken[1:], strict=False)),
    }


def _is_whole(block: int, r: dict) -> bool:
    """Whether a released block is by itself a whole conversation."""
    return block == 0 and not r["broken"] and not r["unanswered"] and (r["low"], r["high"]) == (0, r["entries"] - 1) and (r["first_role"], r["last_role"]) == ("u", "a")


def _keep(own: list[list[str]], entry: str, code: str) -> None:
    """Adds an entry to those of its number. Two ids tell that the number is broken, so the two least are enough, each with its least code."""
    for x in own:
        if x[0] == entry:
            x[1] = min(x[1], code)
            return
    own.append([entry, code])
    if len(own) > 2:
        own.remove(max(own))


def _pieces(done: list[tuple[str, int, dict[str, list]]]) -> pd.DataFrame:
    out: dict[str, list] = {c.split()[0]: [] for c in _OUT.split(", ")}
    for session, block, held in done:
        flat = [(int(n), entry, code) for n in sorted(held, key=int) for entry, code in sorted(held[n])]
        for c, x in zip(out, (session, block, _is_whole(block, released(block, held)), *map(list, zip(*flat, strict=True))), strict=True):
            out[c].append(x)
    return pd.DataFrame(out)


def _buffer(idle_ms: int):
    """The state of a bucket: {session: {block: [time of the last delivery, {seq_no: [[entry_id, code], ...]}]}}, as JSON."""

    def run(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_now: dict[str, dict] = json.loads(state.get[0]) if state.exists else {}
        for df in frames if not state.hasTimedOut else ():
            for session, block, number, entry, code, at in zip(*(df[c].tolist() for c in ("session_key", "block", "seq_no", "entry_id", "code", "at_ms")), strict=True):
                if block != CLOSE:
                    place = open_now.setdefault(session, {}).setdefault(str(block), [at, {}])
                    place[0] = max(place[0], at)
                    _keep(place[1].setdefault(str(number), []), entry, code)
        passed = state.getCurrentWatermarkMs()
        done, wait = [], None
        for session in list(open_now):
            blocks_of = open_now[session]
            for block in [b for b, (last, _) in blocks_of.items() if last + idle_ms <= passed]:
                done.append((session, int(block), blocks_of.pop(block)[1]))
            if blocks_of:
                wait = min([last for last, _ in blocks_of.values()] + ([] if wait is None else [wait]))
            else:
                del open_now[session]
        if open_now:
            state.update((json.dumps(open_now),))
            state.setTimeoutTimestamp(wait + idle_ms)
        elif state.exists:
            state.remove()
        if done:
            yield _pieces(done)

    return run


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_blocks(stream: DataFrame, sink: str, checkpoint: str, lateness: str = LATENESS, idle_ms: int = IDLE_MS, buckets: int | None = None):
    """Starts the query that buffers a stream of entries() and appends pieces to the folder sink. buckets are the keys of the state, the same in every run on a checkpoint; None is eight a shuffle partition."""
    buckets = buckets or 8 * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("session_key", "block"), F.lit(buckets)).alias("bucket")
    held = stream.withWatermark("at", lateness).select("*", F.unix_millis("at").alias("at_ms"), bucket).groupBy("bucket")
    pieces = held.applyInPandasWithState(_buffer(idle_ms), _OUT, "held string", "append", GroupStateTimeout.EventTimeTimeout)
    return pieces.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def ended(query) -> None:
    """Waits for a query of stream_blocks; an error if rows came behind its watermark, which the engine then has dropped."""
    query.awaitTermination()
    lost = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    if lost:
        raise ValueError(f"{lost} rows were later than the lateness of the stream allows")


def _feed(spark: SparkSession, rows: DataFrame, folder: str, files: int) -> bool:
    """Writes entries() in order of time as files, and a closing row far behind, after which nothing still waits. Whether the files' times tell their order, which the stream reads them in."""
    rows.repartitionByRange(files, "at", F.xxhash64("session_key", "seq_no")).write.parquet(folder)
    far = spark.range(1, numPartitions=1).select(
        F.lit("").alias("session_key"), F.lit(CLOSE).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("seq_no"), F.lit("").alias("entry_id"), F.lit("e").alias("code"), F.lit("2250-01-01 00:00:00").cast("timestamp").alias("at")
    )
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    named = lambda: {s.getPath().getName(): s for s in fs.listStatus(place) if s.getPath().getName().startswith("part-")}
    before = sorted(named())  # by number of partition
    far.write.mode("append").parquet(folder)
    order = [*before, *sorted(set(named()) - set(before))]
    start = 1_000_000_000_000
    for n, name in enumerate(order):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), start + 1000 * n, -1)
    now = named()
    return all(now[name].getModificationTime() == start + 1000 * n for n, name in enumerate(order))


def blocks(spark: SparkSession, path: str, files_per_batch: int | None = None, lateness: str = LATENESS, idle_ms: int = IDLE_MS) -> DataFrame:
    """All pieces (see stream_blocks) of the message table at path, replayed as a stream in order of received_at and closed at its end.

    files_per_batch bounds a micro-batch; None makes BATCHES, and more where a batch would have over FILES_A_CORE files for each core. The state has a partition for each core.
    Where a file system can't set times, the files have no order that a stream can see, and all are one batch.
    """
    base, cores = fresh_dir(spark, "conversations"), spark.sparkContext.defaultParallelism
    rows = spark.read.parquet(path)
    files = max(FILES, math.ceil(rows.count() / FILE_ROWS))
    ordered = _feed(spark, entries(rows), f"{base}/feed", files)
    batch = files_per_batch or min(FILES_A_CORE * cores, math.ceil((files + 1) / BATCHES))
    with _settings(spark, _STATE | {"spark.sql.shuffle.partitions": str(cores)}):
        reader = spark.readStream.schema(_ENTRY)
        stream = (reader.option("maxFilesPerTrigger", batch) if ordered else reader).option("maxFileAge", "3650d").parquet(f"{base}/feed")
        ended(stream_blocks(stream, f"{base}/blocks", f"{base}/state", lateness, idle_ms))
    for done in ("feed", "state"):
        discard(spark, f"{base}/{done}")
    return spark.read.schema(_OUT).parquet(f"{base}/blocks")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            held: dict[str, list] = {}
            for x in row["found"]:
                held[str(x["seq_no"])] = [[x["low"]["entry_id"], x["low"]["code"]], *([[x["high"], "e"]] if x["high"] != x["low"]["entry_id"] else [])]
            out.append({"session_key": row["session_key"], "block": row["block"], **released(row["block"], held)})
        yield pa.RecordBatch.from_pylist(out, schema=_SUMMARY)


def _merged(pieces: DataFrame) -> DataFrame:
    """One summary (see released) a block of conversations that have several pieces. The groups are numbers, then blocks of at most BLOCK numbers."""
    x = pieces.select("session_key", "block", F.explode(F.arrays_zip("seq_nos", "entry_ids", "codes")).alias("x")).select("session_key", "block", F.col("x.seq_nos").alias("seq_no"), F.col("x.entry_ids").alias("entry_id"), F.col("x.codes").alias("code"))
    one = x.groupBy("session_key", "block", "seq_no").agg(F.min(F.struct("entry_id", "code")).alias("low"), F.max("entry_id").alias("high"))
    return one.groupBy("session_key", "block").agg(F.collect_list(F.struct("seq_no", "low", "high")).alias("found")).mapInArrow(_summaries, _SUMMARY_DDL)


def conversations(pieces: DataFrame) -> DataFrame:
    """(session_key, msg_index, entry_id, role, seq_no) of the conversations that are whole.

    Messages are entries of kind message with visible text, numbered from 1 in order of seq_no. A conversation is
    left out if its numbers don't run from 0 without hole or two entry ids share one, a message's role isn't plainly
    user, assistant or system (blank messages included), it has no user message, an assistant message comes before the first
    user message, or a user message isn't followed by an assistant message before the next one or the end.
    Repeated rows count once; null sequence numbers break a conversation; a null entry_id counts as an empty one; rows without session_key are dropped.
    """
    many = cut(pieces.groupBy("session_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("session_key"))
    names = F.when(F.col("code") == "u", "user").when(F.col("code") == "a", "assistant").otherwise("system")
    said = F.filter(F.arrays_zip("seq_nos", "entry_ids", "codes"), lambda x: x["codes"].isin("u", "a", "s"))
    single = pieces.where("whole").join(many, "session_key", "left_anti").select("session_key", F.posexplode(said).alias("place", "m"))
    single = single.select("session_key", (F.col("place") + 1).cast("bigint").alias("msg_index"), F.col("m.entry_ids").alias("entry_id"), F.col("m.codes").alias("code"), F.col("m.seq_nos").alias("seq_no"))
    return single.unionByName(_stitched(cut(_merged(pieces.join(many, "session_key", "left_semi"))))).select("session_key", "msg_index", "entry_id", names.alias("role"), "seq_no")


def _stitched(summaries: DataFrame) -> DataFrame:
    """The messages of the whole ones among conversations of several blocks or pieces. Windows are over the blocks of a conversation."""
    line = Window.partitionBy("session_key").orderBy("block")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    s = summaries.select(
        "session_key", "block", "entries", "low", "high", "broken", "unanswered", "first_role", F.row_number().over(line).alias("n"), F.lead("block").over(line).alias("next"),
        F.last("last_role", ignorenulls=True).over(before).alias("role_before"), F.last("last_role", ignorenulls=True).over(line).alias("role_now"), F.coalesce(F.sum(F.size("messages")).over(before), F.lit(0)).alias("offset"),
    )
    full = (F.col("block") == F.col("n") - 1) & (F.col("low") == F.col("block") * BLOCK) & (F.col("high") == F.col("low") + F.col("entries") - 1) & (F.col("next").isNull() | (F.col("entries") == BLOCK))
    starts = F.when(F.col("role_before").isNull(), F.coalesce(F.col("first_role") != "a", F.lit(True))).otherwise(~((F.col("role_before") == "u") & F.coalesce(F.col("first_role") == "u", F.lit(False))))
    ends = F.col("next").isNotNull() | F.coalesce(F.col("role_now") == "a", F.lit(False))
    s = s.withColumn("good", full & ~F.col("broken") & ~F.col("unanswered") & starts & ends)
    kept = s.groupBy("session_key").agg(F.bool_and("good").alias("whole")).where("whole").select("session_key")
    offsets = s.select("session_key", "block", "offset")
    messages = summaries.select("session_key", "block", F.posexplode("messages").alias("place", "m")).select("session_key", "block", "place", "m.*")
    return messages.join(kept, "session_key", "left_semi").join(offsets, ["session_key", "block"]).select(
        "session_key", (F.col("offset") + F.col("place") + 1).alias("msg_index"), "entry_id", "code", "seq_no"
    )
