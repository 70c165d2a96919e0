"""What becomes of sources and sessions over time: classified changes, hiding and purging, rebuilt projections, lineage of copies, gaps, review queues, documents and transcripts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators import windows
from turnmill.sources.versions import VersionedTable


def classify_changes(old: DataFrame, new: DataFrame, key: str = "source") -> DataFrame:
    """(key, change): unchanged, append (longer, and what was there is the same), replace, new, missing, or excluded.

    old: key, size, head (a digest of its first `size` bytes); new: key, size, head (a digest of as many first bytes as old had, or of all), excluded (boolean). One row a key each."""
    both = old.select(key, F.col("size").alias("_s"), F.col("head").alias("_h"), F.lit(1).alias("_old")).join(new.select(key, "size", "head", "excluded", F.lit(1).alias("_new")), key, "full_outer")
    same = F.col("_h").eqNullSafe(F.col("head"))
    change = (
        F.when(F.col("_new").isNull(), "missing").when(F.coalesce("excluded", F.lit(False)), "excluded").when(F.col("_old").isNull(), "new")
        .when(same & (F.col("size") == F.col("_s")), "unchanged").when(same & (F.col("size") > F.col("_s")), "append").otherwise("replace")
    )
    return both.select(key, change.alias("change"))


def source_states(commands: DataFrame, key: str = "sessionKey") -> DataFrame:
    """(key, state): what the latest command made of each source: visible, hidden or purged. A purge is for good.

    commands: (key, sequence, command) with command include, exclude or purge, in any order and more than once."""
    seq = F.max(F.struct("sequence", "command"))
    out = commands.where(F.col(key).isNotNull()).groupBy(key).agg(seq.alias("_last"), F.max((F.col("command") == "purge").cast("int")).alias("_gone"))
    return out.select(key, F.when(F.col("_gone") == 1, "purged").when(F.col("_last.command") == "exclude", "hidden").otherwise("visible").alias("state"))


def shown(rows: DataFrame, states: DataFrame, key: str = "sessionKey") -> DataFrame:
    """Rows of sources that are neither hidden nor purged; they are out at once, before any purge has run."""
    return rows.join(states.where("state != 'visible'").select(key), key, "left_anti")


def purge(table: VersionedTable, states: DataFrame, key: str) -> bool:
    """Rewrites a versioned table without the rows of purged sources. False if there is nothing to remove."""
    rows = table.read()
    gone = states.where("state = 'purged'").select(key)
    if rows is None or rows.join(gone, key, "left_semi").isEmpty():
        return False
    return table.write(rows.join(gone, key, "left_anti"), keep=1)


def rebuilt(table: VersionedTable, log: Callable[[], DataFrame], project: Callable[[DataFrame], DataFrame], owner: str, sequence: str) -> DataFrame:
    """A projection built anew beside the current one: of all owners up to the position the log has at the start, then of those that changed meanwhile, until none did;
    only then it becomes the current version. project makes the rows of the owners of a log, and each owner's rows are its own.

    log: (owner, sequence, ...). Gives the new current rows."""
    at = log().agg(F.max(sequence)).first()[0]
    table.write(project(log().where(F.col(sequence) <= at) if at is not None else log()))
    while at is not None and (now := log().agg(F.max(sequence)).first()[0]) > at:
        late = log().where((F.col(sequence) > at) & (F.col(sequence) <= now)).select(owner).distinct()
        fresh = project(log().where(F.col(sequence) <= now).join(late, owner, "left_semi"))
        table.write(table.read().join(late, owner, "left_anti").unionByName(fresh))
        at = now
    return table.read()


def caught_up(held: DataFrame, log: DataFrame, project: Callable[[DataFrame], DataFrame], owner: str, sequence: str, after: int) -> DataFrame:
    """A projection after the part of a log behind a position: only owners that are in it are made anew, from all of their log."""
    late = log.where(F.col(sequence) > after).select(owner).distinct()
    return held.join(late, owner, "left_anti").unionByName(project(log.join(late, owner, "left_semi")))


def lineages(sessions: DataFrame) -> DataFrame:
    """(sessionKey, lineage, method, confidence): copies of a session under one lineage key, the least session key of its group.

    Sessions belong together by their given group (strong if its method is explicit-lineage for a member or two members share a fingerprint), or without one by an equal first-turn fingerprint (weak). Alone: none."""
    by = F.coalesce(F.concat(F.lit("g"), "groupKey"), F.concat(F.lit("f"), "fingerprint"), F.concat(F.lit("s"), "sessionKey"))
    rows = sessions.withColumn("_by", by)
    prints = rows.groupBy("_by", "fingerprint").agg(F.count(F.lit(1)).alias("_n"), F.min("sessionKey").alias("_least"), F.max((F.col("method") == "explicit-lineage").cast("int")).alias("_explicit"))
    groups = prints.groupBy("_by").agg(F.min("_least").alias("lineage"), F.sum("_n").alias("members"), F.coalesce(F.max("_explicit"), F.lit(0)).alias("_explicit"), F.coalesce(F.max(F.when(F.col("fingerprint").isNotNull(), F.col("_n"))), F.lit(0)).alias("_same"))
    grouped = F.col("_by").startswith("g")
    confidence = F.when(F.col("members") == 1, "none").when(grouped & ((F.col("_explicit") == 1) | (F.col("_same") >= 2)), "strong").otherwise("weak")
    return rows.select("sessionKey", "_by").join(groups, "_by").select("sessionKey", "lineage", "members", confidence.alias("confidence"))


def gap_sessions(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, session_start, session_end, n): stretches of rows of a key without a pause of `gap`; a stretch ends `gap` behind its last row. For streams as for tables."""
    w = F.session_window(at, gap)
    return rows.where(F.col(at).isNotNull()).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def review_queue(entries: DataFrame, owner: str, status: str, kind: str | None, limit: int, after: int | None = None) -> DataFrame:
    """The next entries of an owner to review, by id: those of a status and, if named, of a kind, which their JSON metadata tells ($.kind). after is the last id seen."""
    rows = entries.where((F.col("owner") == owner) & (F.col("status") == status))
    if kind is not None:
        rows = rows.where(F.get_json_object("metadata", "$.kind") == kind)
    if after is not None:
        rows = rows.where(F.col("id") > after)
    return rows.orderBy("id").limit(limit)


def heat(operations: DataFrame, scene: str = "scene") -> DataFrame:
    """(scene, heat): 1 for its creation and for each update; a merge has 1 and the heat of each of its sources.

    operations: (scene, op) with op create or update, and (scene, op = merge, merged array of scenes, which are no merges themselves). Each source of a merge counts once."""
    own = operations.where("op in ('create', 'update')").groupBy(scene).agg(F.count(F.lit(1)).alias("heat"))
    parts = operations.where("op = 'merge'").select(F.col(scene).alias("_m"), F.explode_outer(F.array_distinct("merged")).alias(scene)).join(own, scene, "left")
    merges = parts.groupBy("_m").agg((F.lit(1) + F.coalesce(F.sum("heat"), F.lit(0))).alias("heat")).select(F.col("_m").alias(scene), "heat")
    return own.unionByName(merges).groupBy(scene).agg(F.sum("heat").alias("heat"))


def documents(messages: DataFrame, conversation: str, order: str, fields: list[str], page: int = 500) -> DataFrame:
    """(conversation, page_no, document): conversations as portable JSON arrays of their messages in order, `page` numbers of the order on a page, so none is held as a whole."""
    rows = messages.select(conversation, order, *fields).withColumn("page_no", F.floor(F.col(order) / page))
    held = F.transform(F.array_sort(F.collect_list(F.struct(order, *fields))), lambda x: F.struct(x[order].alias(order), *(x[f].alias(f) for f in fields)))
    return rows.groupBy(conversation, "page_no").agg(F.to_json(held).alias("document"))


def imported(docs: DataFrame, conversation: str, order: str, fields: list[str]) -> DataFrame:
    """The messages of documents(): (conversation, order, fields as text). Pages that aren't such JSON have none."""
    kind = f"array<struct<{order}: bigint, {', '.join(f'{f}: string' for f in fields)}>>"
    return docs.select(conversation, F.inline(F.coalesce(F.from_json("document", kind), F.array().cast(kind))))


def transcript(entries: DataFrame, conversation: str, order: str, kind: str, role: str, text: str, page: int = 500) -> DataFrame:
    """(conversation, page_no, body): entries as text in order: messages with their speaker, and each run of others as one line that counts them.

    A run belongs to the page of its first entry; pages are stretches of the order."""
    said = F.coalesce(F.col(kind) == "message", F.lit(False))
    rows = entries.select(conversation, F.col(order).cast("bigint").alias(order), said.alias("_said"), F.concat(F.coalesce(role, F.lit("?")), F.lit(": "), F.coalesce(text, F.lit(""))).alias("_line"))
    runs = windows.numbered(rows, [conversation], [order])
    line = Window.partitionBy(conversation).orderBy("row_no")
    # the runs of others: their rows less their numbers are the same from first to last
    others = runs.where(~F.col("_said")).withColumn("_g", F.col("row_no") - F.row_number().over(line)).groupBy(conversation, "_g").agg(F.min(order).alias(order), F.min("row_no").alias("row_no"), F.count(F.lit(1)).alias("_n"))
    lines = runs.where("_said").select(conversation, order, "row_no", "_line").unionByName(others.select(conversation, order, "row_no", F.concat(F.lit("["), F.col("_n").cast("string"), F.lit(" other entries]")).alias("_line")))
    paged = lines.withColumn("page_no", F.floor(F.col(order) / page))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "_line"))), lambda x: x["_line"]), "\n")
    return paged.groupBy(conversation, "page_no").agg(body.alias("body"))


def table_status(tables: dict[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """(name, rows, keys, nullKeys, lastAt): one row a table: its rows, distinct and missing keys, and its latest time in microseconds. tables: name -> (rows, key, time or None)."""
    out = None
    for name, (rows, key, at) in tables.items():
        one = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(F.col(key).isNull()).alias("nullKeys"), (F.max(F.unix_micros(F.col(at).cast("timestamp"))) if at else F.lit(None).cast("bigint")).alias("lastAt"))
        one = one.select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def session_analysis(turns: DataFrame, uses: DataFrame, closures: DataFrame, states: DataFrame) -> DataFrame:
    """One row a turn of each session: its closure and visibility, its uses and failures, how many repeat an input of the turn and how many retry a failed or cancelled one, and
    why it is left out of analyses, if it is: purged, hidden, rolled-back or not-sealed. closures: (turnKey, closure)."""
    again = windows.retries(uses.where("turnKey is not null"), ["turnKey"], ["recordStart", "contentIndex", "ordinal", "useKey"], ["failed", "cancelled"]).groupBy("turnKey").agg(F.sum("same_input_repeat_count").alias("repeats"), F.sum("retry_after_failure_count").alias("retries"))
    own = uses.where("turnKey is not null").groupBy("turnKey").agg(F.count(F.lit(1)).alias("uses"), F.count_if(F.col("terminalState") == "failed").alias("failed"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = turns.select("turnKey", "sessionKey", "visibility").join(closures.select("turnKey", "closure"), "turnKey").join(own, "turnKey", "left").join(again, "turnKey", "left").join(states, "sessionKey", "left")
    why = F.when(F.col("state") == "purged", "purged").when(F.col("state") == "hidden", "hidden").when(F.col("visibility") != "active", "rolled-back").when(F.col("closure") == "open", "not-sealed")
    return rows.select("sessionKey", "turnKey", "closure", "visibility", n("uses"), n("failed"), n("repeats"), n("retries"), why.alias("excluded"))


def state_maps(rows: DataFrame, key: str, state: Column, name: str = "states") -> DataFrame:
    """(key, states): how often each state occurs per key, as one map; the states are a small closed set."""
    counts = rows.groupBy(key, state.alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_s").isNotNull()).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_s", "_n")))).alias(name))


