"""Reading evidence back: content in byte pages, events as ordered JSON lines, turn closure and the strength of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.operators.windows import numbered

# Strengths from weakest to strongest.
STRENGTHS = ("contextual", "candidate", "weak", "observed", "strong", "direct")


def byte_pages(rows: DataFrame, key: str, text: str, page_bytes: int) -> DataFrame:
    """(key, page_no, start_byte, content): the whole of each text on pages of at most page_bytes that never cut a character.

    A page takes page_bytes / 4 characters, as none has more than 4 bytes. Null and empty texts have no page; page_bytes is at least 4."""
    size = max(1, page_bytes // 4)
    known = rows.where(F.length(text) > 0).select(key, text)
    pages = known.select(key, text, F.posexplode(F.sequence(F.lit(1), F.length(text), F.lit(size))).alias("page_no", "_at"))
    return pages.select(key, "page_no", F.octet_length(F.substring(text, F.lit(1), F.col("_at") - 1)).cast("bigint").alias("start_byte"), F.substring(text, F.col("_at"), F.lit(size)).alias("content"))


def json_lines(rows: DataFrame, entity: str, order: list[str], fields: list[str]) -> DataFrame:
    """(entity, line_no, line, end_byte): rows of an entity as JSON in order, with the byte behind each line, so that pages can be cut by bytes. Long entities are worked on in stretches."""
    made = rows.select(entity, *[c for c in order if c != entity], F.to_json(F.struct(*fields)).alias("line")).withColumn("_size", F.octet_length("line") + 1)
    return numbered(made, [entity], order, "_size").select(entity, (F.col("row_no") - 1).cast("bigint").alias("line_no"), "line", F.col("end_size").cast("bigint").alias("end_byte"))


def closure(turns: DataFrame, session: str, order: list[str], at: str, clock: int, idle: int) -> DataFrame:
    """turns with `closure`: hard-sealed if a turn follows in the session, quiescent if the last one is `idle` older than the clock, else open.

    The clock is a value of the request, never the time of the run. A last turn without time is open."""
    line = Window.partitionBy(session).orderBy(*order)
    follows = F.lead(F.lit(1)).over(line).isNotNull()
    return turns.withColumn("closure", F.when(follows, "hard-sealed").when(F.col(at) + idle <= clock, "quiescent").otherwise("open"))


def strength_rank(strength: Column) -> Column:
    rank = F.lit(None).cast("int")
    for i, name in enumerate(STRENGTHS):
        rank = F.when(strength == name, i).otherwise(rank)
    return rank


def assessment(citations: DataFrame, catalog: DataFrame, statement: str, evidence: str) -> DataFrame:
    """(statement, cited, strength, limitations, rejected): the weakest strength that a statement cites and all limitations of what it cites.

    citations: (statement, evidence); catalog: (evidence, strength, limitation), one or more rows an id. A statement that cites an id twice, or one
    that isn't in the catalog, is rejected."""
    one = catalog.groupBy(evidence).agg(F.min(strength_rank(F.col("strength"))).alias("_r"), F.collect_set("limitation").alias("_l"))
    cited = citations.groupBy(statement, evidence).agg(F.count(F.lit(1)).alias("_n"))
    joined = cited.join(one.withColumn("_known", F.lit(True)), evidence, "left")
    weakest = F.lit(None).cast("string")
    for i, name in enumerate(STRENGTHS):
        weakest = F.when(F.min("_r") == i, name).otherwise(weakest)
    return joined.groupBy(statement).agg(
        F.count(F.lit(1)).alias("cited"), weakest.alias("strength"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("_l", F.array().cast("array<string>")))))).alias("limitations"),
        F.bool_or((F.col("_n") > 1) | F.col("_known").isNull()).cast("int").alias("rejected"),
    )


def record_range(rows: DataFrame, entity: str, order: list[str], first: int, last: int) -> DataFrame:
    """Records first..last (from 1, both included) of every entity in order; negative numbers count from the end."""
    at = lambda i: F.lit(i) if i > 0 else F.col("row_count") + 1 + i
    out = numbered(rows, [entity], order)
    return out.where((F.col("row_no") >= at(first)) & (F.col("row_no") <= at(last))).withColumnRenamed("row_no", "record_no").drop("row_count")


def state_as_of(rows: DataFrame, entity: str, order: list[str], item: str, state: Column, upto: int) -> DataFrame:
    """(entity, item, state): the last known state of each item among the first `upto` records of every entity. Items without a known state there are out."""
    seen = record_range(rows.withColumn("_state", state), entity, order, 1, upto).where(F.col("_state").isNotNull() & F.col(item).isNotNull())
    return seen.groupBy(entity, item).agg(F.max_by("_state", "record_no").alias("state"))


def sealed_closure(turns: DataFrame, sealed: DataFrame, ended: DataFrame, session: str, order: list[str], at: str, clock: int, idle: int) -> DataFrame:
    """closure() with evidence of the seal: a turn is also hard-sealed if it has a terminal state and a lifecycle event (sealed: turnKey), and a last turn only is quiescent
    if the end of its log was seen (ended: session)."""
    base = closure(turns, session, order, at, clock, idle)
    rows = base.join(sealed.select("turnKey", F.lit(1).alias("_sealed")).distinct(), "turnKey", "left").join(ended.select(session, F.lit(1).alias("_ended")).distinct(), session, "left")
    return rows.withColumn("closure", F.when((F.col("closure") == "hard-sealed") | (F.col("terminal").isNotNull() & F.col("_sealed").isNotNull()), "hard-sealed").when((F.col("closure") == "quiescent") & F.col("_ended").isNotNull(), "quiescent").otherwise("open")).drop("_sealed", "_ended")
