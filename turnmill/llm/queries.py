"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import conversations, leaks, mixing, pii, runs, truncation
from turnmill.llm.sql import SQL  # noqa: F401
from turnmill.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.found(table(spark, folder, "history_events"), table(spark, folder, "name_lexicon"))
    return found.select("event_key", "field_name", "pii_kind", "start_at").distinct()


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "history_events").select("event_key", "ingested_at", *pii.FIELDS)
    return pii.masked(rows, table(spark, folder, "name_lexicon"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return runs.runs(table(spark, folder, "history_events")).select("session_key", "first_event_key", "last_event_key", "run_length")


def _whole(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversations(conversations.blocks(spark, f"{folder}/session_messages.parquet"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _whole(spark, folder).select("session_key", "msg_index", "entry_id")


def p5_conversations(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "session_messages").where("lower(trim(entry_kind)) = 'message'").select("session_key", F.coalesce("entry_id", F.lit("")).alias("entry_id"), "seq_no", "markdown", "created_at")
    texts = texts.groupBy("session_key", "entry_id", "seq_no").agg(F.min(F.struct("created_at", "markdown")).alias("m"))
    return _whole(spark, folder).join(texts, ["session_key", "entry_id", "seq_no"]).select("session_key", "msg_index", "role", "entry_id", "m.markdown", F.unix_micros(F.col("m.created_at").cast("timestamp")).alias("created_us"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.where(F.col("exact_words") >= leaks.SPAN).select("doc_id", "item_id")


def p6_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(mixing.counted(table(spark, folder, "documents")), table(spark, folder, "mixture_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(mixing.counted(table(spark, folder, "documents")), table(spark, folder, "mixture_targets"))[1]


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.scored(table(spark, folder, "documents")).where("is_cut and doc_id is not null").select("doc_id").distinct()


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.rates(truncation.scored(table(spark, folder, "documents")))


QUERIES = {
    "p2_found": p2_found, "p2_masked": p2_masked, "p3_found": p3_found, "p5_found": p5_found, "p5_conversations": p5_conversations, "p6_found": p6_found, "p6_overlaps": p6_overlaps, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_rates": p8_rates,
}

