"""Mixing sources to target weights by weighted fair queueing.

Every document has a place in the shuffled queue of its source and a virtual finish time: the tokens of its
source up to and including it, divided by the source's weight. Taking documents in order of finish time serves
all sources in proportion to their weights at every prefix, so the mix is the queue cut at the total budget.

Token sums are built in two levels: sums of (source, bucket of the shuffle) are few and give each bucket its
offset; inside a bucket a window adds up its documents. A source that holds most of the corpus is thus spread over
all its buckets.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnmill.session import cut

#: Documents of one bucket of a source's shuffled queue, about, if the source holds all of them; and the most buckets that a hash has bits for.
BUCKET_ROWS, MOST_BUCKETS = 4096, 1 << 24
#: Targets that a mix may have.
TARGETS = 10_000
#: The folder of public tokenizers and the rank file used to count.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_multi_50k.tiktoken"

# Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(folder: str = TOKENIZERS, ranks: str = RANKS):
    import tiktoken

    with open(f"{folder}/{ranks}", "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def _counter(folder: str, ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            if codec is None:
                codec = encoding(folder, ranks)
            n = [len(codec.encode_ordinary(t)) if t else 0 for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def counted(documents: DataFrame, folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, n_tokens) with tokens of the whole text; null and empty texts have 0."""
    return documents.select("doc_id", "source", "text").mapInArrow(_counter(folder, ranks), "doc_id bigint, source string, n_tokens bigint")


def mix(sizes: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    sizes: (doc_id, source, n_tokens); targets: (source, target_share, max_repeats), one row a source.
    mix: (doc_id, source, copy_no, n_tokens, virtual_finish), in order of virtual_finish. copy_no runs from 1 to
    at most max_repeats. Budget in tokens; None is the largest at which every source that has tokens can fill its share.
    A larger budget is lowered to that one, so that shares are met rather than the size.
    report: one row per target: (source, target_share, weight, actual_share, tokens, documents, copies, most_repeats, available_tokens).
    Targets without tokens have actual_share 0; the others share their part in proportion (weight). Sources that aren't
    targets, null sources and documents without id or tokens aren't used; repeated rows of a document count once.
    Null or non-positive shares or repeats take a target out. Ties in the shuffle are broken by doc_id.
    """
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("bigint").alias("max_repeats"))
    if goal.limit(TARGETS + 1).count() > TARGETS:  # one window and one report are over all of them
        raise ValueError(f"more than {TARGETS} targets")
    mixed = F.xxhash64(F.lit(seed), "doc_id")
    docs = sizes.where("doc_id is not null and source is not null and n_tokens > 0").groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens")).alias("v"))
    docs = docs.select("doc_id", "v.source", "v.n_tokens", mixed.alias("place"))
    docs = cut(docs.join(goal.where("target_share > 0 and max_repeats > 0").select("source"), "source", "left_semi"))
    buckets = min(MOST_BUCKETS, max(1, math.ceil(docs.count() / BUCKET_ROWS)))
    docs = docs.withColumn("bucket", F.pmod(F.shiftrightunsigned("place", 40), F.lit(buckets)))

    # (source, bucket) sums: at most a row for each bucket and target
    by_bucket = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_bucket.withColumn("offset", F.coalesce(F.sum("tokens").over(upto), F.lit(0)))
    totals = by_bucket.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    plan = goal.join(totals, "source").where("target_share > 0 and max_repeats > 0")
    whole = Window.partitionBy(F.lit(1))  # over targets
    plan = plan.withColumn("weight", F.col("target_share") / F.sum("target_share").over(whole))
    plan = plan.withColumn("budget", F.min(F.col("max_repeats") * F.col("available_tokens") / F.col("weight")).over(whole))
    if budget is not None:
        plan = plan.withColumn("budget", F.least("budget", F.lit(float(budget))))
    plan = cut(plan)

    inside = Window.partitionBy("source", "bucket").orderBy("place", "doc_id")
    queue = docs.withColumn("own", F.sum("n_tokens").over(inside)).join(offsets.select("source", "bucket", "offset"), ["source", "bucket"])
    queue = queue.join(plan.select("source", "weight", "budget", "max_repeats", "available_tokens"), "source").withColumn("position", F.col("own") + F.col("offset"))
    # copy k of a document follows k-1 whole passes over its source
    last = F.least("max_repeats", F.floor((F.col("budget") * F.col("weight") + F.lit(1e-6) - F.col("position")) / F.col("available_tokens")) + 1).cast("int")
    served = queue.withColumn("last", last).where("last >= 1").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("last"))))
    finish = ((F.col("copy_no") - 1) * F.col("available_tokens") + F.col("position")) / F.col("weight")
    out = served.select("doc_id", "source", F.col("copy_no").cast("bigint").alias("copy_no"), "n_tokens", finish.alias("virtual_finish"))

    per_doc = served.where("copy_no = last").select("source", "n_tokens", "last")
    got = per_doc.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("last")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("last").alias("copies"), F.max("last").cast("bigint").alias("most_repeats")
    )
    report = goal.join(plan.select("source", "weight", "available_tokens"), "source", "left").join(got, "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = report.select(
        "source", "target_share", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce(F.col("tokens") / F.sum("tokens").over(whole), F.lit(0.0)).alias("actual_share"), *map(zero, ["tokens", "documents", "copies", "most_repeats", "available_tokens"]),
    )
    return out.orderBy("virtual_finish", "source", "doc_id", "copy_no"), report
