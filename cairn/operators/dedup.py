"""Sharing of chunks: dedup statistics, batch distinctness, push plans and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def dedup_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Chunks and bytes, in all and distinct, per group; ``dedup_ratio`` is the share of bytes saved.

    Chunks are counted per (group, chunk) first, so the shuffle carries each once.
    """
    per = chunks.groupBy(*by, "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.first("chunk_size_bytes").alias("size"))
    out = per.groupBy(*by).agg(F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("unique_bytes"))
    return out.withColumn("dedup_ratio", ratio(F.col("bytes") - F.col("unique_bytes"), F.col("bytes")))


def shared_chunks(layout_chunks: DataFrame) -> DataFrame:
    return layout_chunks.select("chunk_id", "object_id").distinct().groupBy("chunk_id").agg(F.count(F.lit(1)).alias("objects")).filter("objects > 1")


def reuse_stats(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: chunks of both, distinct shared ids, reused bytes (not distinct) of ``other`` and their ratio."""
    known = base.select("chunk_id").distinct().withColumn("known", F.lit(True))
    right = other.join(known, "chunk_id", "left").agg(
        F.count(F.lit(1)).alias("other_chunks"), F.count_distinct(F.when(F.col("known"), F.col("chunk_id"))).alias("shared_chunks"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("chunk_size_bytes"))), F.lit(0)).alias("reused_bytes"), F.coalesce(F.sum("chunk_size_bytes"), F.lit(0)).alias("_all"),
    )
    return base.agg(F.count(F.lit(1)).alias("base_chunks")).join(right).withColumn("reuse_ratio", ratio(F.col("reused_bytes"), F.col("_all"))).drop("_all")


def size_conflicts(batch: DataFrame) -> DataFrame:
    """Chunk ids that a batch gives with different sizes."""
    return batch.groupBy("chunk_id").agg(F.count_distinct("chunk_size_bytes").alias("sizes")).filter("sizes > 1")


def push_plan(chunks: DataFrame, desired: DataFrame, locations: DataFrame, inventory: DataFrame) -> DataFrame:
    """session_id, chunk_id, node_id, size and action (put, verify, repair) of each replica a push needs.

    ``chunks``: session_id, chunk_id, chunk_size_bytes, repeats included.
    """
    unique = chunks.groupBy("session_id", "chunk_id").agg(F.first("chunk_size_bytes").alias("size"))
    listed = locations.filter("state = 'available'").select("chunk_id", "node_id", F.lit(True).alias("listed"))
    there = inventory.select("chunk_id", "node_id", F.lit(True).alias("there"))
    plan = unique.join(desired.select("chunk_id", "node_id"), "chunk_id").join(listed, ["chunk_id", "node_id"], "left").join(there, ["chunk_id", "node_id"], "left")
    action = F.when(F.col("listed").isNull(), "put").when(F.col("there"), "verify").otherwise("repair")
    return plan.select("session_id", "chunk_id", "node_id", "size", action.alias("action"))


def push_stats(chunks: DataFrame, plan: DataFrame) -> DataFrame:
    """Counters of a push per session; put, verified and repaired count replicas."""
    read = chunks.groupBy("session_id").agg(F.sum("chunk_size_bytes").alias("bytes_read"), F.count(F.lit(1)).alias("total_chunks"), F.count_distinct("chunk_id").alias("unique_chunks"))
    sent = F.col("action") != "verify"
    done = plan.groupBy("session_id").agg(
        F.count_if(sent).alias("put_requests"), F.count_if(~sent).alias("verified_chunks"), F.count_if(F.col("action") == "repair").alias("repaired_chunks"), F.coalesce(F.sum(F.when(sent, F.col("size"))), F.lit(0)).alias("bytes_sent")
    )
    return read.join(done, "session_id", "left").na.fill(0)


def amplification(stats: DataFrame) -> DataFrame:
    """Bytes sent per byte read, and the share of replica bytes that did not have to be sent."""
    return stats.select("session_id", ratio(F.col("bytes_sent"), F.col("bytes_read")).alias("storage_byte_amplification"), ratio(F.greatest(F.col("bytes_read") - F.col("bytes_sent"), F.lit(0)), F.col("bytes_read")).alias("network_avoidance_ratio"))


def pull_stats(plan: DataFrame, have: DataFrame) -> DataFrame:
    """Counters of a restore per version, given (version_id, chunk_index) of chunks already there and sound."""
    joined = plan.join(have.withColumn("_have", F.lit(True)), ["version_id", "chunk_index"], "left")
    there = F.coalesce(F.col("_have"), F.lit(False))
    size = F.col("chunk_size_bytes")
    return joined.groupBy("version_id").agg(F.sum(size).alias("restored_bytes"), F.count(F.lit(1)).alias("total_chunks"), F.count_if(~there).alias("downloaded_chunks"), F.count_if(there).alias("reused_chunks"), F.coalesce(F.sum(F.when(~there, size)), F.lit(0)).alias("received_bytes"))


def restore_prefix(checked: DataFrame) -> DataFrame:
    """object_id and the bytes of its partial file that can stay: all before the first bad chunk.

    ``checked``: object_id, chunk_index, chunk_size_bytes, ok.
    """
    first = checked.groupBy("object_id").agg(F.min(F.when(~F.col("ok"), F.col("chunk_index"))).alias("bad"))
    keep = F.col("bad").isNull() | (F.col("chunk_index") < F.col("bad"))
    return checked.join(first, "object_id").groupBy("object_id").agg(F.count_if(keep).alias("kept_chunks"), F.coalesce(F.sum(F.when(keep, F.col("chunk_size_bytes"))), F.lit(0)).alias("kept_bytes"))


def throughput(samples: DataFrame, by: str) -> DataFrame:
    """Median seconds and MiB/s; the median of an even count is the mean of the two in the middle."""
    out = samples.groupBy(by).agg(F.percentile("seconds", 0.5).alias("median_s"), F.first("bytes").alias("_b"))
    return out.select(by, "median_s", ratio(F.col("_b") / 1048576.0, F.col("median_s")).alias("mib_per_s"))
