"""Streaming forms: chunk dedup, hourly windows, and objects that arrive in fragments."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairn.operators.chunking import cdc_sizes, fixed_chunks


def hourly(events: DataFrame) -> DataFrame:
    """Events and their value per hour and type; the same expression over a table or a stream."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("max_value")).select(F.unix_micros(F.col("w.start").cast("timestamp")).alias("hour_us"), "event_type", "n", "max_value")


def hourly_stream(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """``hourly`` with a watermark: windows are final once events are ``late`` behind."""
    return hourly(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late))


def new_chunks(objects: DataFrame, size: int) -> DataFrame:
    """Chunks of a stream of objects, each id the first time only.

    The state is one row per distinct chunk id, kept in the state store.
    """
    chunks = objects.select(F.explode(fixed_chunks(F.col("content"), size)).alias("c")).select("c.chunk_id", "c.chunk_size_bytes")
    return chunks.dropDuplicates(["chunk_id"])


def append_once(path: str):
    """A ``foreachBatch`` sink that writes each batch to its own folder, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


FRAGMENT_CHUNKS = "object_key string, chunk_index long, byte_offset long, chunk_size_bytes long, chunk_id string"


def chunk_fragments(fragments: DataFrame, size: int | None = None, cdc: tuple[int, int, int] | None = None) -> DataFrame:
    """Chunks of objects that arrive as fragments (object_key, seq, content, last): fixed ``size``, or ``cdc`` (min, average, max).

    The state of an object is less than one chunk of bytes and its counters, so an
    object may be larger than any value can be; fragments of a batch are taken by
    ``seq``, batches in their order.  Boundaries don't depend on how an object is
    cut into fragments: a chunk is done once its end can't move any more, which is
    when bytes follow it or it has the greatest size.
    """
    greatest = size or cdc[2]

    def pieces(raw: bytes, ended: bool) -> list[int]:
        sizes = cdc_sizes(raw, *cdc) if cdc else [min(size, len(raw) - at) for at in range(0, len(raw), size)]
        return sizes if ended or not sizes or sizes[-1] == greatest else sizes[:-1]

    def step(key, parts, state: GroupState):
        index, offset, rest = state.get if state.exists else (0, 0, b"")
        rows = pd.concat(list(parts)).sort_values("seq")
        out, ended = [], False
        for content, last in zip(rows["content"], rows["last"], strict=True):
            raw, ended, at = bytes(rest) + bytes(content or b""), ended or bool(last), 0
            for n in pieces(raw, ended):
                out.append((key[0], index, offset, n, hashlib.sha256(memoryview(raw)[at : at + n]).hexdigest()))
                index, offset, at = index + 1, offset + n, at + n
            rest = raw[at:]
        if ended:
            state.remove()
        else:
            state.update((index, offset, rest))
        yield pd.DataFrame(out, columns=["object_key", "chunk_index", "byte_offset", "chunk_size_bytes", "chunk_id"])

    return fragments.groupBy("object_key").applyInPandasWithState(step, FRAGMENT_CHUNKS, "chunk_index long, byte_offset long, rest binary", "append", GroupStateTimeout.NoTimeout)
