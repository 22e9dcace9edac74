"""Splitting bytes into chunks.

Fixed-size chunking is a native expression.  Content-defined chunking is one
vectorised numpy pass per object: the cut test reads only the low bits of the
rolling hash, which depend on the last few bytes, so all candidate positions are
found at once and a greedy walk over the candidates places the cuts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import constants as K
from cairn.functions.ids import sha256

CHUNKS = "array<struct<chunk_index:long,byte_offset:long,chunk_size_bytes:long,chunk_id:string>>"


def fixed_chunks(content: Column, size: int = K.DEFAULT_CHUNK_SIZE) -> Column:
    """Array of chunk structs of a binary column; none for empty content."""
    if size <= 0:
        raise ValueError("chunk size must be positive")

    def made(bytes_: Column) -> Column:
        length = F.octet_length(bytes_)
        one = lambda i: F.substring(bytes_, (i * size + 1).cast("int"), F.lit(size))
        return F.transform(
            F.sequence(F.lit(0).cast("long"), F.floor((length - 1) / size)),
            lambda i: F.struct(i.alias("chunk_index"), (i * size).alias("byte_offset"), F.least(F.lit(size).cast("long"), length - i * size).alias("chunk_size_bytes"), sha256(one(i)).alias("chunk_id")),
        )

    # Bound once: a binary column is copied as a whole each time it is read from a row.
    return F.when(F.octet_length(content) > 0, F.get(F.transform(F.array(content), made), F.lit(0))).otherwise(F.expr(f"cast(array() as {CHUNKS})"))


def fixed_layouts(objects: DataFrame, size: int, content: str = "content") -> DataFrame:
    """object_id and its chunks; the bytes go no further than the hash."""
    return objects.select("object_id", fixed_chunks(F.col(content), size).alias("chunks"))


def gear_table(seed: int = K.GEAR_SEED, n: int = K.GEAR_SIZE) -> np.ndarray:
    mask, state, out = 2**64 - 1, seed, []
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & mask
        state = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        state = ((state ^ (state >> 27)) * 0x94D049BB133111EB) & mask
        state ^= state >> 31
        out.append(state)
    return np.array(out, np.uint64)


#: Bytes of a block of the vectorised hash; with its two buffers it stays in the cache.
_BLOCK = 1 << 16


class _LowHash:
    """The low bits of the rolling hash after each byte of a block, by doubling the span that is summed."""

    def __init__(self, bits: int) -> None:
        self.bits, self.gear = bits, gear_table().astype(np.uint32)
        self.sums, self.moved = (np.empty(_BLOCK + bits, np.uint32) for _ in range(2))

    def of(self, data: np.ndarray) -> np.ndarray:
        h, moved = self.sums[: len(data)], self.moved[: len(data)]
        np.take(self.gear, data, out=h, mode="clip")
        span = 1
        while span < min(self.bits, len(data)):
            np.left_shift(h[:-span], np.uint32(span), out=moved[span:])
            np.add(h[span:], moved[span:], out=h[span:])
            span *= 2
        return h


def rolling_for(avg: int) -> _LowHash:
    return _LowHash(avg.bit_length() + 1)


def cdc_sizes(raw: bytes, low: int, avg: int, high: int, rolling: _LowHash | None = None) -> list[int]:
    """Sizes of the content-defined chunks of ``raw``, in order.

    A cut falls after the first byte at which the low bits of the hash are zero:
    one bit more than log2(avg) before ``avg`` bytes, one less from there, never
    before ``low`` and at ``high`` at the latest.
    """
    if not raw:
        return []
    data = np.frombuffer(raw, np.uint8)
    bits = avg.bit_length() - 1
    strict, loose = np.uint32((1 << (bits + 1)) - 1), np.uint32((1 << (bits - 1)) - 1)
    rolling = rolling or rolling_for(avg)
    hard, easy = [], []
    for at in range(0, len(data), _BLOCK):
        lead = min(at, bits + 1)
        h = rolling.of(data[at - lead : at + _BLOCK])[lead:]
        found = np.flatnonzero((h & loose) == 0)
        easy.append(found + at)
        hard.append(found[(h[found] & strict) == 0] + at)
    hard_at, easy_at = np.concatenate(hard), np.concatenate(easy)
    sizes, start, n = [], 0, len(data)
    while start < n:
        stop = min(start + high, n)  # size if nothing cuts earlier
        k = np.searchsorted(hard_at, start + low - 1)
        first = int(hard_at[k]) + 1 if k < len(hard_at) else n + 1
        if first > start + avg - 1:
            k = np.searchsorted(easy_at, start + max(low, avg) - 1)
            first = int(easy_at[k]) + 1 if k < len(easy_at) else n + 1
        stop = min(stop, first)
        sizes.append(stop - start)
        start = stop
    return sizes


def cdc_layouts(objects: DataFrame, low: int, avg: int, high: int, content: str = "content") -> DataFrame:
    """object_id and its content-defined chunks; Arrow batches in, no bytes out."""
    if not (K.MIN_CDC_SIZE <= low <= avg <= high <= K.MAX_CHUNK_SIZE and avg & (avg - 1) == 0):
        raise ValueError("invalid content-defined chunking parameters")
    kind = pa.list_(pa.struct([("chunk_index", pa.int64()), ("byte_offset", pa.int64()), ("chunk_size_bytes", pa.int64()), ("chunk_id", pa.string())]))

    def run(batches):
        rolling = rolling_for(avg)
        for batch in batches:
            out = []
            for raw in batch[1].to_pylist():
                at, rows = 0, []
                for k, size in enumerate(cdc_sizes(raw or b"", low, avg, high, rolling)):
                    rows.append({"chunk_index": k, "byte_offset": at, "chunk_size_bytes": size, "chunk_id": hashlib.sha256(memoryview(raw)[at : at + size]).hexdigest()})
                    at += size
                out.append(rows)
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(out, kind)], names=["object_id", "chunks"])

    return objects.select("object_id", content).mapInArrow(run, f"object_id string, chunks {CHUNKS}")


def exploded(layouts: DataFrame, *keep: str) -> DataFrame:
    """One row per chunk."""
    return layouts.select(*keep, F.explode("chunks").alias("_c")).select(*keep, "_c.*")


def cdc_reference(raw: bytes, low: int, avg: int, high: int) -> list[int]:
    """The same cuts byte by byte; for tests."""
    gear, mask = gear_table(), 2**64 - 1
    bits = avg.bit_length() - 1
    sizes, h, n = [], 0, 0
    for b in raw:
        h = ((h << 1) + int(gear[b])) & mask
        n += 1
        if n < low:
            continue
        test = (1 << (bits + 1)) - 1 if n < avg else (1 << (bits - 1)) - 1
        if n >= high or h & test == 0:
            sizes.append(n)
            h = n = 0
    return sizes + [n] * (n > 0)
