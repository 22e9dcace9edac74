"""Sharding by minimax contiguous partition.

Documents of equal text form an atomic group; groups stand in the order of their
smallest doc_id.  The smallest shard capacity for which a greedy pass needs at
most ``n_shards`` shards is found by binary search over prefix sums of the group
sizes, and the order is cut there.  Within that capacity each cut moves back
towards an even share of what is left, as long as the rest still fits.

The driver holds no table of groups.  It holds two numbers for each of about
``CHUNKS`` slices of the prefix axis, which bound the answer from both sides; slices
in which a cut can fall are sliced again until they hold one group end each, so
its memory doesn't grow with the number of groups.

Defined cases: a null text has size 1 and all null texts are one group; an empty
text likewise; repeated rows are separate rows of one group; an empty table gives
an empty result; null doc_ids come first.  Texts of any length are hashed whole.
Only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

N_SHARDS = 8
CHUNKS = 1 << 18


def _group_key():
    return F.coalesce(F.sha2(F.col("text"), 256), F.lit(""))


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, group key, size and checksum of every row; the text goes no further."""
    return docs.select(
        "doc_id",
        _group_key().alias("key"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )


def _numbered(df: DataFrame, label: str, *order: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with its place: pid and idx.

    Written down first, so that a second evaluation can't deal the rows anew.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = ranged.withColumn("pid", F.shiftright("_at", 33)).withColumn("idx", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at")
    return written(ranged, label)


def _offsets(df: DataFrame, *measures: str) -> DataFrame:
    """Totals before each partition: one row per partition, so a window over them is small."""
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy("pid").agg(*[F.sum(m).alias(m) for m in measures])
    return per.select("pid", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_before") for m in measures])


def ordered_groups(rows: DataFrame) -> DataFrame:
    """Groups with the prefix sums of their sizes (``end``) and row counts (``rows_end``), written down."""
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    placed = _numbered(groups, "shard-groups", "first", "key")
    upto = Window.partitionBy("pid").orderBy("idx")
    return written(
        placed.join(F.broadcast(_offsets(placed, "bytes", "n")), "pid").select(
            "key",
            "first",
            (F.sum("bytes").over(upto) + F.col("bytes_before")).alias("end"),
            (F.sum("n").over(upto) + F.col("n_before")).alias("rows_end"),
        ),
        "shard-prefix",
    )


class Prefix:
    """Largest group end up to a value, from slices of the prefix axis.

    A slice is known by its first and last group end.  ``low`` and ``high`` bound
    the answer by the slices alone; ``refine`` replaces slices by finer ones, so
    the driver never holds more than about ``chunks`` slices a round, whatever the
    number of groups.
    """

    def __init__(self, groups: DataFrame, chunks: int = CHUNKS) -> None:
        self.table, self.chunks = groups.select("end"), chunks
        self.total = groups.agg(F.max("end")).first()[0] or 0
        self.lo, self.hi = [self.total], [self.total]
        if self.total:
            self.lo, self.hi = self._sliced([(0, self.total)])

    def _sliced(self, ranges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        """First and last ends of slices of the ranges (first, last), in one job; every range is cut in two at least."""
        first, last = np.array(ranges, np.int64).T
        step = np.maximum(1, -(-(last - first + 1) // max(2, self.chunks // len(ranges))))

        def bounds(batches):
            for batch in batches:
                end = batch["end"].to_numpy(zero_copy_only=False).astype(np.int64)
                k = np.searchsorted(first, end, "right") - 1
                inside = (k >= 0) & (end <= last[np.maximum(k, 0)])
                end, k = end[inside], k[inside]
                end.sort()
                k = np.searchsorted(first, end, "right") - 1
                piece = (end - first[k]) // step[k]
                cut = np.flatnonzero((np.diff(k, prepend=-1) != 0) | (np.diff(piece, prepend=-1) != 0))
                stop = np.append(cut[1:], len(end)) - 1 if len(cut) else cut
                columns = (k[cut], piece[cut], end[cut], end[stop]) if len(cut) else [np.zeros(0, np.int64)] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "piece", "lo", "hi"])

        found = self.table.mapInArrow(bounds, "k long, piece long, lo long, hi long")
        rows = sorted(found.groupBy("k", "piece").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("lo", "hi").collect())
        return [r["lo"] for r in rows], [r["hi"] for r in rows]

    def place(self, v: int) -> int:
        """The slice that holds ``v`` or lies before it; -1: none."""
        return bisect.bisect_right(self.lo, v) - 1

    def low(self, v: int) -> int:
        k = self.place(v)
        return 0 if k < 0 else self.hi[k] if self.hi[k] <= v else self.lo[k]

    def high(self, v: int) -> int:
        k = self.place(v)
        return 0 if k < 0 else min(v, self.hi[k])

    def refine(self, places: list[int]) -> bool:
        """Slices anew those of the places that hold several ends; whether there were any."""
        want = [k for k in sorted(set(places)) if k >= 0 and self.lo[k] != self.hi[k]]
        if not want:
            return False
        lo, hi = self._sliced([(self.lo[k], self.hi[k]) for k in want])
        gone = set(want)
        kept = [(x, y) for k, (x, y) in enumerate(zip(self.lo, self.hi, strict=True)) if k not in gone]
        merged = sorted([*kept, *zip(lo, hi, strict=True)])
        self.lo, self.hi = [x for x, _ in merged], [y for _, y in merged]
        return True

    def exact(self, v: int) -> int:
        while True:
            k = self.place(v)
            if k < 0:
                return 0
            if self.hi[k] <= v or self.lo[k] == self.hi[k]:
                return self.hi[k]
            self.refine([k])

    def after(self, v: int) -> int:
        """Smallest group end over ``v``."""
        while True:
            k = bisect.bisect_right(self.hi, v)
            if k >= len(self.hi):
                return self.total
            if self.lo[k] > v:
                return self.lo[k]
            self.refine([k])


def _fits(reach, total: int, capacity: int, shards: int, start: int = 0) -> bool:
    for _ in range(shards):
        if start >= total:
            return True
        end = reach(start + capacity)
        if end <= start:
            return False
        start = end
    return start >= total


def _least(reach, total: int, shards: int, lo: int, hi: int) -> int:
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if _fits(reach, total, mid, shards) else (mid + 1, hi)
    return lo


def minimax_cuts(prefix: Prefix, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the ends of the shards under it."""
    total = prefix.total
    if not total:
        return 0, [0] * shards
    lo, hi = -(-total // shards), total
    while True:
        lo = _least(prefix.high, total, shards, lo, hi)
        hi = _least(prefix.low, total, shards, lo, hi)
        # Slices in which a cut can fall: its place moves with the capacity.
        touched, a, b = [], 0, 0
        for _ in range(shards):
            a, b = prefix.low(a + lo), min(total, prefix.high(b + hi))
            touched += range(max(0, prefix.place(a)), prefix.place(min(total, a + lo)) + 1) if lo == hi else range(max(0, prefix.place(a)), prefix.place(b) + 1)
        if lo == hi or not prefix.refine(touched):
            break
    capacity = _least(prefix.exact, total, shards, lo, hi)
    cuts, start = [], 0
    for left in range(shards, 0, -1):
        end = prefix.exact(start + capacity)
        if left > 1 and start < total:
            even = start + -(-(total - start) // left)
            under, over = prefix.exact(even), prefix.after(even)
            near = [x for x in (under, over) if start < x <= end and _fits(prefix.exact, total, capacity, left - 1, x)]
            end = min(near, key=lambda x: abs(x - even), default=end)
        start = max(end, start)
        cuts.append(start)
    return capacity, cuts


def shard(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Two narrow shuffles: groups, and rows by (group, doc_id) with a range
    partitioning that splits a hot group over several tasks.  A slot is a row's
    place in the whole order less the rows before its shard.
    """
    rows = sized_rows(docs)
    groups = ordered_groups(rows)
    prefix = Prefix(groups)
    _, cuts = minimax_cuts(prefix, n_shards)
    ends = {r["end"]: r["rows_end"] for r in groups.filter(F.col("end").isin([c for c in cuts if c])).select("end", "rows_end").collect()}
    starts = [0] + [ends.get(c, 0) for c in cuts[:-1]]
    placed = _numbered(rows.join(groups.select("key", "first"), "key"), "shard-rows", "first", "key", "doc_id")
    at = F.col("idx") + F.col("n_before")
    shard_no = F.lit(0)
    for s in starts[1:]:
        shard_no = shard_no + (F.col("_at") >= F.lit(s)).cast("int")
    base = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("shard") + 1)
    counted = placed.withColumn("n", F.lit(1))
    return (
        placed.join(F.broadcast(_offsets(counted, "n")), "pid")
        .withColumn("_at", at)
        .withColumn("shard", shard_no.cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_at") - base).cast("long").alias("slot"))
    )


def op8_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
