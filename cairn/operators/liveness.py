"""Mark and sweep over catalog snapshots.

Liveness is global; locations are swept on one node.  Nothing is deleted in place:
the next snapshot is an anti-join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Snapshot:
    versions: DataFrame
    retirements: DataFrame
    sessions: DataFrame
    finalizations: DataFrame
    objects: DataFrame
    layouts: DataFrame
    layout_chunks: DataFrame
    chunks: DataFrame
    locations: DataFrame


def live_layouts(s: Snapshot) -> DataFrame:
    """Layouts of an object some version not retired is rooted at, or finalized by a session whose version isn't retired.

    The state of a version plays no part.
    """
    gone = s.retirements.select("version_id")
    roots = s.versions.join(gone, "version_id", "left_anti").select(F.col("root_object_id").alias("object_id")).distinct()
    kept = s.sessions.filter("finalized_version_id is not null").join(gone, F.col("finalized_version_id") == F.col("version_id"), "left_anti")
    finalized = s.finalizations.join(kept.select("session_id"), "session_id").select("layout_id")
    by_root = s.layouts.join(roots, "object_id", "left_semi").select("layout_id", "object_id")
    by_session = s.layouts.join(finalized, "layout_id", "left_semi").select("layout_id", "object_id")
    return by_root.union(by_session).distinct()


def live_chunks(s: Snapshot) -> DataFrame:
    return s.layout_chunks.join(live_layouts(s).select("layout_id"), "layout_id", "left_semi").select("chunk_id").distinct()


def classified(inventory: DataFrame, s: Snapshot) -> DataFrame:
    """Inventory rows with ``collectible``: no live layout uses the chunk; unknown chunks are collectible."""
    live = live_chunks(s).withColumn("_live", F.lit(True))
    return inventory.join(live, "chunk_id", "left").withColumn("collectible", F.col("_live").isNull()).drop("_live")


def physical_stats(told: DataFrame) -> DataFrame:
    return told.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("scanned_chunks"), F.sum("size_bytes").alias("scanned_bytes"), F.count_if("collectible").alias("collectible_chunks"), F.coalesce(F.sum(F.when(F.col("collectible"), F.col("size_bytes"))), F.lit(0)).alias("collectible_bytes")
    )


def run_stats(told: DataFrame, node: str, mode: str = "dry-run") -> DataFrame:
    """Physical counters of a run on one node; an applied run deletes what is collectible, a dry run nothing."""
    done = F.col("collectible") & F.lit(mode == "apply")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("size_bytes"))), F.lit(0))
    return told.filter(F.col("node_id") == node).agg(
        F.count(F.lit(1)).alias("scanned_chunks"), total(F.lit(True)).alias("scanned_bytes"), F.count_if("collectible").alias("collectible_chunks"), total(F.col("collectible")).alias("collectible_bytes"),
        F.count_if(done).alias("deleted_chunks"), total(done).alias("deleted_bytes"),
    )


def dead_locations(s: Snapshot, node: str) -> DataFrame:
    return s.locations.filter(F.col("node_id") == node).join(live_chunks(s), "chunk_id", "left_anti")


def dead_layouts(s: Snapshot) -> DataFrame:
    return s.layouts.join(live_layouts(s).select("layout_id"), "layout_id", "left_anti")


def orphan_objects(s: Snapshot) -> DataFrame:
    """Objects without a version, retired or not, and without a layout."""
    roots = s.versions.select(F.col("root_object_id").alias("object_id"))
    return s.objects.join(roots, "object_id", "left_anti").join(s.layouts.select("object_id"), "object_id", "left_anti")


def orphan_chunks(s: Snapshot) -> DataFrame:
    return s.chunks.join(s.layout_chunks.select("chunk_id"), "chunk_id", "left_anti").join(s.locations.select("chunk_id"), "chunk_id", "left_anti")


def swept(s: Snapshot, node: str) -> Snapshot:
    """The snapshot after an applied run: locations, layouts and what hangs on them, objects, chunks, in that order."""
    locations = s.locations.join(dead_locations(s, node).select("chunk_id", "node_id"), ["chunk_id", "node_id"], "left_anti")
    gone = dead_layouts(s).select("layout_id")
    layouts = s.layouts.join(gone, "layout_id", "left_anti")
    now = Snapshot(s.versions, s.retirements, s.sessions, s.finalizations, s.objects, layouts, s.layout_chunks.join(gone, "layout_id", "left_anti"), s.chunks, locations)
    now.objects = now.objects.join(orphan_objects(now).select("object_id"), "object_id", "left_anti")
    now.chunks = now.chunks.join(orphan_chunks(now).select("chunk_id"), "chunk_id", "left_anti")
    return now


def _counts(locations: DataFrame, layouts: DataFrame, objects: DataFrame, chunks: DataFrame) -> DataFrame:
    out = None
    for name, df in (("locations", locations), ("layouts", layouts), ("objects", objects), ("chunks", chunks)):
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(one)
    return out


def dry_run_counts(s: Snapshot, node: str) -> DataFrame:
    """Four counts on the untouched snapshot."""
    return _counts(dead_locations(s, node), dead_layouts(s), orphan_objects(s), orphan_chunks(s))


def apply_counts(s: Snapshot, node: str) -> DataFrame:
    """What the sweep removes; each step sees the ones before it."""
    now = swept(s, node)
    before = Snapshot(s.versions, s.retirements, s.sessions, s.finalizations, s.objects, now.layouts, now.layout_chunks, s.chunks, now.locations)
    return _counts(dead_locations(s, node), dead_layouts(s), orphan_objects(before), orphan_chunks(before))
