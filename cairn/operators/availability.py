"""Where chunks are, where they should be, and what can be restored from where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import constants as K


def available(locations: DataFrame) -> DataFrame:
    return locations.filter("state = 'available'")


def readable(locations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Available locations on nodes that can be read, with address and port.  A registry holds at most 64 nodes."""
    able = nodes.filter(F.col("state").isin(*K.READABLE_NODE_STATES)).select("node_id", "address", "port")
    return available(locations).select("chunk_id", "node_id").join(able, "node_id")


def readable_sources(locations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per chunk its endpoints, by node id."""
    return readable(locations, nodes).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("node_id", "address", "port"))).alias("sources"))


def node_chunk_counts(locations: DataFrame) -> DataFrame:
    return available(locations).groupBy("node_id").agg(F.count(F.lit(1)).alias("chunks"))


def under_replicated(desired: DataFrame, locations: DataFrame) -> DataFrame:
    """Desired replicas that no available location backs; extra replicas elsewhere don't count."""
    return desired.join(available(locations), ["chunk_id", "node_id"], "left_anti")


def restorable_layouts(layouts: DataFrame, layout_chunks: DataFrame, held: DataFrame) -> DataFrame:
    """Layouts of which every chunk is in ``held``; a layout without chunks is restorable."""
    missing = layout_chunks.select("layout_id", "chunk_id").join(held.select("chunk_id"), "chunk_id", "left_anti")
    return layouts.join(missing, "layout_id", "left_anti")


def restorable(layouts: DataFrame, layout_chunks: DataFrame, locations: DataFrame, nodes: DataFrame | None = None, node: str | None = None) -> DataFrame:
    """object_id and the smallest restorable layout_id, from one node or from any readable one."""
    held = available(locations).filter(F.col("node_id") == node) if node else readable(locations, nodes)
    return restorable_layouts(layouts, layout_chunks, held).groupBy("object_id").agg(F.min("layout_id").alias("layout_id"))


def restore_outcomes(versions: DataFrame, retirements: DataFrame, best: DataFrame) -> DataFrame:
    """version_id, outcome and layout: the first that applies of not-committed, retired, source-unavailable, ok."""
    gone = retirements.select("version_id", F.lit(True).alias("retired"))
    joined = versions.join(gone, "version_id", "left").join(best.withColumnRenamed("object_id", "root_object_id"), "root_object_id", "left")
    outcome = F.when(F.col("state") != "committed", "not-committed").when(F.col("retired"), "retired").when(F.col("layout_id").isNull(), "source-unavailable").otherwise("ok")
    return joined.select("version_id", outcome.alias("outcome"), F.when(outcome == "ok", F.col("layout_id")).alias("layout_id"))


def restore_plan(versions: DataFrame, retirements: DataFrame, layouts: DataFrame, layout_chunks: DataFrame, locations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks of each restorable version in order, with their sources."""
    best = restorable(layouts, layout_chunks, locations, nodes)
    good = restore_outcomes(versions, retirements, best).filter("outcome = 'ok'").select("version_id", "layout_id")
    chunks = good.join(layout_chunks.select("layout_id", "chunk_index", "chunk_id", "byte_offset", "chunk_size_bytes"), "layout_id")
    return chunks.join(readable_sources(locations, nodes), "chunk_id")


def negotiate(wanted: DataFrame, chunks: DataFrame, locations: DataFrame, target: str) -> DataFrame:
    """chunk_id, known, size_conflict, availability of the chunks a writer has."""
    where = available(locations).groupBy("chunk_id").agg(F.max((F.col("node_id") == target).cast("int")).alias("on_target"))
    stored = chunks.withColumnRenamed("size_bytes", "stored_bytes")
    joined = wanted.join(stored, "chunk_id", "left").join(where, "chunk_id", "left")
    name = F.when(F.col("on_target") == 1, "available_on_target").when(F.col("on_target") == 0, "available_elsewhere").otherwise("no_available_location")
    known = F.col("stored_bytes").isNotNull()
    return joined.select("chunk_id", known.alias("known"), F.coalesce(known & (F.col("stored_bytes") != F.col("size_bytes")), F.lit(False)).alias("size_conflict"), name.alias("availability"))


def replication_plan(desired: DataFrame, locations: DataFrame, nodes: DataFrame, inventory: DataFrame) -> DataFrame:
    """A row for each desired replica: whether the catalog and the node have it, whether to repair it, and from how many sources.

    A replica is good if its location is available, its node readable, and the
    node's inventory holds the chunk.
    """
    listed = readable(locations, nodes).select("chunk_id", "node_id", F.lit(True).alias("listed"))
    there = inventory.select("chunk_id", "node_id", F.lit(True).alias("there"))
    sources = listed.join(there, ["chunk_id", "node_id"]).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_sources"))
    both = desired.join(listed, ["chunk_id", "node_id"], "left").join(there, ["chunk_id", "node_id"], "left").join(sources, "chunk_id", "left")
    good = F.coalesce(F.col("listed") & F.col("there"), F.lit(False))
    return both.select("chunk_id", "node_id", "size_bytes", good.alias("good"), (~good & F.col("n_sources").isNotNull()).alias("repair"), F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"))


def replication_stats(plan: DataFrame) -> DataFrame:
    per = plan.groupBy("chunk_id").agg(F.max((~F.col("good")).cast("long")).alias("under"))
    copies = plan.agg(F.count_if("good").alias("replicas_verified"), F.count_if("repair").alias("replicas_written"), F.coalesce(F.sum(F.when(F.col("repair"), F.col("size_bytes"))), F.lit(0)).alias("bytes_copied"))
    return per.agg(F.count(F.lit(1)).alias("chunks_scanned"), F.coalesce(F.sum("under"), F.lit(0)).alias("chunks_under_replicated")).join(copies)


def source_failovers(plan: DataFrame, sources: DataFrame) -> DataFrame:
    """chunk_id, failovers and supplied of each chunk that needs a repair.

    ``plan`` as from ``replication_plan``; ``sources``: chunk_id, node_id and answer
    (ok, absent, error) of the readable replicas.  Sources are asked by node id until
    one answers; errors before that are failovers, an absent chunk is passed over.
    """
    wanted = plan.filter("not good").select("chunk_id").distinct()
    first = sources.filter("answer = 'ok'").groupBy("chunk_id").agg(F.min("node_id").alias("_ok"))
    asked = wanted.join(sources, "chunk_id", "left").join(first, "chunk_id", "left")
    error = (F.col("answer") == "error") & (F.col("_ok").isNull() | (F.col("node_id") < F.col("_ok")))
    return asked.groupBy("chunk_id").agg(F.count_if(error).alias("failovers"), F.max(F.col("_ok").isNotNull()).alias("supplied"))


def artifact_health(artifact_chunks: DataFrame, locations: DataFrame, nodes: DataFrame, replicas: int) -> DataFrame:
    """artifact_id and health, over (artifact_id, chunk_id) with a null chunk for an artifact without any."""
    reach = readable(locations, nodes).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    least = artifact_chunks.join(reach, "chunk_id", "left").groupBy("artifact_id").agg(F.count("chunk_id").alias("n_chunks"), F.min(F.coalesce("n", F.lit(0))).alias("least"))
    health = F.when((F.col("n_chunks") == 0) | (F.col("least") == 0), "unavailable").when(F.col("least") < replicas, "degraded").otherwise("healthy")
    return least.select("artifact_id", "n_chunks", health.alias("health"))


def physical_representation(layouts: DataFrame, layout_chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """Chunks of a layout against those available.

    ``available_rows`` counts a row per replica, so a second replica can hide a
    missing chunk; ``status`` goes by it, ``strict_status`` by distinct chunks.
    """
    held = available(locations).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    per = layout_chunks.join(held, "chunk_id", "left").groupBy("layout_id").agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("available_rows"), F.count("n").alias("available_chunks"))
    full = layouts.select("layout_id").join(per, "layout_id", "left").na.fill(0)
    status = lambda n: F.when((F.col("total") == 0) | (n == 0), "reclaimed").when(n < F.col("total"), "partially-reclaimed").otherwise("present")
    return full.select("layout_id", "total", "available_rows", "available_chunks", status(F.col("available_rows")).alias("status"), status(F.col("available_chunks")).alias("strict_status"))


def verify_restore(plan: DataFrame, store: DataFrame, object_ids: DataFrame) -> DataFrame:
    """version_id, chunks, bad_chunks, first_bad and whether the object's hash comes out.

    ``store``: chunk_id, node_id, content.  Of each chunk the first source, by node
    id, whose bytes hash to the chunk id is used.
    """
    sound = store.filter(F.sha2("content", 256) == F.col("chunk_id")).groupBy("chunk_id").agg(F.min_by("content", "node_id").alias("content"))
    got = plan.join(sound, "chunk_id", "left")
    whole = got.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("content").isNull()).alias("bad_chunks"), F.min(F.when(F.col("content").isNull(), F.col("chunk_index"))).alias("first_bad"),
        F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"),
    )
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["content"]))
    return whole.join(object_ids, "version_id").select("version_id", "chunks", "bad_chunks", "first_bad", F.coalesce(F.sha2(joined, 256) == F.col("root_object_id"), F.lit(False)).alias("verified"))
