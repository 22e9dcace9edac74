"""Reports of rows that break a rule of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import ids
from cairn.sources.schemas import REFERENCES


def layout_report(layout_chunks: DataFrame) -> DataFrame:
    """layout_id, contiguous (each offset is the sum of the sizes before it) and indexed (0..n-1)."""
    order = Window.partitionBy("layout_id").orderBy("chunk_index")
    before = F.coalesce(F.sum("chunk_size_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = layout_chunks.withColumn("_at", (F.col("byte_offset") == before) & (F.col("chunk_size_bytes") > 0)).withColumn("_ix", F.row_number().over(order) - 1 == F.col("chunk_index"))
    return row.groupBy("layout_id").agg(F.min("_at").alias("contiguous"), F.min("_ix").alias("indexed"))


def conformance_report(layout_chunks: DataFrame, size: int | None = None, cdc: tuple[int, int] | None = None) -> DataFrame:
    """layout_id and whether its chunk sizes fit a session: fixed ``size``, or ``cdc`` (min, max)."""
    order = Window.partitionBy("layout_id").orderBy("chunk_index")
    last = F.lead("chunk_index").over(order).isNull()
    n = F.col("chunk_size_bytes")
    inner = n == size if size else n.between(*cdc)
    final = (n > 0) & (n <= (size or cdc[1]))
    return layout_chunks.withColumn("_ok", F.when(last, final).otherwise(inner)).groupBy("layout_id").agg(F.min("_ok").alias("conforms"))


def dangling(tables: dict[str, DataFrame], references=REFERENCES) -> DataFrame:
    """reference and n: rows of each child whose parent is missing; nulls refer to nothing."""
    out = None
    for child, column, parent, key in references:
        if child in tables and parent in tables:
            rows = tables[child].filter(F.col(column).isNotNull()).select(F.col(column).alias(key))
            one = rows.join(tables[parent].select(key), key, "left_anti").agg(F.lit(f"{child}.{column}").alias("reference"), F.count(F.lit(1)).alias("n"))
            out = one if out is None else out.unionByName(one)
    return out


def stored_id_mismatches(layouts: DataFrame, **form) -> DataFrame:
    """Layouts whose stored id isn't the one their chunks give; ``form``: strategy and cdc, as in ``ids.layout_hex``."""
    again = ids.layout_id(F.col("object_id"), F.col("total_size_bytes"), F.col("chunks"), **form)
    return layouts.withColumn("computed_id", again).filter("computed_id <> layout_id").select("layout_id", "computed_id")


def stored_version_mismatches(versions: DataFrame) -> DataFrame:
    """Versions whose stored id isn't the one of their artifact, object, parent and metadata (a map)."""
    again = ids.version_id(F.col("artifact_id"), F.col("root_object_id"), F.col("parent_version_id"), F.col("metadata"))
    return versions.withColumn("computed_id", again).filter(~F.col("computed_id").eqNullSafe(F.col("version_id"))).select("version_id", "computed_id")


def stored_manifest_mismatches(entries: DataFrame) -> DataFrame:
    """Manifests whose stored id isn't the one of their roles and versions."""
    listed = F.map_from_entries(F.collect_list(F.struct("role", "version_id")))
    per = entries.groupBy("manifest_id").agg(ids.manifest_id(listed).alias("computed_id"))
    return per.filter(~F.col("computed_id").eqNullSafe(F.col("manifest_id"))).select("manifest_id", "computed_id")


def rollup_mismatches(layouts: DataFrame, layout_chunks: DataFrame) -> DataFrame:
    """Layouts whose stored count or size isn't that of their chunks."""
    per = layout_chunks.groupBy("layout_id").agg(F.count(F.lit(1)).alias("n"), F.sum("chunk_size_bytes").alias("bytes"))
    return layouts.join(per, "layout_id", "left").na.fill(0, ["n", "bytes"]).filter("n <> chunk_count or bytes <> total_size_bytes").select("layout_id", "n", "bytes")


def unordered(rows: DataFrame, by: str, column: str) -> DataFrame:
    """Groups in which ``column`` doesn't strictly increase along ``position``."""
    before = F.lag(column).over(Window.partitionBy(by).orderBy("position"))
    return rows.withColumn("_bad", F.coalesce(before >= F.col(column), F.lit(False))).filter("_bad").select(by).distinct()


def bad_placements(sets: DataFrame) -> DataFrame:
    from cairn.functions.validators import placement_ok

    return sets.withColumn("valid", F.coalesce(placement_ok(F.col("nodes"), F.col("replicas"), F.col("target")), F.lit(False)))


def unready_nodes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session_id, node_id) of placement sets whose node isn't registered and active."""
    wanted = sets.select("session_id", F.explode("nodes").alias("node_id"))
    return wanted.join(nodes.filter("state = 'active'").select("node_id"), "node_id", "left_anti").select("session_id", "node_id")
