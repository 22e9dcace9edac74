"""Point lookups and ordered range scans over catalog tables.

The predicates reach the Parquet scan; there is no index to keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schemas import KEYS


def get(table: str, rows: DataFrame, *key) -> DataFrame:
    """The row with that primary key, or none."""
    found = rows
    for column, value in zip(KEYS[table], key, strict=True):
        found = found.filter(F.col(column) == F.lit(value))
    return found


def layouts_of(layouts: DataFrame, object_id: str) -> DataFrame:
    return layouts.filter(F.col("object_id") == object_id).orderBy("layout_id")


def locations_of(locations: DataFrame, chunk_id: str) -> DataFrame:
    return locations.filter(F.col("chunk_id") == chunk_id).orderBy("node_id")


def all_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("node_id")


def sized_chunks(layout_chunks: DataFrame, chunks: DataFrame, layout_id: str) -> DataFrame:
    """Chunks of a layout in order, with their stored size."""
    return layout_chunks.filter(F.col("layout_id") == layout_id).join(chunks, "chunk_id").orderBy("chunk_index")
