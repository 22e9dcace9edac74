"""Schemas of the catalog tables.  Nothing is inferred.

One DDL string per table, in the order in which rows depend on each other; `key`
columns come first.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

_CDC = "fastcdc_min_chunk_size_bytes long, fastcdc_avg_chunk_size_bytes long, fastcdc_max_chunk_size_bytes long"
_GC_COUNTERS = ", ".join(f"{c} long" for c in (
    "physical_chunks_scanned", "physical_bytes_scanned", "collectible_chunks", "collectible_bytes", "physical_chunks_deleted",
    "physical_bytes_deleted", "locations_removed", "layouts_removed", "objects_removed", "chunks_removed"))
_COPY_COUNTERS = ", ".join(f"{c} long" for c in ("chunks_scanned", "chunks_under_replicated", "replicas_verified", "replicas_written", "bytes_copied", "source_failovers"))
_POLICY_COUNTERS = ", ".join(f"{c} long" for c in ("versions_scanned", "versions_protected", "versions_retained", "retirement_candidates", "versions_retired", "logical_bytes_candidates", "logical_bytes_retired"))

DDL = {
    "schema_migrations": "version int, name string, applied_at timestamp",
    "chunks": "chunk_id string, size_bytes long, created_at timestamp",
    "objects": "object_id string, total_size_bytes long, created_at timestamp",
    "object_layouts": f"layout_id string, object_id string, descriptor_version int, chunking_strategy string, canonical_descriptor binary, total_size_bytes long, chunk_count long, {_CDC}, created_at timestamp",
    "object_layout_chunks": "layout_id string, chunk_index long, chunk_id string, byte_offset long, chunk_size_bytes long",
    "artifacts": "artifact_id string, project string, name string, created_at timestamp",
    "artifact_versions": "version_id string, artifact_id string, root_object_id string, parent_version_id string, descriptor_version int, canonical_descriptor binary, state string, created_at timestamp",
    "artifact_version_metadata": "version_id string, metadata_key string, metadata_value string",
    "tags": "artifact_id string, tag_name string, version_id string, updated_at timestamp",
    "storage_locations": "chunk_id string, node_id string, storage_path string, state string, verified_at timestamp, created_at timestamp",
    "manifests": "manifest_id string, descriptor_version int, canonical_descriptor binary, entry_count long, created_at timestamp",
    "manifest_entries": "manifest_id string, role string, version_id string",
    "runs": "run_id string, manifest_id string, name string, source_commit string, started_at timestamp, completed_at timestamp",
    "run_tags": "run_id string, tag_key string, tag_value string",
    "upload_sessions": f"session_id string, artifact_id string, target_node_id string, replication_factor short, chunking_strategy string, chunk_size_bytes long, {_CDC}, parent_version_id string, state string, finalized_version_id string, created_at timestamp, updated_at timestamp",
    "upload_session_metadata": "session_id string, metadata_key string, metadata_value string",
    "upload_session_finalizations": "session_id string, layout_id string, created_at timestamp",
    "upload_session_nodes": "session_id string, node_rank short, node_id string",
    "gc_runs": f"run_id string, target_node_id string, mode string, state string, {_GC_COUNTERS}, created_at timestamp, updated_at timestamp, completed_at timestamp",
    "storage_nodes": "node_id string, address string, port int, state string, created_at timestamp, updated_at timestamp",
    "replication_runs": f"run_id string, version_id string, layout_id string, replication_factor short, state string, {_COPY_COUNTERS}, created_at timestamp, updated_at timestamp, completed_at timestamp",
    "replication_run_nodes": "run_id string, node_rank short, node_id string",
    "lifecycle_policies": "policy_id string, name string, created_at timestamp",
    "lifecycle_policy_rules": "policy_id string, artifact_kind string, keep_last_n int, max_age_seconds long",
    "artifact_version_pins": "version_id string, reason string, pinned_at timestamp",
    "lifecycle_runs": f"run_id string, policy_id string, mode string, evaluated_at timestamp, {_POLICY_COUNTERS}",
    "lifecycle_run_decisions": "run_id string, version_id string, artifact_id string, artifact_kind string, decision string, reason string, logical_size_bytes long",
    "artifact_version_retirements": "version_id string, lifecycle_run_id string, artifact_kind string, reason string, retired_at timestamp",
}


@cache
def schema(name: str) -> StructType:
    """Schema of a table; needs a session, which parses the DDL."""
    return StructType.fromDDL(DDL[name])


KEYS = {
    "schema_migrations": ("version",), "chunks": ("chunk_id",), "objects": ("object_id",), "object_layouts": ("layout_id",),
    "object_layout_chunks": ("layout_id", "chunk_index"), "artifacts": ("artifact_id",), "artifact_versions": ("version_id",),
    "artifact_version_metadata": ("version_id", "metadata_key"), "tags": ("artifact_id", "tag_name"), "storage_locations": ("chunk_id", "node_id"),
    "manifests": ("manifest_id",), "manifest_entries": ("manifest_id", "role"), "runs": ("run_id",), "run_tags": ("run_id", "tag_key"),
    "upload_sessions": ("session_id",), "upload_session_metadata": ("session_id", "metadata_key"), "upload_session_finalizations": ("session_id",),
    "upload_session_nodes": ("session_id", "node_rank"), "gc_runs": ("run_id",), "storage_nodes": ("node_id",), "replication_runs": ("run_id",),
    "replication_run_nodes": ("run_id", "node_rank"), "lifecycle_policies": ("policy_id",), "lifecycle_policy_rules": ("policy_id", "artifact_kind"),
    "artifact_version_pins": ("version_id",), "lifecycle_runs": ("run_id",), "lifecycle_run_decisions": ("run_id", "version_id"),
    "artifact_version_retirements": ("version_id",),
}

#: (child, column, parent, parent's column): references that must not dangle.
REFERENCES = (
    ("object_layouts", "object_id", "objects", "object_id"),
    ("object_layout_chunks", "layout_id", "object_layouts", "layout_id"),
    ("object_layout_chunks", "chunk_id", "chunks", "chunk_id"),
    ("artifact_versions", "artifact_id", "artifacts", "artifact_id"),
    ("artifact_versions", "root_object_id", "objects", "object_id"),
    ("artifact_versions", "parent_version_id", "artifact_versions", "version_id"),
    ("artifact_version_metadata", "version_id", "artifact_versions", "version_id"),
    ("tags", "artifact_id", "artifacts", "artifact_id"),
    ("tags", "version_id", "artifact_versions", "version_id"),
    ("storage_locations", "chunk_id", "chunks", "chunk_id"),
    ("manifest_entries", "manifest_id", "manifests", "manifest_id"),
    ("manifest_entries", "version_id", "artifact_versions", "version_id"),
    ("runs", "manifest_id", "manifests", "manifest_id"),
    ("run_tags", "run_id", "runs", "run_id"),
    ("upload_sessions", "artifact_id", "artifacts", "artifact_id"),
    ("upload_sessions", "parent_version_id", "artifact_versions", "version_id"),
    ("upload_sessions", "finalized_version_id", "artifact_versions", "version_id"),
    ("upload_session_metadata", "session_id", "upload_sessions", "session_id"),
    ("upload_session_finalizations", "session_id", "upload_sessions", "session_id"),
    ("upload_session_finalizations", "layout_id", "object_layouts", "layout_id"),
    ("upload_session_nodes", "session_id", "upload_sessions", "session_id"),
    ("replication_runs", "version_id", "artifact_versions", "version_id"),
    ("replication_runs", "layout_id", "object_layouts", "layout_id"),
    ("replication_run_nodes", "run_id", "replication_runs", "run_id"),
    ("artifact_version_pins", "version_id", "artifact_versions", "version_id"),
    ("lifecycle_policy_rules", "policy_id", "lifecycle_policies", "policy_id"),
    ("lifecycle_runs", "policy_id", "lifecycle_policies", "policy_id"),
    ("lifecycle_run_decisions", "run_id", "lifecycle_runs", "run_id"),
    ("lifecycle_run_decisions", "version_id", "artifact_versions", "version_id"),
    ("lifecycle_run_decisions", "artifact_id", "artifacts", "artifact_id"),
    ("artifact_version_retirements", "version_id", "artifact_versions", "version_id"),
    ("artifact_version_retirements", "lifecycle_run_id", "lifecycle_runs", "run_id"),
)
