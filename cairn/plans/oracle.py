"""DuckDB SQL for the registered queries, written against the driver's tables."""

from __future__ import annotations

from cairn.functions import constants as K

from .queries import EVALUATED_S, POLICY, TARGET

MAGIC = {k: v.encode().hex() + "00000001" for k, v in (("layout", K.LAYOUT_MAGIC), ("version", K.VERSION_MAGIC), ("manifest", K.MANIFEST_MAGIC))}


def u64(x: str) -> str:
    return f"printf('%016x', ({x})::BIGINT)"


def sized(x: str) -> str:
    return f"{u64(f'strlen({x})')} || lower(hex({x}))"


def uuid(x: str) -> str:
    m = f"md5({x})"
    return f"substr({m},1,8)||'-'||substr({m},9,4)||'-7'||substr({m},14,3)||'-8'||substr({m},18,3)||'-'||substr({m},21,12)"


RULES = ", ".join(f"('{k}', {n}, {'NULL' if a is None else a}::BIGINT)" for k, n, a in POLICY)

#: The derived catalog, as common table expressions in the order of their use.
CATALOG = {
    "docs": "SELECT doc_id, lang, coalesce(source, '') AS source, text, sha256(text) AS object_id, strlen(text)::BIGINT AS bytes FROM documents WHERE text IS NOT NULL",
    "objects": "SELECT object_id, any_value(bytes) AS total_size_bytes, lower(hex(any_value(text))) AS hx FROM docs GROUP BY 1",
    "specs": "SELECT *, 1024 AS chunk_size FROM objects UNION ALL SELECT *, 2048 FROM objects WHERE substr(object_id, 1, 1) < '4' AND total_size_bytes > 1024",
    "pieces": """SELECT object_id, chunk_size, i AS chunk_index, i * chunk_size AS byte_offset, least(chunk_size, total_size_bytes - i * chunk_size)::BIGINT AS chunk_size_bytes,
        sha256(unhex(substr(hx, (i * chunk_size * 2 + 1)::BIGINT, chunk_size * 2))) AS chunk_id
      FROM (SELECT *, unnest(range((total_size_bytes + chunk_size - 1) // chunk_size)) AS i FROM specs)""",
    "layouts": f"""SELECT s.object_id, s.chunk_size, any_value(s.total_size_bytes) AS total_size_bytes, count(p.chunk_id)::BIGINT AS chunk_count,
        sha256(unhex('{MAGIC["layout"]}' || s.object_id || '01' || {u64("any_value(s.total_size_bytes)")} || {u64("count(p.chunk_id)")}
          || coalesce(string_agg(p.chunk_id || {u64("p.byte_offset")} || {u64("p.chunk_size_bytes")}, '' ORDER BY p.chunk_index), ''))) AS layout_id
      FROM specs s LEFT JOIN pieces p ON p.object_id = s.object_id AND p.chunk_size = s.chunk_size GROUP BY s.object_id, s.chunk_size""",
    "layout_chunks": "SELECT l.layout_id, p.* FROM layouts l JOIN pieces p ON p.object_id = l.object_id AND p.chunk_size = l.chunk_size",
    "chunks": "SELECT DISTINCT chunk_id, chunk_size_bytes AS size_bytes FROM pieces",
    "nodes": "SELECT 'node-' || r_regionkey AS node_id, '10.0.0.' || (r_regionkey + 1) AS address, (7000 + r_regionkey)::INT AS port, CASE r_regionkey WHEN 3 THEN 'draining' WHEN 4 THEN 'disabled' ELSE 'active' END AS state FROM region",
    "placed": f"""SELECT chunk_id, size_bytes, node_id, row_number() OVER (PARTITION BY chunk_id ORDER BY
        sha256(encode('{K.PLACEMENT_MAGIC}') || '\\x00'::BLOB || encode(chunk_id) || '\\x00'::BLOB || encode(node_id)) DESC, node_id) AS place FROM chunks, nodes""",
    "desired": "SELECT * FROM placed WHERE place <= 2",
    "locations": """SELECT chunk_id, node_id, 'chunks/' || substr(chunk_id, 1, 2) || '/' || chunk_id AS storage_path,
        CASE substr(sha256(chunk_id || node_id), 1, 1) WHEN '0' THEN 'missing' WHEN '1' THEN 'corrupt' ELSE 'available' END AS state FROM desired""",
    "inventory": "SELECT node_id, l.chunk_id, size_bytes FROM locations l JOIN chunks USING (chunk_id) WHERE state <> 'missing' UNION ALL SELECT node_id, sha256('stray' || node_id), 512 FROM nodes",
    "version_docs": f"""SELECT *, sha256(unhex('{MAGIC["version"]}' || replace(artifact_id, '-', '') || object_id || '00' || {u64("CASE WHEN kind IS NULL THEN 1 ELSE 2 END")}
        || CASE WHEN kind IS NULL THEN '' ELSE {sized(f"'{K.KIND_KEY}'")} || {sized("kind")} END || {sized("'lang'")} || {sized("coalesce(lang, '')")})) AS version_id
      FROM (SELECT *, {uuid("source")} AS artifact_id, CASE WHEN doc_id % 10 = 9 THEN 'evaluation-output' WHEN lang = 'en' THEN 'model-checkpoint' WHEN lang = 'fr' THEN 'dataset-snapshot' WHEN lang = 'de' THEN 'embedding-index' END AS kind FROM docs)""",
    "versions": """SELECT version_id, any_value(artifact_id) AS artifact_id, any_value(object_id) AS root_object_id, any_value(kind) AS kind, any_value(bytes) AS logical_size_bytes, min(doc_id) AS doc_no,
        CASE WHEN min(doc_id) % 11 = 0 THEN 'staging' ELSE 'committed' END AS state, (min(doc_id) // 3 * 3600 + 1704067200)::BIGINT AS created_s FROM version_docs GROUP BY 1""",
    "tags": "SELECT artifact_id, 'q' || doc_id AS tag_name, version_id FROM labels JOIN version_docs USING (doc_id) WHERE quality = 1 AND doc_id % 2 = 0",
    "pins": "SELECT DISTINCT version_id FROM labels JOIN version_docs USING (doc_id) WHERE toxic = 1",
    "entries0": "SELECT item_id // 3 AS m, 'role-' || (item_id % 3) AS role, version_id FROM benchmark JOIN version_docs ON doc_id = item_id * 7",
    "manifest_entries": f"""SELECT manifest_id, role, version_id FROM entries0 JOIN (SELECT m, sha256(unhex('{MAGIC["manifest"]}' || {u64("count(*)")} || string_agg({sized("role")} || version_id, '' ORDER BY role))) AS manifest_id
        FROM entries0 GROUP BY m) USING (m)""",
    "protected": "SELECT version_id FROM pins UNION SELECT version_id FROM tags UNION SELECT version_id FROM manifest_entries",
    "retirements": "SELECT version_id, coalesce(kind, 'generic') AS artifact_kind, 'policy-retire' AS reason FROM versions WHERE doc_no % 7 = 0 AND version_id NOT IN (SELECT version_id FROM protected)",
    "sessions": f"""SELECT {uuid("'s' || doc_no")} AS session_id, 'committed' AS state, version_id AS finalized_version_id FROM versions WHERE doc_no % 5 = 0
        UNION ALL SELECT {uuid("'e' || event_id")}, CASE WHEN event_id % 1000 = 0 THEN 'open' ELSE 'aborted' END, NULL FROM events""",
    "finalizations": f"SELECT {uuid("'s' || doc_no")} AS session_id, layout_id FROM versions JOIN layouts ON object_id = root_object_id WHERE doc_no % 5 = 0 AND chunk_size = 1024",
    "readable": "SELECT chunk_id, node_id, address, port FROM locations l JOIN nodes n USING (node_id) WHERE l.state = 'available' AND n.state IN ('active', 'draining')",
    "best": "SELECT object_id, min(layout_id) AS layout_id FROM layouts l WHERE NOT EXISTS (SELECT 1 FROM layout_chunks c WHERE c.layout_id = l.layout_id AND c.chunk_id NOT IN (SELECT chunk_id FROM readable)) GROUP BY 1",
    "outcomes": """SELECT v.version_id, CASE WHEN v.state <> 'committed' THEN 'not-committed' WHEN v.version_id IN (SELECT version_id FROM retirements) THEN 'retired' WHEN b.layout_id IS NULL THEN 'source-unavailable' ELSE 'ok' END AS outcome, b.layout_id
      FROM versions v LEFT JOIN best b ON b.object_id = v.root_object_id""",
    "plan": "SELECT version_id, chunk_index, chunk_id, chunk_size_bytes FROM outcomes o JOIN layout_chunks c ON c.layout_id = o.layout_id WHERE outcome = 'ok'",
    "pushed": f"SELECT {uuid("'p' || doc_id")} AS session_id, chunk_index, chunk_id, chunk_size_bytes FROM docs JOIN pieces USING (object_id) WHERE chunk_size = 1024",
    "replicas": """SELECT session_id, chunk_id, node_id, any_value(chunk_size_bytes) AS size, CASE
        WHEN (chunk_id, node_id) NOT IN (SELECT (chunk_id, node_id) FROM locations WHERE state = 'available') THEN 'put'
        WHEN (chunk_id, node_id) IN (SELECT (chunk_id, node_id) FROM inventory WHERE chunk_id NOT LIKE '%7') THEN 'verify' ELSE 'repair' END AS action
      FROM pushed JOIN desired USING (chunk_id) GROUP BY session_id, chunk_id, node_id""",
    "push": """SELECT r.*, coalesce(put_requests, 0) AS put_requests, coalesce(verified_chunks, 0) AS verified_chunks, coalesce(repaired_chunks, 0) AS repaired_chunks, coalesce(bytes_sent, 0) AS bytes_sent
      FROM (SELECT session_id, sum(chunk_size_bytes)::BIGINT AS bytes_read, count(*)::BIGINT AS total_chunks, count(DISTINCT chunk_id)::BIGINT AS unique_chunks FROM pushed GROUP BY 1) r LEFT JOIN
      (SELECT session_id, count(*) FILTER (WHERE action <> 'verify')::BIGINT AS put_requests, count(*) FILTER (WHERE action = 'verify')::BIGINT AS verified_chunks, count(*) FILTER (WHERE action = 'repair')::BIGINT AS repaired_chunks,
        coalesce(sum(size) FILTER (WHERE action <> 'verify'), 0)::BIGINT AS bytes_sent FROM replicas GROUP BY 1) d USING (session_id)""",
    "live_roots": "SELECT root_object_id FROM versions WHERE version_id NOT IN (SELECT version_id FROM retirements)",
    "live": """SELECT layout_id, object_id FROM layouts l WHERE object_id IN (SELECT root_object_id FROM live_roots) OR EXISTS (SELECT 1 FROM finalizations f JOIN sessions s USING (session_id)
        WHERE f.layout_id = l.layout_id AND s.finalized_version_id IS NOT NULL AND s.finalized_version_id NOT IN (SELECT version_id FROM retirements))""",
    "few_versions": "SELECT * FROM versions WHERE doc_no % 5 <> 0",
    "bare_live": "SELECT layout_id FROM layouts WHERE object_id IN (SELECT root_object_id FROM few_versions WHERE doc_no % 3 <> 0)",
    "bare_live_chunks": "SELECT DISTINCT chunk_id FROM layout_chunks WHERE layout_id IN (SELECT layout_id FROM bare_live)",
    "told": "SELECT node_id, chunk_id, size_bytes, chunk_id NOT IN (SELECT chunk_id FROM bare_live_chunks) AS collectible FROM inventory",
    "dead_locations": f"SELECT chunk_id, node_id FROM locations WHERE node_id = '{TARGET}' AND chunk_id NOT IN (SELECT chunk_id FROM bare_live_chunks)",
    "rules": f"SELECT * FROM (VALUES {RULES}) r(artifact_kind, keep_last_n, max_age_seconds)",
    "ranked": """SELECT version_id, artifact_id, coalesce(kind, 'generic') AS artifact_kind, logical_size_bytes, created_s,
        row_number() OVER (PARTITION BY artifact_id, coalesce(kind, 'generic') ORDER BY created_s DESC, version_id) AS rank_in_kind
      FROM versions WHERE state = 'committed' AND version_id NOT IN (SELECT version_id FROM retirements)""",
    "decided": f"""SELECT version_id, artifact_id, artifact_kind, rank_in_kind, CASE WHEN reason = 'policy-retire' THEN 'retire' ELSE 'retain' END AS decision, reason, logical_size_bytes FROM (SELECT *, CASE
        WHEN version_id IN (SELECT version_id FROM pins) THEN 'pinned' WHEN version_id IN (SELECT version_id FROM tags) THEN 'tagged' WHEN version_id IN (SELECT version_id FROM manifest_entries) THEN 'manifest-referenced'
        WHEN rank_in_kind <= keep_last_n THEN 'keep-last-n' WHEN {EVALUATED_S} - created_s < max_age_seconds THEN 'age-not-reached' ELSE 'policy-retire' END AS reason FROM ranked JOIN rules USING (artifact_kind))""",
    "order_decided": f"""SELECT version_id, artifact_id, artifact_kind, rank_in_kind, CASE WHEN reason = 'policy-retire' THEN 'retire' ELSE 'retain' END AS decision, reason, logical_size_bytes FROM (SELECT *, CASE
        WHEN k % 17 = 0 THEN 'pinned' WHEN k % 13 = 0 THEN 'tagged' WHEN k % 11 = 0 THEN 'manifest-referenced' WHEN rank_in_kind <= keep_last_n THEN 'keep-last-n'
        WHEN 1000000000000000 - us < max_age_seconds * 1000000 THEN 'age-not-reached' ELSE 'policy-retire' END AS reason
      FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id, artifact_kind ORDER BY us DESC, version_id) AS rank_in_kind FROM (SELECT o_orderkey AS k, o_orderkey::VARCHAR AS version_id, o_custkey::VARCHAR AS artifact_id,
        ([{", ".join(f"'{k}'" for k in K.KINDS)}])[substr(o_orderpriority, 1, 1)::INT] AS artifact_kind, epoch_us(o_orderdate) AS us, round(o_totalprice * 100)::BIGINT AS logical_size_bytes FROM orders)) JOIN rules USING (artifact_kind))""",
}


def using(sql: str) -> str:
    """``sql`` after those parts of the catalog that it needs."""
    import re

    need: list[str] = []

    def add(text: str) -> None:
        for name in re.findall(r"[a-z_0-9]+", text):
            if name in CATALOG and name not in need:
                add(CATALOG[name])
                need.append(name)

    add(sql)
    parts = [f"{n} AS {'MATERIALIZED ' if n not in ('rules', 'nodes') else ''}({CATALOG[n]})" for n in CATALOG if n in need]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


COUNT = "count(*)::BIGINT"
_OUTCOME = f"""SELECT session_id, CASE WHEN state = 'aborted' THEN 'session-not-open' WHEN version_id IN (SELECT version_id FROM retirements) THEN 'version-retired'
    WHEN state = 'committed' AND doc_id % 100 <> 0 THEN 'retry-mismatch' WHEN state = 'committed' THEN 'ok' WHEN bad THEN 'size-mismatch' WHEN under THEN 'under-replicated' ELSE 'ok' END AS outcome
  FROM (SELECT doc_id, version_id, {uuid("'p' || doc_id")} AS session_id, CASE WHEN doc_id % 70 = 0 THEN 'aborted' WHEN doc_id % 50 = 0 THEN 'committed' ELSE 'open' END AS state, CASE WHEN doc_id % 30 = 0 THEN 512 ELSE 1024 END AS size
    FROM version_docs) s
  LEFT JOIN (SELECT session_id, bool_or((chunk_id, node_id) NOT IN (SELECT (chunk_id, node_id) FROM locations WHERE state = 'available')) AS under FROM pushed JOIN desired USING (chunk_id) GROUP BY 1) USING (session_id)
  LEFT JOIN (SELECT session_id, bool_or(CASE WHEN final THEN chunk_size_bytes > size ELSE chunk_size_bytes <> size END) AS bad FROM (SELECT p.session_id, p.chunk_size_bytes, d.size,
      lead(chunk_index) OVER (PARTITION BY p.session_id ORDER BY chunk_index) IS NULL AS final FROM pushed p JOIN (SELECT {uuid("'p' || doc_id")} AS session_id, CASE WHEN doc_id % 30 = 0 THEN 512 ELSE 1024 END AS size FROM docs) d USING (session_id)) GROUP BY 1) USING (session_id)"""

SQL = {
    "chunk_dedup_by_source": f"""SELECT source, {COUNT} AS chunks, count(DISTINCT chunk_id)::BIGINT AS unique_chunks, sum(n)::BIGINT AS bytes, (SELECT sum(m) FROM (SELECT any_value(x.n) AS m FROM flat x WHERE x.source IS NOT DISTINCT FROM flat.source GROUP BY x.chunk_id))::BIGINT AS unique_bytes, 0.0 AS dedup_ratio FROM flat GROUP BY source""",
    "shared_chunks": f"SELECT chunk_id, count(DISTINCT object_id)::BIGINT AS objects FROM pieces GROUP BY 1 HAVING count(DISTINCT object_id) > 1",
    "object_identity": f"SELECT object_id, {COUNT} AS documents, max(bytes) AS total_size_bytes FROM docs GROUP BY 1",
    "layout_id": "SELECT layout_id, object_id, chunk_count, total_size_bytes FROM layouts",
    "version_id": "SELECT version_id, artifact_id, doc_no FROM versions",
    "manifest_id": "SELECT manifest_id, role, version_id FROM manifest_entries",
    "size_conflicts": "SELECT chunk_id, 2::BIGINT AS sizes FROM chunks WHERE substr(chunk_id, 1, 2) = '0a'",
    "placement_rf2": "SELECT chunk_id, string_agg(node_id, ',' ORDER BY place) AS nodes FROM desired GROUP BY 1",
    "node_chunk_counts": f"SELECT node_id, {COUNT} AS chunks FROM locations WHERE state = 'available' GROUP BY 1",
    "readable_sources": "SELECT chunk_id, string_agg(node_id || ':' || address || ':' || port, ',' ORDER BY node_id) AS sources FROM readable GROUP BY 1",
    "negotiation_classes": f"""SELECT w.chunk_id, known, known AND substr(w.chunk_id, 1, 1) = '3' AS size_conflict, CASE WHEN w.chunk_id IN (SELECT chunk_id FROM locations WHERE state = 'available' AND node_id = '{TARGET}') THEN 'available_on_target'
        WHEN w.chunk_id IN (SELECT chunk_id FROM locations WHERE state = 'available') THEN 'available_elsewhere' ELSE 'no_available_location' END AS availability
      FROM (SELECT chunk_id, true AS known FROM chunks UNION ALL SELECT sha256('new' || node_id), false FROM nodes) w""",
    "under_replicated": "SELECT chunk_id, node_id FROM desired WHERE (chunk_id, node_id) NOT IN (SELECT (chunk_id, node_id) FROM locations WHERE state = 'available')",
    "artifact_health": f"""SELECT version_id AS artifact_id, count(chunk_id)::BIGINT AS n_chunks, CASE WHEN count(chunk_id) = 0 OR min(n) = 0 THEN 'unavailable' WHEN min(n) < 2 THEN 'degraded' ELSE 'healthy' END AS health
      FROM versions v LEFT JOIN (SELECT object_id, chunk_id, (SELECT count(*) FROM readable r WHERE r.chunk_id = p.chunk_id) AS n FROM pieces p WHERE chunk_size = 1024) p ON p.object_id = v.root_object_id GROUP BY 1""",
    "physical_representation": """SELECT layout_id, total, available_rows, available_chunks, CASE WHEN total = 0 OR available_rows = 0 THEN 'reclaimed' WHEN available_rows < total THEN 'partially-reclaimed' ELSE 'present' END AS status,
        CASE WHEN total = 0 OR available_chunks = 0 THEN 'reclaimed' WHEN available_chunks < total THEN 'partially-reclaimed' ELSE 'present' END AS strict_status
      FROM (SELECT l.layout_id, count(c.chunk_id)::BIGINT AS total, coalesce(sum(n), 0)::BIGINT AS available_rows, count(n)::BIGINT AS available_chunks FROM layouts l LEFT JOIN layout_chunks c ON c.layout_id = l.layout_id
        LEFT JOIN (SELECT chunk_id, count(*) AS n FROM locations WHERE state = 'available' GROUP BY 1) a ON a.chunk_id = c.chunk_id GROUP BY 1)""",
    "restorable_layout_any": "SELECT object_id, layout_id FROM best",
    "restorable_layout_node": f"SELECT object_id, min(layout_id) AS layout_id FROM layouts l WHERE NOT EXISTS (SELECT 1 FROM layout_chunks c WHERE c.layout_id = l.layout_id AND c.chunk_id NOT IN (SELECT chunk_id FROM locations WHERE state = 'available' AND node_id = '{TARGET}')) GROUP BY 1",
    "restore_outcomes": "SELECT version_id, outcome, CASE WHEN outcome = 'ok' THEN layout_id END AS layout_id FROM outcomes",
    "restore_plan": "SELECT version_id, chunk_index, chunk_id, (SELECT string_agg(node_id, ',' ORDER BY node_id) FROM readable r WHERE r.chunk_id = plan.chunk_id) AS sources FROM plan",
    "restore_prefix": """SELECT object_id, count(*) FILTER (WHERE keep)::BIGINT AS kept_chunks, coalesce(sum(chunk_size_bytes) FILTER (WHERE keep), 0)::BIGINT AS kept_bytes FROM (SELECT *, coalesce(chunk_index < min(CASE WHEN substr(chunk_id, 1, 1) = 'f' THEN chunk_index END) OVER (PARTITION BY object_id), true) AS keep
      FROM pieces WHERE chunk_size = 1024) GROUP BY 1""",
    "pull_stats": f"""SELECT version_id, sum(chunk_size_bytes)::BIGINT AS restored_bytes, {COUNT} AS total_chunks, count(*) FILTER (WHERE chunk_index >= 2)::BIGINT AS downloaded_chunks, count(*) FILTER (WHERE chunk_index < 2)::BIGINT AS reused_chunks,
        coalesce(sum(chunk_size_bytes) FILTER (WHERE chunk_index >= 2), 0)::BIGINT AS received_bytes FROM plan GROUP BY 1""",
    "cluster_state": "SELECT n.node_id, address, port, n.state, count(*) FILTER (WHERE l.state = 'available')::BIGINT AS available, count(l.chunk_id)::BIGINT AS locations FROM nodes n LEFT JOIN locations l ON l.node_id = n.node_id GROUP BY ALL",
    "push_stats": "SELECT * FROM push",
    "write_amplification": "SELECT session_id, CASE WHEN bytes_read > 0 THEN bytes_sent / bytes_read ELSE 0 END AS storage_byte_amplification, CASE WHEN bytes_read > 0 THEN greatest(bytes_read - bytes_sent, 0) / bytes_read ELSE 0 END AS network_avoidance_ratio FROM push",
    "finalize_outcomes": _OUTCOME,
    "finalized_versions": f"""SELECT DISTINCT version_id FROM ({_OUTCOME}) JOIN (SELECT {uuid("'p' || doc_id")} AS session_id, version_id FROM version_docs) USING (session_id)
      WHERE outcome = 'ok' AND version_id NOT IN (SELECT version_id FROM few_versions)""",
    "page_parameters": """SELECT o_orderkey, valid, CASE WHEN valid AND form IN (0, 1) THEN cursor END AS after, CASE WHEN valid AND form IN (1, 2) THEN o_orderkey % 300 END::BIGINT AS "limit"
      FROM (SELECT *, CASE form WHEN -1 THEN true WHEN 0 THEN length(cursor) = 64 WHEN 1 THEN length(cursor) = 64 AND o_orderkey % 300 BETWEEN 1 AND 256 WHEN 2 THEN o_orderkey % 300 BETWEEN 1 AND 256 ELSE false END AS valid
        FROM (SELECT o_orderkey, substr(sha256(o_orderkey::VARCHAR), 1, CASE WHEN o_orderkey % 7 = 0 THEN 63 ELSE 64 END) AS cursor,
          CASE WHEN o_orderkey % 11 = 0 THEN -1 WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN 9 ELSE o_orderkey % 4 END AS form FROM orders))""",
    "live_layouts": "SELECT layout_id, object_id FROM live",
    "collectible_chunks": "SELECT node_id, chunk_id, collectible FROM told",
    "gc_physical_stats": f"SELECT node_id, {COUNT} AS scanned_chunks, sum(size_bytes)::BIGINT AS scanned_bytes, count(*) FILTER (WHERE collectible)::BIGINT AS collectible_chunks, coalesce(sum(size_bytes) FILTER (WHERE collectible), 0)::BIGINT AS collectible_bytes FROM told GROUP BY 1",
    "gc_dry_run_counts": f"""SELECT (SELECT {COUNT} FROM dead_locations) AS locations, (SELECT {COUNT} FROM layouts WHERE layout_id NOT IN (SELECT layout_id FROM bare_live)) AS layouts,
      (SELECT {COUNT} FROM objects WHERE object_id NOT IN (SELECT root_object_id FROM few_versions) AND object_id NOT IN (SELECT object_id FROM layouts)) AS objects,
      (SELECT {COUNT} FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM layout_chunks) AND chunk_id NOT IN (SELECT chunk_id FROM locations)) AS chunks""",
    "gc_apply_counts": f"""SELECT (SELECT {COUNT} FROM dead_locations) AS locations, (SELECT {COUNT} FROM layouts WHERE layout_id NOT IN (SELECT layout_id FROM bare_live)) AS layouts,
      (SELECT {COUNT} FROM objects WHERE object_id NOT IN (SELECT root_object_id FROM few_versions) AND object_id NOT IN (SELECT object_id FROM layouts WHERE layout_id IN (SELECT layout_id FROM bare_live))) AS objects,
      (SELECT {COUNT} FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM bare_live_chunks) AND chunk_id NOT IN (SELECT chunk_id FROM locations WHERE (chunk_id, node_id) NOT IN (SELECT (chunk_id, node_id) FROM dead_locations))) AS chunks""",
    "orphan_objects": "SELECT object_id FROM objects WHERE object_id NOT IN (SELECT root_object_id FROM few_versions) AND substr(object_id, 1, 1) <= '7'",
    "orphan_chunks": "SELECT chunk_id FROM chunks WHERE substr(chunk_id, 1, 1) <= '3' AND chunk_id NOT IN (SELECT chunk_id FROM locations WHERE state = 'available' AND node_id <> 'node-1')",
    "lifecycle_decisions": "SELECT * FROM decided",
    "lifecycle_stats": f"""SELECT {COUNT} AS scanned, count(*) FILTER (WHERE reason IN ('pinned', 'tagged', 'manifest-referenced'))::BIGINT AS protected, count(*) FILTER (WHERE reason IN ('keep-last-n', 'age-not-reached'))::BIGINT AS retained,
        count(*) FILTER (WHERE decision = 'retire')::BIGINT AS candidates, coalesce(sum(logical_size_bytes) FILTER (WHERE decision = 'retire'), 0)::BIGINT AS candidate_bytes,
        count(*) FILTER (WHERE decision = 'retire')::BIGINT AS retired, coalesce(sum(logical_size_bytes) FILTER (WHERE decision = 'retire'), 0)::BIGINT AS retired_bytes FROM decided""",
    "lifecycle_reason_histogram": f"SELECT reason, decision, {COUNT} AS n, sum(logical_size_bytes)::BIGINT AS bytes FROM decided GROUP BY 1, 2",
    "retire_apply": "SELECT version_id, artifact_kind, reason FROM retirements UNION ALL SELECT version_id, artifact_kind, reason FROM decided WHERE decision = 'retire'",
    "decision_page": "SELECT version_id, decision, reason FROM decided WHERE version_id > '4' ORDER BY version_id LIMIT 100",
    "keep_last_n": "SELECT * FROM order_decided",
    "keep_last_n_stats": f"SELECT reason, decision, {COUNT} AS n, sum(logical_size_bytes)::BIGINT AS bytes FROM order_decided GROUP BY 1, 2",
    "layout_contiguity": "SELECT DISTINCT layout_id, NOT (substr(layout_id, 1, 1) = '5' AND max(chunk_index) OVER (PARTITION BY layout_id) > 0) AS contiguous, true AS indexed FROM layout_chunks",
    "layout_conformance": "SELECT layout_id, chunk_size = 1024 OR total_size_bytes <= 1024 AS conforms FROM layouts WHERE chunk_count > 0",
    "layout_rollups": "SELECT layout_id, chunk_count AS n, total_size_bytes AS bytes FROM layouts WHERE substr(layout_id, 1, 1) = 'a'",
    "corruption_report": "SELECT reverse(layout_id) AS layout_id, layout_id AS computed_id FROM layouts WHERE substr(layout_id, 1, 1) = 'b'",
    "fk_violations": f"""SELECT reference, n::BIGINT AS n FROM (VALUES ('object_layouts.object_id', (SELECT count(*) FROM layouts WHERE substr(object_id, 1, 1) = '0')), ('object_layout_chunks.layout_id', 0), ('object_layout_chunks.chunk_id', 0),
      ('artifact_versions.root_object_id', (SELECT count(*) FROM versions WHERE substr(root_object_id, 1, 1) = '0')), ('tags.version_id', 0), ('storage_locations.chunk_id', 0), ('manifest_entries.version_id', 0), ('upload_sessions.finalized_version_id', 0),
      ('upload_session_finalizations.session_id', 0), ('upload_session_finalizations.layout_id', 0), ('artifact_version_pins.version_id', 0), ('artifact_version_retirements.version_id', 0)) v(reference, n)""",
    "id_format_violations": f"""SELECT what, count(*) FILTER (WHERE ok)::BIGINT AS good, count(*) FILTER (WHERE NOT ok)::BIGINT AS bad FROM (
      SELECT 'chunk' AS what, regexp_full_match(CASE WHEN substr(chunk_id, 1, 1) = 'c' THEN upper(chunk_id) ELSE chunk_id END, '[0-9a-f]{{64}}') AS ok FROM chunks
      UNION ALL SELECT 'node', regexp_full_match(r_name, '[A-Za-z0-9._-]{{1,128}}') FROM region
      UNION ALL SELECT 'session', substr(session_id, 15, 1) = '7' AND substr(session_id, 20, 1) IN ('8', '9', 'a', 'b') AND length(session_id) = 36 FROM sessions UNION ALL SELECT 'address', node_id <> 'node-2' FROM nodes) GROUP BY 1""",
    "placement_set_valid": "SELECT o_orderkey, (o_orderkey % 4) BETWEEN 1 AND 3 AND o_orderkey % 7 < (o_orderkey + 1) % 7 AND (o_orderkey + 1) % 7 < (o_orderkey + 2) % 7 AS valid FROM orders",
    "policy_valid": f"""SELECT policy_id::VARCHAR AS policy_id, count(*) = 5 AND count(DISTINCT k) = 5 AND bool_and(keep BETWEEN 0 AND 1000 AND (age IS NULL OR age BETWEEN 0 AND 315360000)) AND policy_id <> 7 AS valid FROM (SELECT p_partkey // 5 AS policy_id, p_partkey % 5 AS k,
        p_size * CASE WHEN p_partkey % 41 = 0 THEN 1000 ELSE 1 END AS keep, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 1000 END AS age FROM part) WHERE policy_id % 9 <> 1 OR k <> 0 GROUP BY policy_id""",
    "busy_guards": "SELECT count(*) FILTER (WHERE state = 'open') > 0 AS open_sessions, false AS open_gc, false AS open_replication FROM sessions",
    "cdc_parameters_valid": """SELECT p_partkey, lo >= 64 AND avg >= 64 AND (avg & (avg - 1)) = 0 AND lo <= avg AND avg <= hi AND hi <= 8388608 AS valid FROM (SELECT p_partkey, (p_size * 16)::BIGINT AS lo,
        pow(2, p_partkey % 14)::BIGINT + CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END AS avg, p_partkey * 64 AS hi FROM part)""",
    "upsert_locations": """SELECT chunk_id, node_id, storage_path, CASE WHEN node_id = 'node-2' THEN 'available' ELSE state END AS state, CASE WHEN node_id = 'node-2' THEN 2 ELSE 1 END::BIGINT AS "at", 1::BIGINT AS created FROM locations
      UNION ALL SELECT sha256(node_id), node_id, 'chunks/' || substr(sha256(node_id), 1, 2) || '/' || sha256(node_id), 'available', 2, 2 FROM nodes""",
    "insert_if_absent_chunks": "SELECT chunk_id, size_bytes FROM chunks",
    "insert_conflicts": "SELECT chunk_id FROM chunks WHERE substr(chunk_id, 1, 2) = 'ab'",
    "version_transitions": "SELECT version_id, CASE WHEN state = 'staging' AND version_id NOT IN (SELECT version_id FROM protected) THEN 'committed' ELSE state END AS state FROM versions",
    "run_times": "SELECT o_orderkey, (epoch_us(o_orderdate) + o_orderkey % 1000 + 500) // 1000 AS started_ms, CASE WHEN o_orderstatus <> 'O' THEN (epoch_us(o_orderdate) + o_orderkey % 1000 + 1500499 + 500) // 1000 END AS completed_ms FROM orders",
    "throughput_median": "SELECT event_type, quantile_cont(value, 0.5) AS median_s, CASE WHEN quantile_cont(value, 0.5) > 0 THEN 64.0::DOUBLE / quantile_cont(value, 0.5) ELSE 0 END AS mib_per_s FROM events GROUP BY 1",
    "event_windows": f"SELECT epoch_us(date_trunc('hour', ts)) AS hour_us, event_type, {COUNT} AS n, max(value) AS max_value FROM events GROUP BY 1, 2",
}
SQL |= {
    "layouts_of_objects": "SELECT object_id, layout_id, chunk_count FROM layouts WHERE object_id = (SELECT object_id FROM docs WHERE doc_id = 3)",
    "node_lookup": f"SELECT node_id, address, port, state FROM nodes WHERE node_id = '{TARGET}'",
    "layout_chunk_sizes": "SELECT layout_id, chunk_index, chunk_id, chunk_size_bytes AS size_bytes FROM layout_chunks",
    "endpoint_union": "SELECT DISTINCT node_id, address, port FROM nodes WHERE state IN ('active', 'draining')",
    "unready_placements": "SELECT session_id, node_id FROM sessions s, nodes n WHERE s.state = 'open' AND n.state <> 'active'",
    "session_identity": "SELECT o_orderkey, NOT (o_orderkey % 5 = 0 AND o_orderstatus = 'O') AS same FROM orders",
    "counter_checks": f"SELECT l_returnflag, count(*) FILTER (WHERE l_quantity >= 3 AND l_extendedprice >= 0)::BIGINT AS good, count(*) FILTER (WHERE NOT (l_quantity >= 3 AND l_extendedprice >= 0))::BIGINT AS bad FROM lineitem GROUP BY 1",
    "start_outcomes": "SELECT kind, CASE WHEN kind = 'replication' OR NOT EXISTS (SELECT 1 FROM sessions WHERE state = 'open') THEN 'ok' ELSE 'open-sessions' END AS outcome FROM (VALUES ('gc'), ('replication'), ('lifecycle')) v(kind)",
}

_KEYED = {
    "chunks": ("chunks", "chunk_id"), "objects": ("objects", "object_id"), "object_layouts": ("layouts", "layout_id"), "object_layout_chunks": ("layout_chunks", "layout_id || ':' || chunk_index"), "artifact_versions": ("versions", "version_id"),
    "storage_locations": ("locations", "chunk_id || ':' || node_id"), "tags": ("tags", "artifact_id || ':' || tag_name"), "manifest_entries": ("manifest_entries", "manifest_id || ':' || role"), "upload_sessions": ("sessions", "session_id"),
    "upload_session_finalizations": ("finalizations", "session_id"), "artifact_version_retirements": ("retirements", "version_id"), "artifact_version_pins": ("pins", "version_id"), "storage_nodes": ("nodes", "node_id"),
}
SQL |= {
    "point_lookups": " UNION ALL ".join(f"SELECT '{name}' AS name, least({COUNT}, 1) AS n, min({key}) AS key FROM {t}" for name, (t, key) in _KEYED.items()),
    "chunk_locations": "SELECT chunk_id, node_id, state FROM locations WHERE chunk_id = (SELECT min(chunk_id) FROM chunks)",
    "nodes_in_order": "SELECT * FROM nodes",
    "policy_files_valid": """SELECT p_partkey, p_partkey % 13 NOT IN (1, 2) AND p_partkey % 11 NOT IN (1, 2) AND p_size * 21 <= 1000 AND (p_partkey % 7 = 3 OR (p_partkey % 7 NOT IN (1, 2, 4) AND p_partkey * 20000 <= 315360000)) AS valid FROM part""",
    "decisions_need_rules": f"SELECT k AS artifact_kind, n AS versions, CASE WHEN k = 'generic' THEN 0 ELSE 2 END::BIGINT AS rules FROM (SELECT coalesce(kind, 'generic') AS k, {COUNT} AS n FROM versions GROUP BY 1) WHERE k IN ('generic', 'embedding-index')",
    "gc_run_stats": f"""SELECT m.mode, {COUNT} AS scanned_chunks, sum(size_bytes)::BIGINT AS scanned_bytes, count(*) FILTER (WHERE collectible)::BIGINT AS collectible_chunks, coalesce(sum(size_bytes) FILTER (WHERE collectible), 0)::BIGINT AS collectible_bytes,
      count(*) FILTER (WHERE collectible AND m.mode = 'apply')::BIGINT AS deleted_chunks, coalesce(sum(size_bytes) FILTER (WHERE collectible AND m.mode = 'apply'), 0)::BIGINT AS deleted_bytes FROM told, (VALUES ('dry-run'), ('apply')) m(mode) WHERE node_id = '{TARGET}' GROUP BY 1""",
    "source_failovers": """SELECT w.chunk_id, count(*) FILTER (WHERE s.d < '5' AND (f.ok IS NULL OR s.node_id < f.ok))::BIGINT AS failovers, max(f.ok IS NOT NULL) AS supplied
      FROM (SELECT DISTINCT chunk_id FROM desired WHERE (chunk_id, node_id) NOT IN (SELECT (chunk_id, node_id) FROM readable)) w
      LEFT JOIN (SELECT chunk_id, node_id, substr(sha256(node_id || chunk_id), 1, 1) AS d FROM readable) s USING (chunk_id)
      LEFT JOIN (SELECT chunk_id, min(node_id) AS ok FROM readable WHERE substr(sha256(node_id || chunk_id), 1, 1) >= '7' GROUP BY 1) f USING (chunk_id) GROUP BY 1""",
}

# Those that read more than one shape of the same rows.
_FLAT = "flat AS MATERIALIZED (SELECT source, least({size}, n - i * {size})::BIGINT AS n, sha256(unhex(substr(hx, (i * {size} * 2 + 1)::BIGINT, {size} * 2))) AS chunk_id FROM (SELECT source, hx, n, unnest(range((n + {size} - 1) // {size})) AS i FROM (SELECT source, lower(hex({text})) AS hx, strlen({text}) AS n FROM documents WHERE text IS NOT NULL)))"
SQL["chunk_dedup_by_source"] = f"""WITH {_FLAT.format(size=1024, text="text")}, per AS (SELECT source, chunk_id, count(*) AS c, any_value(n) AS n FROM flat GROUP BY 1, 2)
  SELECT source, sum(c)::BIGINT AS chunks, {COUNT} AS unique_chunks, sum(c * n)::BIGINT AS bytes, sum(n)::BIGINT AS unique_bytes, CASE WHEN sum(c * n) > 0 THEN (sum(c * n) - sum(n))::DOUBLE / sum(c * n)::DOUBLE ELSE 0 END AS dedup_ratio FROM per GROUP BY 1"""
SQL["dedup_shift_reuse"] = f"""WITH {_FLAT.format(size=1024, text="text")}, {_FLAT.format(size=1024, text="(repeat('x', 100) || text)").replace("flat AS", "moved AS")}
  SELECT (SELECT {COUNT} FROM flat) AS base_chunks, {COUNT} AS other_chunks, count(DISTINCT chunk_id) FILTER (WHERE k)::BIGINT AS shared_chunks, coalesce(sum(n) FILTER (WHERE k), 0)::BIGINT AS reused_bytes,
    coalesce(sum(n) FILTER (WHERE k), 0)::DOUBLE / sum(n)::DOUBLE AS reuse_ratio FROM (SELECT *, chunk_id IN (SELECT chunk_id FROM flat) AS k FROM moved)"""
_SETS = "a AS (SELECT chunk_id FROM docs JOIN pieces USING (object_id) WHERE source = 'src0'), b AS (SELECT chunk_id FROM docs JOIN pieces USING (object_id) WHERE source = 'src1')"
SQL["chunk_set_operations"] = f"""SELECT operation, n FROM (WITH {_SETS} SELECT 'intersect' AS operation, {COUNT} AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'subtract', {COUNT} FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
  UNION ALL SELECT 'union', {COUNT} FROM (SELECT * FROM a UNION SELECT * FROM b))"""
_REPAIR = """(SELECT d.chunk_id, d.node_id, d.size_bytes, g.good, NOT g.good AND s.n IS NOT NULL AS repair, coalesce(s.n, 0)::BIGINT AS n_sources
  FROM desired d, LATERAL (SELECT (d.chunk_id, d.node_id) IN (SELECT (chunk_id, node_id) FROM readable) AS good) g LEFT JOIN (SELECT chunk_id, count(*) AS n FROM readable GROUP BY 1) s ON s.chunk_id = d.chunk_id)"""
SQL["replication_plan"] = f"SELECT * FROM {_REPAIR}"
SQL["replication_stats"] = f"""SELECT count(DISTINCT chunk_id)::BIGINT AS chunks_scanned, count(DISTINCT chunk_id) FILTER (WHERE NOT good)::BIGINT AS chunks_under_replicated, count(*) FILTER (WHERE good)::BIGINT AS replicas_verified,
  count(*) FILTER (WHERE repair)::BIGINT AS replicas_written, coalesce(sum(size_bytes) FILTER (WHERE repair), 0)::BIGINT AS bytes_copied FROM {_REPAIR}"""


def oracle_sql() -> dict[str, str]:
    return {name: sql if sql.startswith("WITH") else using(sql) for name, sql in SQL.items()}
