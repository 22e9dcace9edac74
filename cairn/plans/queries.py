"""Registered queries over the derived catalog.

Each takes (spark, sf_dir).  The SQL that checks them is in ``cairn.plans.oracle``.
Decimal sums are cast to long; arrays are joined to text and counts are longs, so
that results have the same types in any engine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import constants as K
from cairn.functions import ids, validators
from cairn.operators import availability as av
from cairn.operators import chunking, dedup, lifecycle, liveness, validate, writes
from cairn.sources.catalog import CDC, CHUNK_SIZE, EPOCH, REPLICAS, Catalog, table, uuid_of
from cairn.sources.lookups import all_nodes, get, locations_of
from cairn.sources.schemas import KEYS
from cairn.sources.stores import parse_policies

EVALUATED_S = EPOCH + 45 * 86400
TARGET = "node-0"
#: kind, keep_last_n, max_age_seconds of the policy the queries evaluate.
POLICY = [("generic", 1, None), ("model-checkpoint", 2, 86400 * 40), ("dataset-snapshot", 0, 86400 * 44), ("embedding-index", 5, None), ("evaluation-output", 0, 0)]
REGISTRY: dict = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


def on_catalog(f):
    """Registers a query that is a function of the catalog."""

    def run(spark, sf_dir):
        return f(Catalog.of(spark, sf_dir))

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    REGISTRY[f.__name__] = run
    return f


def longs(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def rules(spark):
    return spark.createDataFrame(POLICY, "artifact_kind string, keep_last_n int, max_age_seconds long")


# Chunking and sharing.


@query
def chunk_dedup_by_source(spark, sf_dir):
    """Chunks and bytes of each source, in all and distinct."""
    docs = table(spark, sf_dir, "documents").select("source", ids.as_bytes(F.col("text")).alias("content"))
    chunks = docs.select("source", F.explode(chunking.fixed_chunks(F.col("content"), CHUNK_SIZE)).alias("c")).select("source", "c.*")
    return longs(dedup.dedup_stats(chunks, "source"), "chunks", "unique_chunks", "bytes", "unique_bytes")


@on_catalog
def shared_chunks(c):
    return dedup.shared_chunks(c.layout_chunks)


@on_catalog
def dedup_shift_reuse(c):
    """Fixed-size chunks of every text against those of the same text after a prefix of 100 bytes."""
    shifted = c.texts.select(chunking.fixed_chunks(F.concat(F.lit(b"x" * 100), F.col("content")), CHUNK_SIZE).alias("chunks"))
    return longs(dedup.reuse_stats(chunking.exploded(c.docs), chunking.exploded(shifted)), "base_chunks", "other_chunks", "shared_chunks", "reused_bytes")


@on_catalog
def object_identity(c):
    return c.docs.groupBy("object_id").agg(F.count(F.lit(1)).alias("documents"), F.max("bytes").alias("total_size_bytes"))


@on_catalog
def layout_id(c):
    return c.layouts.select("layout_id", "object_id", "chunk_count", "total_size_bytes")


@on_catalog
def version_id(c):
    return c.versions.select("version_id", "artifact_id", "doc_no")


@on_catalog
def manifest_id(c):
    return c.manifest_entries.select("manifest_id", "role", "version_id")


@on_catalog
def fastcdc_chunks(c):
    """Content-defined chunks of every object."""
    return chunking.exploded(c.cdc, "object_id")


@on_catalog
def fastcdc_dedup(c):
    """Content-defined chunks of texts against those of shifted texts."""
    shifted = c.texts.select("object_id", F.concat(F.lit(b"x" * 100), F.col("content")).alias("content"))
    moved = chunking.cdc_layouts(shifted, *CDC).dropDuplicates(["object_id"])
    return longs(dedup.reuse_stats(chunking.exploded(c.cdc, "object_id"), chunking.exploded(moved, "object_id")), "base_chunks", "other_chunks", "shared_chunks", "reused_bytes")


@on_catalog
def size_conflicts(c):
    """Chunk ids submitted with two sizes: every fiftieth row of a batch claims one byte more."""
    batch = c.layout_chunks.select("chunk_id", "chunk_size_bytes")
    wrong = c.chunks.filter(F.substring("chunk_id", 1, 2) == "0a").select("chunk_id", (F.col("size_bytes") + 1).alias("chunk_size_bytes"))
    return dedup.size_conflicts(batch.unionByName(wrong))


@on_catalog
def chunk_set_operations(c):
    """Distinct chunk ids of two sources: in both, only in the first, in either."""
    of = lambda s: c.docs.filter(F.col("source") == s).select("object_id").distinct().join(c.layout_chunks.select("object_id", "chunk_id"), "object_id").select("chunk_id")
    a, b = of("src0"), of("src1")
    count = lambda name, d: d.agg(F.lit(name).alias("operation"), F.count(F.lit(1)).alias("n"))
    return count("intersect", a.intersect(b)).unionByName(count("subtract", a.distinct().subtract(b))).unionByName(count("union", a.union(b).distinct()))


# Placement and availability.


@on_catalog
def placement_rf2(c):
    nodes = F.array_join(ids.replica_nodes(F.col("chunk_id"), F.col("node_ids"), REPLICAS), ",")
    return c.chunks.join(F.broadcast(c.node_ids)).select("chunk_id", nodes.alias("nodes"))


@on_catalog
def node_chunk_counts(c):
    return av.node_chunk_counts(c.locations)


@on_catalog
def readable_sources(c):
    listed = F.transform("sources", lambda s: F.concat_ws(":", s["node_id"], s["address"], s["port"].cast("string")))
    return av.readable_sources(c.locations, c.nodes).select("chunk_id", F.array_join(listed, ",").alias("sources"))


@on_catalog
def negotiation_classes(c):
    """A writer's chunks: those known, some with a wrong size, some unknown."""
    wrong = F.when(F.substring("chunk_id", 1, 1) == "3", 1).otherwise(0)
    fresh = c.nodes.select(F.sha2(F.concat(F.lit("new"), "node_id"), 256).alias("chunk_id"), F.lit(9).cast("long").alias("size_bytes"))
    wanted = c.chunks.select("chunk_id", (F.col("size_bytes") + wrong).alias("size_bytes")).unionByName(fresh)
    return av.negotiate(wanted, c.chunks, c.locations, TARGET)


@on_catalog
def under_replicated(c):
    return av.under_replicated(c.desired, c.locations).select("chunk_id", "node_id")


@on_catalog
def replication_plan(c):
    return av.replication_plan(c.desired, c.locations, c.nodes, c.inventory)


@on_catalog
def replication_stats(c):
    return longs(av.replication_stats(av.replication_plan(c.desired, c.locations, c.nodes, c.inventory)), "chunks_scanned", "chunks_under_replicated", "replicas_verified", "replicas_written", "bytes_copied")


@on_catalog
def source_failovers(c):
    """Repairs in which some nodes answer with an error or don't have the chunk."""
    digit = F.substring(F.sha2(F.concat("node_id", "chunk_id"), 256), 1, 1)
    answer = F.when(digit < "5", "error").when(digit < "7", "absent").otherwise("ok")
    sources = av.readable(c.locations, c.nodes).select("chunk_id", "node_id", answer.alias("answer"))
    return av.source_failovers(av.replication_plan(c.desired, c.locations, c.nodes, c.inventory), sources)


@on_catalog
def artifact_health(c):
    first = c.first_layout_chunks.select("object_id", "chunk_id")
    per = c.versions.select("version_id", "root_object_id").join(first.withColumnRenamed("object_id", "root_object_id"), "root_object_id", "left")
    return av.artifact_health(per.select(F.col("version_id").alias("artifact_id"), "chunk_id"), c.locations, c.nodes, REPLICAS)


@on_catalog
def physical_representation(c):
    return longs(av.physical_representation(c.layouts, c.layout_chunks, c.locations), "total", "available_rows", "available_chunks")


@on_catalog
def restorable_layout_any(c):
    return av.restorable(c.layouts, c.layout_chunks, c.locations, c.nodes)


@on_catalog
def restorable_layout_node(c):
    return av.restorable(c.layouts, c.layout_chunks, c.locations, node=TARGET)


@on_catalog
def restore_outcomes(c):
    return av.restore_outcomes(c.versions, c.retirements, av.restorable(c.layouts, c.layout_chunks, c.locations, c.nodes))


@on_catalog
def restore_plan(c):
    plan = av.restore_plan(c.versions, c.retirements, c.layouts, c.layout_chunks, c.locations, c.nodes)
    return plan.select("version_id", "chunk_index", "chunk_id", F.array_join(F.transform("sources", lambda s: s["node_id"]), ",").alias("sources"))


@on_catalog
def restore_prefix(c):
    """Partial files in which every chunk whose id begins with f is damaged."""
    checked = c.first_layout_chunks.select("object_id", "chunk_index", "chunk_size_bytes", (F.substring("chunk_id", 1, 1) != "f").alias("ok"))
    return longs(dedup.restore_prefix(checked), "kept_chunks", "kept_bytes")


@on_catalog
def pull_stats(c):
    plan = av.restore_plan(c.versions, c.retirements, c.layouts, c.layout_chunks, c.locations, c.nodes)
    have = plan.filter("chunk_index < 2").select("version_id", "chunk_index")
    return longs(dedup.pull_stats(plan, have), "restored_bytes", "received_bytes")


@on_catalog
def cluster_state(c):
    """Nodes with what they hold, available and in all."""
    per = c.locations.groupBy("node_id").agg(F.count_if(F.col("state") == "available").alias("available"), F.count(F.lit(1)).alias("locations"))
    return c.nodes.join(per, "node_id", "left").select("node_id", "address", "port", "state", F.coalesce("available", F.lit(0)).cast("long").alias("available"), F.coalesce("locations", F.lit(0)).cast("long").alias("locations"))


# Pushes and finalization.


def pushed(c):
    """Chunks of a push of every document, one session each."""
    docs = c.docs.select(uuid_of(F.concat(F.lit("p"), "doc_id")).alias("session_id"), "chunks")
    return chunking.exploded(docs, "session_id").select("session_id", "chunk_index", "chunk_id", "chunk_size_bytes")


def thin_inventory(c):
    """The inventory without chunks whose id ends with 7: the catalog lists them, the node lost them."""
    return c.inventory.filter(~F.col("chunk_id").endswith("7"))


@on_catalog
def push_stats(c):
    chunks = pushed(c)
    out = dedup.push_stats(chunks, dedup.push_plan(chunks, c.desired, c.locations, thin_inventory(c)))
    return longs(out, "bytes_read", "total_chunks", "unique_chunks", "put_requests", "verified_chunks", "repaired_chunks", "bytes_sent")


@on_catalog
def write_amplification(c):
    chunks = pushed(c)
    return dedup.amplification(dedup.push_stats(chunks, dedup.push_plan(chunks, c.desired, c.locations, thin_inventory(c))))


def upload_sessions(c):
    """Sessions of every document: some aborted, some with a chunk size that doesn't fit."""
    docs = c.version_docs
    state = F.when(F.col("doc_id") % 70 == 0, "aborted").when(F.col("doc_id") % 50 == 0, "committed").otherwise("open")
    return docs.select(
        uuid_of(F.concat(F.lit("p"), "doc_id")).alias("session_id"), state.alias("state"), "version_id", F.when(F.col("doc_id") % 30 == 0, 512).otherwise(CHUNK_SIZE).cast("long").alias("chunk_size"),
        F.when(state == "committed", F.when(F.col("doc_id") % 100 == 0, F.col("version_id")).otherwise(F.lit("other"))).alias("finalized_version_id"),
    )


@on_catalog
def finalize_outcomes(c):
    submitted = pushed(c)
    wanted = submitted.select("session_id", "chunk_id").distinct().join(c.desired, "chunk_id")
    return writes.finalize_outcomes(upload_sessions(c), submitted, c.chunks, av.under_replicated(wanted, c.locations), c.retirements)


@on_catalog
def finalized_versions(c):
    """Versions that the sessions add where those of four documents in five are known."""
    return writes.finalized_versions(finalize_outcomes(c), upload_sessions(c), c.versions.filter("doc_no % 5 <> 0").select("version_id"))


@query
def page_parameters(spark, sf_dir):
    """Query strings made from orders: keys repeated, unknown, out of bounds or without a value."""
    k = F.col("o_orderkey")
    after = F.concat(F.lit("after="), F.substring(F.sha2(k.cast("string"), 256), 1, F.when(k % 7 == 0, 63).otherwise(64)))
    limit = F.concat(F.lit("limit="), (k % 300).cast("string"))
    text = F.when(k % 4 == 0, after).when(k % 4 == 1, F.concat_ws("&", limit, after)).when(k % 4 == 2, limit).otherwise(F.concat_ws("&", after, after))
    text = F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.lit("limit")).when(k % 17 == 0, F.concat(text, F.lit("&page=2"))).otherwise(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", lifecycle.page_parameters(text).alias("p")).select("o_orderkey", "p.*")


# Mark and sweep.


def snapshot(c):
    return liveness.Snapshot(c.versions, c.retirements, c.sessions, c.finalizations, c.objects, c.layouts.drop("chunks"), c.layout_chunks, c.chunks, c.locations)


def bare_snapshot(c):
    """The catalog in which only versions of four documents in five are known and every third of them is retired."""
    s = snapshot(c)
    s.versions = c.versions.filter("doc_no % 5 <> 0")
    s.retirements = c.versions.filter("doc_no % 3 = 0").select("version_id")
    s.sessions, s.finalizations = c.sessions.limit(0), c.finalizations.limit(0)
    return s


@on_catalog
def live_layouts(c):
    return liveness.live_layouts(snapshot(c))


@on_catalog
def collectible_chunks(c):
    return liveness.classified(c.inventory, bare_snapshot(c)).select("node_id", "chunk_id", "collectible")


@on_catalog
def gc_physical_stats(c):
    return longs(liveness.physical_stats(liveness.classified(c.inventory, bare_snapshot(c))), "scanned_chunks", "scanned_bytes", "collectible_chunks", "collectible_bytes")


@on_catalog
def gc_run_stats(c):
    """Physical counters of a dry and an applied run on one node."""
    told = liveness.classified(c.inventory, bare_snapshot(c))
    one = lambda mode: liveness.run_stats(told, TARGET, mode).withColumn("mode", F.lit(mode))
    return longs(one("dry-run").unionByName(one("apply")), "scanned_chunks", "scanned_bytes", "collectible_chunks", "collectible_bytes", "deleted_chunks", "deleted_bytes")


@on_catalog
def gc_dry_run_counts(c):
    return liveness.dry_run_counts(bare_snapshot(c), TARGET)


@on_catalog
def gc_apply_counts(c):
    return liveness.apply_counts(bare_snapshot(c), TARGET)


@on_catalog
def orphan_objects(c):
    s = bare_snapshot(c)
    s.layouts = s.layouts.filter(F.substring("object_id", 1, 1) > "7")
    return liveness.orphan_objects(s).select("object_id")


@on_catalog
def orphan_chunks(c):
    s = bare_snapshot(c)
    s.layout_chunks = s.layout_chunks.filter(F.substring("chunk_id", 1, 1) > "3")
    s.locations = s.locations.filter("state = 'available' and node_id <> 'node-1'")
    return liveness.orphan_chunks(s).select("chunk_id")


# Retention.


def decided(c):
    versions = lifecycle.with_kind(c.versions).withColumn("created_us", F.col("created_s") * 1_000_000)
    found = lifecycle.candidates(versions, c.retirements, c.pins, c.tags, c.manifest_entries)
    return lifecycle.decide(found, rules(c.spark), EVALUATED_S * 1_000_000)


@on_catalog
def lifecycle_decisions(c):
    return decided(c)


@on_catalog
def lifecycle_stats(c):
    return longs(lifecycle.stats(decided(c), "apply"), "scanned", "protected", "retained", "candidates", "candidate_bytes", "retired", "retired_bytes")


@on_catalog
def lifecycle_reason_histogram(c):
    return longs(lifecycle.histogram(decided(c)), "n", "bytes")


@on_catalog
def retire_apply(c):
    return lifecycle.retire(c.retirements, decided(c))


@on_catalog
def decision_page(c):
    return lifecycle.page(decided(c), "4", 100).select("version_id", "decision", "reason")


def order_versions(spark, sf_dir):
    """Orders as versions: artifact per customer, kind by priority."""
    orders = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*[F.lit(k) for k in K.KINDS]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return orders.select(
        F.col("o_orderkey").cast("string").alias("version_id"), F.col("o_custkey").cast("string").alias("artifact_id"), kind.alias("artifact_kind"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_us"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("logical_size_bytes"), (F.col("o_orderkey") % 17 == 0).alias("pinned"), (F.col("o_orderkey") % 13 == 0).alias("tagged"), (F.col("o_orderkey") % 11 == 0).alias("in_manifest"),
    )


@query
def keep_last_n(spark, sf_dir):
    """The policy over orders, at volume."""
    latest = 1_000_000_000_000_000
    return lifecycle.decide(order_versions(spark, sf_dir), rules(spark), latest)


@query
def keep_last_n_stats(spark, sf_dir):
    latest = 1_000_000_000_000_000
    return longs(lifecycle.histogram(lifecycle.decide(order_versions(spark, sf_dir), rules(spark), latest)), "n", "bytes")


# Reports.


@on_catalog
def layout_contiguity(c):
    """One chunk in each layout that begins with 5 is shifted by a byte."""
    bad = (F.substring("layout_id", 1, 1) == "5") & (F.col("chunk_index") == 1)
    return validate.layout_report(c.layout_chunks.withColumn("byte_offset", F.col("byte_offset") + F.when(bad, 1).otherwise(0)))


@on_catalog
def layout_conformance(c):
    return validate.conformance_report(c.layout_chunks, CHUNK_SIZE)


@on_catalog
def layout_rollups(c):
    """Stored totals, one in sixteen of them wrong, against the chunks."""
    wrong = c.layouts.withColumn("chunk_count", F.col("chunk_count") + (F.substring("layout_id", 1, 1) == "a").cast("long"))
    return longs(validate.rollup_mismatches(wrong, c.layout_chunks), "n", "bytes")


@on_catalog
def corruption_report(c):
    """Layouts whose stored id was altered are found again from their chunks."""
    stored = F.when(F.substring("layout_id", 1, 1) == "b", F.reverse("layout_id")).otherwise(F.col("layout_id"))
    return validate.stored_id_mismatches(c.layouts.withColumn("layout_id", stored))


@on_catalog
def fk_violations(c):
    held = {
        "object_layouts": c.layouts, "objects": c.objects.filter(F.substring("object_id", 1, 1) != "0"), "object_layout_chunks": c.layout_chunks, "chunks": c.chunks, "artifact_versions": c.versions, "tags": c.tags,
        "storage_locations": c.locations.filter("state <> 'missing'"), "artifact_version_pins": c.pins, "manifest_entries": c.manifest_entries, "upload_sessions": c.sessions, "upload_session_finalizations": c.finalizations,
        "artifact_version_retirements": c.retirements,
    }
    references = [r for r in validate.REFERENCES if r[1] not in ("artifact_id", "parent_version_id", "lifecycle_run_id")]
    return validate.dangling(held, references)


@on_catalog
def id_format_violations(c):
    """Ids of several kinds, some of them broken, against their formats."""
    chunk = c.chunks.select(F.lit("chunk").alias("what"), validators.content_id_ok(F.when(F.substring("chunk_id", 1, 1) == "c", F.upper("chunk_id")).otherwise(F.col("chunk_id"))).alias("ok"))
    node = c.raw("region").select(F.lit("node").alias("what"), validators.node_id_ok(F.col("r_name")).alias("ok"))
    uuid = c.sessions.select(F.lit("session").alias("what"), validators.uuid_v7_ok(F.col("session_id")).alias("ok"))
    address = c.nodes.select(F.lit("address").alias("what"), validators.address_ok(F.col("address"), F.col("port") * F.when(F.col("node_id") == "node-2", 10).otherwise(1)).alias("ok"))
    return chunk.unionByName(node).unionByName(uuid).unionByName(address).groupBy("what").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"))


@query
def placement_set_valid(spark, sf_dir):
    """Placement sets made from orders: unsorted, too small and wrongly targeted ones among them."""
    k = F.col("o_orderkey")
    node = lambda n: F.concat(F.lit("n"), n % 7)
    nodes = F.array(node(k), node(k + 1), node(k + 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", validators.placement_ok(nodes, (k % 4).cast("int"), node(k)).alias("valid"))


@query
def policy_valid(spark, sf_dir):
    """Policies of five parts each; rules come from parts, so some lack a kind or go out of bounds."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*[F.lit(k) for k in K.KINDS]), (F.col("p_partkey") % 5 + 1).cast("int"))
    made = p.select(F.floor(F.col("p_partkey") / 5).cast("string").alias("policy_id"), kind.alias("artifact_kind"), (F.col("p_size") * F.when(F.col("p_partkey") % 41 == 0, 1000).otherwise(1)).cast("int").alias("keep_last_n"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") * 1000).cast("long").alias("max_age_seconds"))
    made = made.filter("cast(policy_id as int) % 9 <> 1 or artifact_kind <> 'generic'")
    policies = made.select("policy_id").distinct().withColumn("name", F.when(F.col("policy_id") == "7", "").otherwise(F.concat(F.lit("policy "), "policy_id")))
    return lifecycle.policy_report(policies, made)


@query
def policy_files_valid(spark, sf_dir):
    """Policy files made from parts: bounds, names, and values of a wrong JSON type."""
    k = F.col("p_partkey")
    age = F.when(k % 7 == 1, F.lit('"abc"')).when(k % 7 == 2, F.lit("1.5")).when(k % 7 == 3, F.lit("null")).when(k % 7 == 4, F.lit("true")).otherwise((k * 20000).cast("string"))
    keep = F.when(k % 11 == 1, F.lit('"3"')).when(k % 11 == 2, F.lit("2.0")).otherwise((F.col("p_size") * 21).cast("string"))
    rule = lambda kind, n, a: F.concat(F.lit(f'{{"artifact_kind":"{kind}","keep_last_n":'), n, F.lit(',"max_age_seconds":'), a, F.lit("}"))
    rest = ",".join(f'{{"artifact_kind":"{x}","keep_last_n":1,"max_age_seconds":null}}' for x in K.KINDS[1:])
    name = F.when(k % 13 == 1, F.lit("5")).when(k % 13 == 2, F.lit('""')).otherwise(F.lit('"p"'))
    json = F.concat(F.lit('{"name":'), name, F.lit(',"rules":['), rule(K.KINDS[0], keep, age), F.lit(f",{rest}]}}"))
    return parse_policies(table(spark, sf_dir, "part").select("p_partkey", json.alias("json"))).select("p_partkey", "valid")


@on_catalog
def decisions_need_rules(c):
    """Kinds of versions that a policy with a rule missing and a rule repeated can't decide on."""
    some = rules(c.spark).filter("artifact_kind <> 'generic'")
    return lifecycle.rule_problems(lifecycle.with_kind(c.versions), some.unionByName(some.filter("artifact_kind = 'embedding-index'")))


@on_catalog
def busy_guards(c):
    none = c.sessions.limit(0).select("state")
    return writes.busy(c.sessions, none, none)


@query
def cdc_parameters_valid(spark, sf_dir):
    """Parameter sets made from parts."""
    p = table(spark, sf_dir, "part")
    low, avg, high = F.col("p_size") * 16, F.pow(F.lit(2), F.col("p_partkey") % 14).cast("long") + F.when(F.col("p_partkey") % 29 == 0, 1).otherwise(0), (F.col("p_partkey") * 64).cast("long")
    return p.select("p_partkey", validators.cdc_parameters_ok(low.cast("long"), avg, high).alias("valid"))


# Writes.


@on_catalog
def upsert_locations(c):
    """Locations after the ones on node-2 were verified and a few new ones registered."""
    old = c.locations.withColumn("at", F.lit(1).cast("long")).withColumn("created", F.lit(1).cast("long"))
    seen = c.locations.filter("node_id = 'node-2'").withColumn("state", F.lit("available"))
    fresh = c.nodes.select(F.sha2("node_id", 256).alias("chunk_id"), "node_id", ids.storage_path(F.sha2("node_id", 256)).alias("storage_path"), F.lit("available").alias("state"))
    new = seen.unionByName(fresh).withColumn("at", F.lit(2).cast("long")).withColumn("created", F.lit(2).cast("long"))
    return writes.upsert(old, new, ["chunk_id", "node_id"], "at", ("created",))


@on_catalog
def insert_if_absent_chunks(c):
    held = c.chunks.filter(F.substring("chunk_id", 1, 1) < "8")
    return writes.insert_if_absent(held, c.chunks.filter(F.substring("chunk_id", 1, 1) > "5"), ["chunk_id"])


@on_catalog
def insert_conflicts(c):
    wrong = c.chunks.withColumn("size_bytes", F.col("size_bytes") + (F.substring("chunk_id", 1, 2) == "ab").cast("long"))
    return writes.conflicts(c.chunks, wrong, ["chunk_id"], ["size_bytes"])


@on_catalog
def version_transitions(c):
    """Staging versions without a protection are committed."""
    return writes.transition(c.versions.select("version_id", "state"), c.versions.join(c.protected, "version_id", "left_anti"), "version_id", "staging", "committed")


@query
def run_times(spark, sf_dir):
    """Runs made from orders: times in milliseconds and back, open ones null."""
    o = table(spark, sf_dir, "orders")
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 1000
    at = F.timestamp_micros(start)
    done = F.when(F.col("o_orderstatus") != "O", F.timestamp_micros(start + 1_500_499))
    return o.select("o_orderkey", ids.epoch_millis(at).alias("started_ms"), ids.epoch_millis(done).alias("completed_ms"))


@query
def throughput_median(spark, sf_dir):
    """Median of the samples of each event type, taken as seconds for 64 MiB."""
    e = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("seconds"), F.lit(64 << 20).cast("long").alias("bytes"))
    return dedup.throughput(e, "event_type")


@query
def event_windows(spark, sf_dir):
    """Events per hour and type: the batch form of the streaming aggregate."""
    from cairn.streaming.streams import hourly

    return hourly(table(spark, sf_dir, "events"))


# Lookups and guards.


@on_catalog
def layouts_of_objects(c):
    """Layouts of the object of document 3, found by key."""
    wanted = c.docs.filter("doc_id = 3").select("object_id")
    return c.layouts.join(wanted, "object_id", "left_semi").select("object_id", "layout_id", "chunk_count").orderBy("layout_id")


@on_catalog
def node_lookup(c):
    return get("storage_nodes", c.nodes, TARGET)


@on_catalog
def point_lookups(c):
    """The row of the smallest key of each table, found by that key."""
    tables = {
        "chunks": c.chunks, "objects": c.objects, "object_layouts": c.layouts, "object_layout_chunks": c.layout_chunks, "artifact_versions": c.versions, "storage_locations": c.locations, "tags": c.tags,
        "manifest_entries": c.manifest_entries, "upload_sessions": c.sessions, "upload_session_finalizations": c.finalizations, "artifact_version_retirements": c.retirements, "artifact_version_pins": c.pins, "storage_nodes": c.nodes,
    }
    out = None
    for name, rows in tables.items():
        key = rows.agg(F.min(F.struct(*KEYS[name])).alias("k")).first()["k"]
        found = get(name, rows, *(key or [None] * len(KEYS[name])))
        one = found.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.min(F.concat_ws(":", *KEYS[name])).alias("key"))
        out = one if out is None else out.unionByName(one)
    return out


@on_catalog
def chunk_locations(c):
    """Locations of the smallest chunk id, by node."""
    return locations_of(c.locations, c.chunks.agg(F.min("chunk_id")).first()[0]).select("chunk_id", "node_id", "state")


@on_catalog
def nodes_in_order(c):
    return all_nodes(c.nodes)


@on_catalog
def layout_chunk_sizes(c):
    """Layout chunks with the stored size of the chunk."""
    return c.layout_chunks.join(c.chunks, "chunk_id").select("layout_id", "chunk_index", "chunk_id", "size_bytes")


@on_catalog
def endpoint_union(c):
    """Source and target endpoints of repairs, each node once."""
    sources = av.readable(c.locations, c.nodes).select("node_id", "address", "port")
    targets = c.nodes.filter("state = 'active'").select("node_id", "address", "port")
    return sources.unionByName(targets).dropDuplicates(["node_id"])


@on_catalog
def unready_placements(c):
    """Placement sets over all nodes; those that aren't active are reported."""
    sets = c.sessions.filter("state = 'open'").select("session_id").join(F.broadcast(c.node_ids)).select("session_id", F.col("node_ids").alias("nodes"))
    return validate.unready_nodes(sets, c.nodes)


@query
def session_identity(spark, sf_dir):
    """Orders taken as requests, against the same with some fields changed or null."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("b"))
    again = o.select("o_orderkey", "a", F.when(F.col("o_orderkey") % 5 != 0, F.col("b")).alias("b"))
    return o.alias("l").join(again.alias("r"), "o_orderkey").select("o_orderkey", validators.same_session("l", "r", ("a", "b")).alias("same"))


@query
def counter_checks(spark, sf_dir):
    """Rows of lineitem taken as counters; negative ones fail."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    ok = validators.counters_ok(F.col("l_quantity") - 3, F.col("l_extendedprice"))
    return l.groupBy("l_returnflag").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


@on_catalog
def start_outcomes(c):
    """What keeps each kind of run from starting."""
    none = c.sessions.limit(0).select("state")
    guards = writes.busy(c.sessions, none, none)
    out = None
    for kind in ("gc", "replication", "lifecycle"):
        one = writes.start_outcome(guards, kind).select(F.lit(kind).alias("kind"), "outcome")
        out = one if out is None else out.unionByName(one)
    return out
