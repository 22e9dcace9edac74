"""A catalog derived from the driver's tables, as far as queries need it.

Rows are made by deterministic expressions, so a second engine can make the same
ones.  Each attribute is built when it is first used and is never collected.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import constants as K
from cairn.functions import ids
from cairn.operators import chunking
from cairn.sources.shared import written

CHUNK_SIZE, SECOND_CHUNK_SIZE = 1024, 2048
CDC = (256, 1024, 4096)
REPLICAS = 2
EPOCH = 1704067200  # 2024-01-01T00:00:00Z
KIND_BY_LANG = {"en": "model-checkpoint", "fr": "dataset-snapshot", "de": "embedding-index"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def uuid_of(name: Column) -> Column:
    """A string in the form of a version 7 UUID, from a name."""
    m = F.md5(name.cast("binary"))
    part = lambda at, n: F.substring(m, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-7"), part(14, 3), F.lit("-8"), part(18, 3), F.lit("-"), part(21, 12))


_open: dict[tuple, "Catalog"] = {}


class Catalog:
    """Bytes are chunked and hashed where the texts are read, once; what is derived from them is kept as tables in the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Catalog":
        """The catalog of the files as they are; made once in an application."""
        files = hash(tuple(sorted(f for t in ("documents", "events", "labels", "benchmark", "region") for f in table(spark, sf_dir, t).inputFiles())))
        key = (spark.sparkContext.applicationId, sf_dir, files)
        if key not in _open:
            _open[key] = cls(spark, sf_dir)
        return _open[key]

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @property
    def texts(self) -> DataFrame:
        """object_id and content of each text."""
        content = ids.as_bytes(F.col("text"))
        return self.raw("documents").filter("text is not null").select(ids.sha256(content).alias("object_id"), content.alias("content"))

    @cached_property
    def docs(self) -> DataFrame:
        """doc_id, lang, source, object_id, bytes and fixed-size chunks of each text; the bytes go no further."""
        content, size = ids.as_bytes(F.col("text")), F.octet_length("text").cast("long")
        known = self.raw("documents").filter("text is not null").select("doc_id", "lang", "source", content.alias("content"), ids.sha256(content).alias("object_id"), size.alias("bytes"))
        second = (F.substring("object_id", 1, 1) < "4") & (F.col("bytes") > CHUNK_SIZE)
        chunked = known.select(
            "doc_id", "lang", "source", "object_id", "bytes", chunking.fixed_chunks(F.col("content"), CHUNK_SIZE).alias("chunks"),
            F.when(second, chunking.fixed_chunks(F.col("content"), SECOND_CHUNK_SIZE)).alias("second"),
        )
        return written(chunked, "catalog-docs")

    @cached_property
    def cdc(self) -> DataFrame:
        """object_id and content-defined chunks of each object."""
        return written(chunking.cdc_layouts(self.texts, *CDC).dropDuplicates(["object_id"]), "catalog-cdc")

    @cached_property
    def objects(self) -> DataFrame:
        return self.docs.select("object_id", F.col("bytes").alias("total_size_bytes")).distinct()

    @cached_property
    def layouts(self) -> DataFrame:
        """Layouts with their chunks: layout_id, object_id, chunk_size, total_size_bytes, chunk_count, chunks."""
        one = self.docs.dropDuplicates(["object_id"])
        laid = F.array(F.struct(F.lit(CHUNK_SIZE).alias("chunk_size"), "chunks"), F.struct(F.lit(SECOND_CHUNK_SIZE).alias("chunk_size"), F.col("second").alias("chunks")))
        laid = one.select("object_id", F.col("bytes").alias("total_size_bytes"), F.explode(laid).alias("_l")).select("object_id", "total_size_bytes", "_l.*").filter("chunks is not null")
        named = laid.select(ids.layout_id(F.col("object_id"), F.col("total_size_bytes"), F.col("chunks")).alias("layout_id"), "object_id", "chunk_size", "total_size_bytes", F.size("chunks").cast("long").alias("chunk_count"), "chunks")
        return written(named, "catalog-layouts")

    @cached_property
    def layout_chunks(self) -> DataFrame:
        return written(chunking.exploded(self.layouts, "layout_id", "object_id"), "catalog-layout-chunks")

    @cached_property
    def first_layout_chunks(self) -> DataFrame:
        """Chunks of the layout that every object has."""
        return chunking.exploded(self.layouts.filter(F.col("chunk_size") == CHUNK_SIZE), "layout_id", "object_id")

    @cached_property
    def chunks(self) -> DataFrame:
        return written(self.layout_chunks.select("chunk_id", F.col("chunk_size_bytes").alias("size_bytes")).distinct(), "catalog-chunks")

    @cached_property
    def nodes(self) -> DataFrame:
        k = F.col("r_regionkey")
        state = F.when(k == 3, "draining").when(k == 4, "disabled").otherwise("active")
        return self.raw("region").select(F.concat(F.lit("node-"), k).alias("node_id"), F.concat(F.lit("10.0.0."), k + 1).alias("address"), (k + 7000).cast("int").alias("port"), state.alias("state"))

    @cached_property
    def node_ids(self) -> DataFrame:
        """One row: the sorted node ids.  A registry is limited to a few dozen nodes."""
        return self.nodes.agg(F.sort_array(F.collect_list("node_id")).alias("node_ids"))

    @cached_property
    def desired(self) -> DataFrame:
        """chunk_id, size_bytes and a node on which the chunk belongs, RF rows per chunk."""
        return written(self.chunks.join(F.broadcast(self.node_ids)).select("chunk_id", "size_bytes", F.explode(ids.replica_nodes(F.col("chunk_id"), F.col("node_ids"), REPLICAS)).alias("node_id")), "catalog-desired")

    @cached_property
    def placed(self) -> DataFrame:
        """``desired`` with the state of the location there."""
        digit = F.substring(F.sha2(F.concat("chunk_id", "node_id"), 256), 1, 1)
        state = F.when(digit == "0", "missing").when(digit == "1", "corrupt").otherwise("available")
        return self.desired.withColumn("state", state)

    @cached_property
    def locations(self) -> DataFrame:
        return self.placed.select("chunk_id", "node_id", ids.storage_path(F.col("chunk_id")).alias("storage_path"), "state")

    @cached_property
    def inventory(self) -> DataFrame:
        """What nodes physically hold: node_id, chunk_id, size_bytes.  One stray chunk a node is unknown to the catalog."""
        held = self.placed.filter("state <> 'missing'").select("node_id", "chunk_id", "size_bytes")
        return held.unionByName(self.nodes.select("node_id", F.sha2(F.concat(F.lit("stray"), "node_id"), 256).alias("chunk_id"), F.lit(512).cast("long").alias("size_bytes")))

    @cached_property
    def version_docs(self) -> DataFrame:
        """Version of each document, with its kind (null: the key is missing)."""
        kind = F.when(F.col("doc_id") % 10 == 9, "evaluation-output")
        for lang, name in KIND_BY_LANG.items():
            kind = kind.when(F.col("lang") == lang, name)
        entries = F.array(F.struct(F.lit(K.KIND_KEY).alias("key"), F.col("kind").alias("value")), F.struct(F.lit("lang").alias("key"), F.coalesce("lang", F.lit("")).alias("value")))
        known = self.docs.select("doc_id", "object_id", "bytes", "source", "lang", uuid_of(F.coalesce("source", F.lit(""))).alias("artifact_id"), kind.alias("kind"))
        known = known.withColumn("metadata", F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())))
        return written(known.withColumn("version_id", ids.version_id(F.col("artifact_id"), F.col("object_id"), F.lit(None).cast("string"), F.col("metadata"))), "catalog-version-docs")

    @cached_property
    def versions(self) -> DataFrame:
        """version_id, artifact_id, root_object_id, kind, size, doc_no, state, created_s (epoch seconds)."""
        one = self.version_docs.groupBy("version_id").agg(F.first("artifact_id").alias("artifact_id"), F.first("object_id").alias("root_object_id"), F.first("kind").alias("kind"), F.first("bytes").alias("logical_size_bytes"), F.min("doc_id").alias("doc_no"))
        return one.withColumn("state", F.when(F.col("doc_no") % 11 == 0, "staging").otherwise("committed")).withColumn("created_s", (F.floor(F.col("doc_no") / 3) * 3600 + EPOCH).cast("long"))

    def _labelled(self, condition: str) -> DataFrame:
        return self.raw("labels").filter(condition).select("doc_id").join(self.version_docs.select("doc_id", "artifact_id", "version_id"), "doc_id")

    @cached_property
    def tags(self) -> DataFrame:
        return self._labelled("quality = 1 and doc_id % 2 = 0").select("artifact_id", F.concat(F.lit("q"), "doc_id").alias("tag_name"), "version_id")

    @cached_property
    def pins(self) -> DataFrame:
        return self._labelled("toxic = 1").select("version_id", F.lit("toxic").alias("reason")).distinct()

    @cached_property
    def manifest_entries(self) -> DataFrame:
        items = self.raw("benchmark").select((F.col("item_id") * 7).alias("doc_id"), F.concat(F.lit("role-"), F.col("item_id") % 3).alias("role"), F.floor(F.col("item_id") / 3).alias("manifest_no"))
        entries = items.join(self.version_docs.select("doc_id", "version_id"), "doc_id")
        ident = entries.groupBy("manifest_no").agg(ids.manifest_id(F.map_from_entries(F.collect_list(F.struct("role", "version_id")))).alias("manifest_id"))
        return entries.join(ident, "manifest_no").select("manifest_id", "role", "version_id")

    @cached_property
    def protected(self) -> DataFrame:
        return self.pins.select("version_id").union(self.tags.select("version_id")).union(self.manifest_entries.select("version_id")).distinct()

    @cached_property
    def retirements(self) -> DataFrame:
        return self.versions.filter("doc_no % 7 = 0").join(self.protected, "version_id", "left_anti").select("version_id", F.coalesce("kind", F.lit(K.DEFAULT_KIND)).alias("artifact_kind"), F.lit("policy-retire").alias("reason"))

    @cached_property
    def sessions(self) -> DataFrame:
        """Committed sessions of every fifth version, and one for each event: every thousandth open, the rest aborted."""
        done = self.versions.filter("doc_no % 5 = 0").select(uuid_of(F.concat(F.lit("s"), "doc_no")).alias("session_id"), "artifact_id", F.lit("committed").alias("state"), F.col("version_id").alias("finalized_version_id"))
        state = F.when(F.col("event_id") % 1000 == 0, "open").otherwise("aborted")
        other = self.raw("events").select(uuid_of(F.concat(F.lit("e"), "event_id")).alias("session_id"), uuid_of(F.lit("src0")).alias("artifact_id"), state.alias("state"), F.lit(None).cast("string").alias("finalized_version_id"))
        return done.unionByName(other)

    @cached_property
    def finalizations(self) -> DataFrame:
        of = self.layouts.filter(F.col("chunk_size") == CHUNK_SIZE).select("layout_id", F.col("object_id").alias("root_object_id"))
        done = self.versions.filter("doc_no % 5 = 0").select(uuid_of(F.concat(F.lit("s"), "doc_no")).alias("session_id"), "root_object_id")
        return done.join(of, "root_object_id").select("session_id", "layout_id")
