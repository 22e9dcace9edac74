"""Chunk stores and policy files.

A store directory is ``chunks/<2 hex>/<64 hex>``.  Reading goes through Spark's
``binaryFile`` source, so any file system that Spark reads will do.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import constants as K
from cairn.functions.validators import content_id_ok, policy_name_ok, rule_ok

_PLACE = r"/chunks/([0-9a-f]{2})/([0-9a-f]{64})$"


def _files(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/chunks")
    files = files.withColumn("fan", F.regexp_extract("path", _PLACE, 1)).withColumn("chunk_id", F.regexp_extract("path", _PLACE, 2))
    return files.filter((F.col("chunk_id") != "") & F.col("chunk_id").startswith(F.col("fan")))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Artifact files as objects: path, content, object_id, total_size_bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.sha2("content", 256).alias("object_id"), F.col("length").alias("total_size_bytes"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """chunk_id and size of each canonical file, by id; temporary, misnamed and misplaced files are not listed."""
    return _files(spark, root).select("chunk_id", F.col("length").alias("size_bytes")).orderBy("chunk_id")


def read_chunks(spark: SparkSession, root: str, wanted: DataFrame | None = None) -> DataFrame:
    """chunk_id and content; a file whose bytes don't hash to its name raises when it is read."""
    found = _files(spark, root).select("chunk_id", "content")
    if wanted is not None:
        found = found.join(wanted.select("chunk_id"), "chunk_id", "left_semi")
    sound = F.when(F.sha2("content", 256) == F.col("chunk_id"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("corrupt chunk "), "chunk_id")).cast("binary"))
    return found.select("chunk_id", sound.alias("content"))


def write_chunks(chunks: DataFrame, root: str) -> int:
    """Writes chunks (chunk_id, content) that the store lacks, after checking their hash; how many it wrote.

    Each file is written beside its place and renamed, so a lost task leaves no
    partial chunk.  ``root`` must be a folder that all executors share.
    """
    spark = chunks.sparkSession
    fresh = chunks.filter(content_id_ok(F.col("chunk_id"))).dropDuplicates(["chunk_id"])
    if os.path.isdir(f"{root}/chunks"):
        fresh = fresh.join(inventory(spark, root).select("chunk_id"), "chunk_id", "left_anti")
    checked = fresh.select("chunk_id", F.when(F.sha2("content", 256) == F.col("chunk_id"), F.col("content")).otherwise(F.raise_error(F.lit("content does not match its id")).cast("binary")).alias("content"))

    def put(rows):
        import os as o
        import uuid

        n = 0
        for row in rows:
            folder = f"{root}/chunks/{row.chunk_id[:2]}"
            o.makedirs(folder, exist_ok=True)
            draft = f"{folder}/.{row.chunk_id}.{uuid.uuid4().hex}.tmp"
            with open(draft, "wb") as f:
                f.write(row.content)
                f.flush()
                o.fsync(f.fileno())
            o.replace(draft, f"{folder}/{row.chunk_id}")
            n += 1
        yield n

    return checked.rdd.mapPartitions(put).sum()


def delete_chunks(chunk_ids: DataFrame, root: str) -> int:
    """Deletes the files of some chunks (chunk_id); how many there were.

    An id without a file counts as none; a link in the place of a file raises.  A
    task that runs again finds the files gone, so take the plan's rows for a
    report, not this number.
    """

    def drop(rows):
        import os as o

        n = 0
        for row in rows:
            place = f"{root}/chunks/{row.chunk_id[:2]}/{row.chunk_id}"
            if o.path.islink(place):
                raise OSError(f"{place} is a link")
            if o.path.isfile(place):
                o.remove(place)
                n += 1
        yield n

    return chunk_ids.filter(content_id_ok(F.col("chunk_id"))).select("chunk_id").distinct().rdd.mapPartitions(drop).sum()


def write_store(chunks: DataFrame, path: str) -> None:
    """The store as Parquet, a folder for each pair of leading hex digits, so lookups prune."""
    chunks.withColumn("p2", F.substring("chunk_id", 1, 2)).write.mode("append").partitionBy("p2").parquet(path)


def read_store(spark: SparkSession, path: str, chunk_id: str | None = None) -> DataFrame:
    found = spark.read.parquet(path)
    return found.filter((F.col("p2") == chunk_id[:2]) & (F.col("chunk_id") == chunk_id)) if chunk_id else found


def contains(wanted: DataFrame, held: DataFrame) -> DataFrame:
    return wanted.join(held.select("chunk_id"), "chunk_id", "left_semi")


def removed(held: DataFrame, gone: DataFrame) -> DataFrame:
    """The inventory without some chunks; ids it doesn't hold change nothing."""
    return held.join(gone.select("chunk_id"), "chunk_id", "left_anti")


RULE = "artifact_kind string, keep_last_n long, max_age_seconds long"


def _is(json: Column, key: str, *types: str) -> Column:
    """Whether a key of a JSON object has a value of one of the types."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{key}", "variant"))
    return F.coalesce(kind.isin(*types), F.lit(False))


def parse_policies(texts: DataFrame, column: str = "json") -> DataFrame:
    """``texts`` with name, rules and valid of a policy in JSON.

    A policy has a name and five rules, one for each kind, each with exactly the
    keys artifact_kind, keep_last_n and max_age_seconds, within bounds.  Names are
    JSON strings and numbers JSON integers: a value of another type isn't read as
    one, so a mistyped age never becomes no age limit.
    """
    parsed = F.from_json(F.col(column), f"name string, rules array<struct<{RULE}>>")
    raw_rules = F.from_json(F.get_json_object(column, "$.rules"), "array<string>")
    keys = F.array(*[F.lit(k) for k in ("artifact_kind", "keep_last_n", "max_age_seconds")])
    exact = F.forall(raw_rules, lambda r: F.array_sort(F.json_object_keys(r)) == keys)
    typed = F.forall(raw_rules, lambda r: _is(r, "artifact_kind", "STRING") & _is(r, "keep_last_n", "BIGINT") & _is(r, "max_age_seconds", "BIGINT", "VOID")) & _is(F.col(column), "name", "STRING")
    out = texts.withColumn("_p", parsed).withColumn("name", F.col("_p.name")).withColumn("rules", F.col("_p.rules")).drop("_p")
    kinds = F.array_distinct(F.transform("rules", lambda r: r["artifact_kind"]))
    sound = F.forall("rules", lambda r: rule_ok(r["artifact_kind"], r["keep_last_n"], r["max_age_seconds"]))
    valid = typed & (F.size("rules") == len(K.KINDS)) & (F.size(kinds) == len(K.KINDS)) & sound & exact & policy_name_ok(F.col("name"))
    return out.withColumn("valid", F.coalesce(valid, F.lit(False)))


def to_json(df: DataFrame) -> DataFrame:
    """One JSON object per row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
