"""Writes as new snapshots: merges, state changes, finalization.

Parquet tables aren't updated in place.  Each function returns the next snapshot,
to be written to a new directory; a pointer is published last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str, keep_old: tuple[str, ...] = ()) -> DataFrame:
    """Last writer wins per key, by ``newest``; columns in ``keep_old`` stay those of the first row."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), F.col(newest).desc())
    first = Window.partitionBy(*keys).orderBy("_new", newest).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = both
    for c in keep_old:
        out = out.withColumn(c, F.first(c).over(first))
    return out.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank", "_new")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def conflicts(old: DataFrame, new: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Keys present in both with another payload; must be empty for an insert-if-absent."""
    a, b = old.alias("a"), new.alias("b")
    differ = ~F.struct(*[F.col(f"a.{c}") for c in payload]).eqNullSafe(F.struct(*[F.col(f"b.{c}") for c in payload]))
    return a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]).filter(differ).select(*[F.col(f"a.{k}").alias(k) for k in keys]).distinct()


def insert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A plain insert; rows whose key exists, or comes twice, raise when the result is read."""
    marked = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    clash = F.col("_new").eqNullSafe(1) & (n > 1)
    return marked.withColumn("_new", F.when(clash, F.raise_error(F.lit("key exists")).cast("int")).otherwise(F.col("_new"))).filter("_new >= 0").drop("_new")


def transition(rows: DataFrame, changes: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """Rows whose key is in ``changes`` go from state ``source`` to ``target``; others stay."""
    marked = rows.join(changes.select(key).distinct().withColumn("_go", F.lit(True)), key, "left")
    return marked.withColumn("state", F.when(F.col("_go") & (F.col("state") == source), target).otherwise(F.col("state"))).drop("_go").select(*rows.columns)


def finalize_outcomes(sessions: DataFrame, submitted: DataFrame, chunks: DataFrame, missing_replicas: DataFrame, retirements: DataFrame) -> DataFrame:
    """session_id and the first reason a finalize is turned down for, or ``ok``.

    ``sessions``: session_id, state, version_id (that would be made), chunk_size, finalized_version_id;
    content-defined sessions have a null chunk_size, and their bounds in min_size and max_size.
    ``submitted``: session_id, chunk_index, chunk_id, chunk_size_bytes.
    ``missing_replicas``: session_id, chunk_id of desired replicas that aren't available.
    """
    order = Window.partitionBy("session_id").orderBy("chunk_index")
    last = F.lead("chunk_index").over(order).isNull()
    bound = lambda name: F.coalesce("chunk_size", name) if name in sessions.columns else F.col("chunk_size")
    sized = submitted.join(sessions.select("session_id", bound("min_size").alias("least"), bound("max_size").alias("most")), "session_id")
    n = F.col("chunk_size_bytes")
    bad_size = ~F.coalesce(F.when(last, (n > 0) & (n <= F.col("most"))).otherwise(n.between(F.col("least"), F.col("most"))), F.lit(False))
    sizes = sized.withColumn("_bad", bad_size).groupBy("session_id").agg(F.max("_bad").alias("bad_size"))
    same = submitted.groupBy("session_id", "chunk_id").agg((F.count_distinct("chunk_size_bytes") > 1).alias("c")).groupBy("session_id").agg(F.max("c").alias("twice"))
    known = submitted.join(chunks, "chunk_id", "left").groupBy("session_id").agg(F.max(F.coalesce(F.col("size_bytes") != F.col("chunk_size_bytes"), F.lit(True))).alias("unknown"))
    under = missing_replicas.select("session_id").distinct().withColumn("under", F.lit(True))
    gone = retirements.select("version_id").distinct().withColumn("gone", F.lit(True))
    s = sessions.join(sizes, "session_id", "left").join(same, "session_id", "left").join(known, "session_id", "left").join(under, "session_id", "left").join(gone, "version_id", "left")
    outcome = (
        F.when(F.col("state") == "aborted", "session-not-open").when(F.col("gone"), "version-retired")
        .when((F.col("state") == "committed") & ~F.col("finalized_version_id").eqNullSafe(F.col("version_id")), "retry-mismatch").when(F.col("state") == "committed", "ok")
        .when(F.col("bad_size"), "size-mismatch").when(F.col("twice"), "chunk-size-conflict").when(F.col("unknown"), "chunk-missing").when(F.col("under"), "under-replicated").otherwise("ok")
    )
    return s.select("session_id", outcome.alias("outcome"))


def finalized_versions(outcomes: DataFrame, sessions: DataFrame, versions: DataFrame) -> DataFrame:
    """Version rows that a finalize adds: those of sessions it lets through, once each, without versions that exist.

    ``sessions``: session_id, version_id and the columns of ``versions``.
    """
    passed = sessions.join(outcomes.filter("outcome = 'ok'").select("session_id"), "session_id", "left_semi")
    made = passed.select(*versions.columns).dropDuplicates(["version_id"])
    return made.join(versions.select("version_id"), "version_id", "left_anti")


def busy(sessions: DataFrame, gc_runs: DataFrame, replication_runs: DataFrame) -> DataFrame:
    """One row: whether an open session or run keeps others from starting."""
    out = None
    for name, df in (("open_sessions", sessions), ("open_gc", gc_runs), ("open_replication", replication_runs)):
        one = df.agg((F.count_if(F.col("state") == "open") > 0).alias(name))
        out = one if out is None else out.join(one)
    return out


def start_outcome(guards: DataFrame, kind: str) -> DataFrame:
    """The first guard that keeps a run of ``kind`` (gc, replication, lifecycle) from starting, or ``ok``."""
    order = {"gc": ("open_gc", "open_replication", "open_sessions"), "replication": ("open_gc", "open_replication"), "lifecycle": ("open_sessions", "open_gc", "open_replication")}[kind]
    out = F.lit("ok")
    for name in reversed(order):
        out = F.when(F.col(name), name.replace("_", "-")).otherwise(out)
    return guards.select(out.alias("outcome"))
