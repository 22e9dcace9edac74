"""Retention policies: rank within a kind, decide by the first reason that applies, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import constants as K


def with_kind(versions: DataFrame, column: str = "kind") -> DataFrame:
    """Kind from the reserved metadata value: missing is generic, an unknown one raises."""
    bad = F.raise_error(F.lit("invalid artifact kind value"))
    kind = F.when(F.col(column).isNull(), K.DEFAULT_KIND).when(F.col(column).isin(*K.KINDS), F.col(column)).otherwise(bad)
    return versions.withColumn("artifact_kind", kind)


def candidates(versions: DataFrame, retirements: DataFrame, pins: DataFrame, tags: DataFrame, manifest_entries: DataFrame) -> DataFrame:
    """Committed versions not retired, with their protection flags."""
    out = versions.filter("state = 'committed'").join(retirements.select("version_id"), "version_id", "left_anti")
    for name, df in (("pinned", pins), ("tagged", tags), ("in_manifest", manifest_entries)):
        out = out.join(df.select("version_id").distinct().withColumn(name, F.lit(True)), "version_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def decide(found: DataFrame, rules: DataFrame, evaluated_us: int) -> DataFrame:
    """version_id, artifact_id, artifact_kind, rank_in_kind, decision, reason, logical_size_bytes.

    ``found`` has created_us (epoch microseconds).  The rank counts protected
    versions too; ages compare strictly.  A version whose kind has no rule, or more
    than one, raises: none is left out of a run.  What is broadcast has at most a
    row for each kind there is.
    """
    newest = Window.partitionBy("artifact_id", "artifact_kind").orderBy(F.col("created_us").desc(), F.col("version_id"))
    per = rules.filter(F.col("artifact_kind").isin(*K.KINDS)).groupBy("artifact_kind").agg(F.count(F.lit(1)).alias("_rules"), F.first("keep_last_n").alias("keep_last_n"), F.first("max_age_seconds").alias("max_age_seconds"))
    ranked = found.withColumn("rank_in_kind", F.row_number().over(newest).cast("long")).join(F.broadcast(per), "artifact_kind", "left")
    wrong = F.raise_error(F.concat(F.lit("not one rule for kind "), F.coalesce("artifact_kind", F.lit("null")))).cast("int")
    ranked = ranked.withColumn("keep_last_n", F.when(F.col("_rules") == 1, F.col("keep_last_n")).otherwise(wrong))
    young = F.coalesce((F.lit(evaluated_us) - F.col("created_us")) < F.col("max_age_seconds") * 1_000_000, F.lit(False))
    reason = (
        F.when(F.col("keep_last_n").isNull(), F.lit(None).cast("string")).when(F.col("pinned"), "pinned").when(F.col("tagged"), "tagged").when(F.col("in_manifest"), "manifest-referenced")
        .when(F.col("rank_in_kind") <= F.col("keep_last_n"), "keep-last-n").when(young, "age-not-reached").otherwise("policy-retire")
    )
    decided = ranked.withColumn("reason", reason).withColumn("decision", F.when(F.col("reason") == "policy-retire", "retire").otherwise("retain"))
    return decided.select("version_id", "artifact_id", "artifact_kind", "rank_in_kind", "decision", "reason", "logical_size_bytes")


def rule_problems(versions: DataFrame, rules: DataFrame) -> DataFrame:
    """artifact_kind, versions and rules of the kinds of versions that don't have exactly one rule."""
    held = rules.groupBy("artifact_kind").agg(F.count(F.lit(1)).alias("rules"))
    per = versions.groupBy("artifact_kind").agg(F.count(F.lit(1)).alias("versions")).join(held, "artifact_kind", "left").na.fill(0, ["rules"])
    return per.filter("rules <> 1")


def stats(decisions: DataFrame, mode: str = "dry-run") -> DataFrame:
    """Counts of a run; an applied run retires its candidates, a dry run none."""
    retire = F.col("decision") == "retire"
    size = F.coalesce(F.sum(F.when(retire, F.col("logical_size_bytes"))), F.lit(0))
    applied = F.lit(1 if mode == "apply" else 0)
    return decisions.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("reason").isin("pinned", "tagged", "manifest-referenced")).alias("protected"), F.count_if(F.col("reason").isin("keep-last-n", "age-not-reached")).alias("retained"),
        F.count_if(retire).alias("candidates"), size.alias("candidate_bytes"), (F.count_if(retire) * applied).alias("retired"), (size * applied).alias("retired_bytes"),
    )


def histogram(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("reason", "decision").agg(F.count(F.lit(1)).alias("n"), F.sum("logical_size_bytes").alias("bytes"))


def retire(retirements: DataFrame, decisions: DataFrame) -> DataFrame:
    """Retirements after an applied run."""
    fresh = decisions.filter("decision = 'retire'").select("version_id", "artifact_kind", "reason")
    return retirements.unionByName(fresh.join(retirements.select("version_id"), "version_id", "left_anti"))


def page_parameters(text: Column) -> Column:
    """valid, after and limit of a query string; both are optional, nothing else may stand there.

    A limit that is repeated counts as its last, a cursor may not be repeated.  An
    ampersand at the end is ignored.  Without ``valid`` both others are null.
    """
    pairs = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"&\z", ""), "&"))
    of = lambda key: F.transform(F.filter(pairs, lambda p: p.startswith(f"{key}=")), lambda p: F.substring_index(p, "=", -1))
    limits = F.transform(of("limit"), lambda n: n.try_cast("decimal(38,0)"))
    known = F.forall(pairs, lambda p: p.rlike(r"^(after=[0-9a-f]{64}|limit=[0-9]{1,38})\z"))
    valid = F.coalesce(known & (F.size(of("after")) <= 1) & F.forall(limits, lambda n: n.between(1, K.MAX_PAGE)), F.lit(False))
    return F.struct(valid.alias("valid"), F.when(valid, F.get(of("after"), F.lit(0))).alias("after"), F.when(valid, F.get(F.reverse(limits), F.lit(0)).cast("long")).alias("limit"))


def page(decisions: DataFrame, after: str | None, limit: int) -> DataFrame:
    """Keyset page by version_id, the cursor excluded."""
    if not 1 <= limit <= K.MAX_PAGE:
        raise ValueError("limit out of range")
    left = decisions.filter(F.col("version_id") > F.lit(after)) if after is not None else decisions
    return left.orderBy("version_id").limit(limit)


def next_after(rows: list, limit: int) -> str | None:
    """Cursor of the next page: set whenever the page is full, so an exact multiple ends with an empty page."""
    return rows[-1]["version_id"] if len(rows) == limit else None


def policy_report(policies: DataFrame, rules: DataFrame) -> DataFrame:
    """policy_id and whether it has a name in bounds and exactly one sound rule for each kind."""
    from cairn.functions.validators import policy_name_ok, rule_ok

    per = rules.groupBy("policy_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("artifact_kind").alias("kinds"), F.min(F.coalesce(rule_ok(F.col("artifact_kind"), F.col("keep_last_n"), F.col("max_age_seconds")), F.lit(False))).alias("sound"))
    ok = F.coalesce((F.col("n") == len(K.KINDS)) & (F.col("kinds") == len(K.KINDS)) & F.col("sound") & policy_name_ok(F.col("name")), F.lit(False))
    return policies.join(per, "policy_id", "left").select("policy_id", ok.alias("valid"))
