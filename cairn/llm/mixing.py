"""Mixing sources to target weights.

Words per source are aggregated, a repetition rate is derived for each source,
and every document is emitted ``floor(rate)`` times plus one Bernoulli copy with
the fraction as its probability.  The coin is a hash of a seed and the doc_id,
so reruns and retried tasks agree.

Defined cases: a null or empty text has size 0 and takes 0 words; null sources
form one source of their own, ordered last; rows that repeat a doc_id share one
coin; an empty table gives an empty result; a source of size 0 has target 0;
extra columns pass through, and a column with the name of one this operator
adds is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count

#: Weights by the rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MAX_RATE = 3
SEED = "mix-1"
#: Up to so many sources the rates are broadcast; beyond it the join is shuffled.
BROADCAST_SOURCES = 10_000


def source_rates(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    Targets share the total by weight, but none goes over ``max_rate`` times its
    source's size; what is cut off is shared again by weight.  That fixed point
    is found without a loop: sources fill up in the order of size/weight, so the
    cut ones are a prefix of that order.
    The windows run over one row per source, never over documents.
    """
    per = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(max_rate)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        ranked.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.sum("_w").over(rest))
        .withColumn("_open", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level")))
        .withColumn("_fill", F.first("_open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.when(F.col("_fill").isNull(), F.col("_cap")).otherwise(F.least(F.col("_fill") * F.col("_w"), F.col("_cap")))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(max_rate)))).otherwise(F.lit(0.0))
    return level.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def coin(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) from the seed and the id, the same in any SQL engine."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan_mix(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies; one row per input row.

    Only (source, size) is aggregated.  The rates reach the documents by a
    broadcast if there are at most ``BROADCAST_SOURCES`` of them (they are
    counted), else by a join that adaptive execution splits where a source is
    hot.
    """
    added = [c for c in ("size", "source_size", "target", "rate", "copies") if c in docs.columns]
    sized = docs.drop(*added).withColumn("size", word_count("text"))
    rates = source_rates(sized.select("source", "size"), weights, max_rate)
    few = sized.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = rates.withColumnRenamed("source", "_source")
    joined = sized.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor("rate")
    extra = (coin(F.col("doc_id"), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("copies", (whole + extra).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as its copies say."""
    planned = plan_mix(docs, weights, max_rate, seed)
    out = planned.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*docs.columns)


def op6_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, sum(sum(size)) OVER ()::DOUBLE AS total,
        row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, CASE r % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 3.0::DOUBLE AS cap FROM s),
lv AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT first(lev ORDER BY cap / w, r) FILTER (WHERE lev * w <= cap) AS fill FROM lv),
t AS (SELECT source, source_size, least(cap, w * fill) AS target FROM lv, f)
SELECT d.doc_id, d.size, t.source_size, t.target,
  (d.size * (floor(least(t.target / t.source_size, 3.0))
    + CASE WHEN ('0x' || substr(sha256(concat('mix-1:', coalesce(d.doc_id::VARCHAR, 'null'))), 1, 8))::BIGINT / 4294967296.0::DOUBLE
        < least(t.target / t.source_size, 3.0) - floor(least(t.target / t.source_size, 3.0)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
