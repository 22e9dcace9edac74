"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per document.  The ledger keeps the measurements
and one long whose bit *i* says that rule *i* failed.  A policy is a versioned
set of rules: a document is kept under it if none of its bits is set, so a new
policy, or what each rule alone removes (the ablation), is bit arithmetic over
the ledger and never touches a text again.

Words are runs of characters other than space and tab..carriage return.

Defined cases: a null text has no words, lines or symbols, as has an empty one;
both fail ``too_few_words``.  Repeated rows are judged each for itself.  Extra
columns pass through ``ledger``; one with the name of a measurement is replaced.
Repeated word windows are found in n log n steps, so very long texts cost little
more per word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rule name -> SQL condition of failure over the measurements.  The position is the bit.
RULES = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "short_words": "n_words > 0 AND word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "duplicate_lines": "n_lines > 0 AND 100 * n_dup_lines > 30 * n_lines",
}
BASE = ("too_few_words", "repeated_windows")
#: Policy version -> the rules it holds documents to.
POLICIES = {"v1": BASE, "v2": (*BASE, "symbol_heavy", "short_words", "long_words", "duplicate_lines")}
CURRENT = "v2"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


#: Low bits of a packed window that hold its start; a text has fewer words than that.
_START_BITS = 30


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at least twice, the first included.

    Windows are sorted as longs, hash above start.  Those that share the hash
    with a neighbour are few; they are sorted again by their words, so the
    result does not rest on the hash.
    """
    mask = (1 << _START_BITS) - 1

    def packed(ws: Column) -> Column:
        return F.transform(
            F.slice(ws, F.lit(1), F.size(ws) - 2),
            lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)).bitwiseAND(F.lit(~mask).cast("long")).bitwiseOR(i.cast("long")),
        )

    def near(p: Column, x: Column, k: Column) -> Column:
        return F.shiftright(x.bitwiseXOR(F.get(p, k)), _START_BITS) == 0

    def alike(p: Column) -> Column:
        """Starts of the windows that share their hash."""
        start = lambda xs: F.transform(xs, lambda x: x.bitwiseAND(F.lit(mask).cast("long")).cast("int"))
        first = F.filter(p, lambda x, k: near(p, x, k + 1))
        return _let(first, lambda f: F.when(F.size(f) > 0, start(F.array_union(f, F.filter(p, lambda x, k: near(p, x, k - 1))))).otherwise(start(f)))

    def texts(starts: Column, ws: Column) -> Column:
        return F.sort_array(F.transform(starts, lambda i: F.struct(F.get(ws, i).alias("a"), F.get(ws, i + 1).alias("b"), F.get(ws, i + 2).alias("c"), i.alias("i"))))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))

    def twice(g: Column) -> Column:
        return F.sort_array(F.transform(F.filter(g, lambda x, k: same(x, F.get(g, k - 1)) | same(x, F.get(g, k + 1))), lambda x: x["i"]))

    def covered(s: Column) -> Column:
        step = F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def count(ws: Column) -> Column:
        exact = lambda starts: F.when(F.size(starts) > 0, _let(texts(starts, ws), lambda g: _let(twice(g), covered))).otherwise(F.lit(0).cast("long"))
        return _let(F.sort_array(packed(ws)), lambda p: _let(alike(p), exact))

    return _let(words, lambda ws: F.when(F.size(ws) >= 4, count(ws)).otherwise(F.lit(0).cast("long")))


def measure(text: Column) -> Column:
    """All measurements of a text as one struct."""
    text = F.coalesce(text, F.lit(""))

    def of(ws: Column) -> Column:
        lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return _let(
            lines,
            lambda ls: F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(ws).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
            ),
        )

    return _let(F.array_remove(F.split(text, SPACE, -1), ""), of)


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``docs`` without the text, with the measurements and ``fail_bits``."""
    clash = [c for c in (*MEASURES, "fail_bits", "_m") if c in docs.columns]
    keep = [c for c in docs.columns if c not in (*clash, "text")]
    measured = docs.select(*keep, measure(F.col("text")).alias("_m")).select(*keep, "_m.*")
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("fail_bits", bits)


def policy_mask(names, rules: dict[str, str] = RULES) -> int:
    order = list(rules)
    return sum(1 << order.index(x) for x in names)


def kept(version: str = CURRENT, policies=POLICIES, rules: dict[str, str] = RULES) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policies[version], rules)).cast("long")) == 0


def ablations(book: DataFrame, policies=POLICIES, rules: dict[str, str] = RULES) -> DataFrame:
    """policy, rule, n_failed, n_only_this, n_kept, n_kept_without, from one pass over the ledger.

    The ledger is first counted by its bits, so what is shuffled is at most one
    row for each pattern of failed rules and task.
    """
    patterns = book.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    order, out = list(rules), None
    entries = [(v, r, policy_mask(names, rules), 1 << order.index(r)) for v, names in policies.items() for r in names]
    table = F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for v, r, m, b in entries])
    failed = F.col("fail_bits").bitwiseAND(F.col("p.mask"))
    out = patterns.select("fail_bits", "n", F.explode(table).alias("p")).withColumn("_f", failed)
    when = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0)))
    return out.groupBy("p.policy", "p.rule").agg(
        when(F.col("_f").bitwiseAND(F.col("p.bit")) != 0).alias("n_failed"),
        when(F.col("_f") == F.col("p.bit")).alias("n_only_this"),
        when(F.col("_f") == 0).alias("n_kept"),
        when((F.col("_f") == 0) | (F.col("_f") == F.col("p.bit"))).alias("n_kept_without"),
    )


def op3_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    book = ledger(docs)
    base = F.col("fail_bits").bitwiseAND(F.lit(policy_mask(BASE)).cast("long")) != 0
    return book.select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & kept()).alias("kept"), "fail_bits")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
u AS (SELECT k, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT k, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM u WINDOW p AS (PARTITION BY k ORDER BY i)),
t AS (SELECT k, i, count(*) OVER (PARTITION BY k, a, b, c) AS n FROM g WHERE c IS NOT NULL),
r AS (SELECT k, count(DISTINCT i + o)::BIGINT AS n_repeat_words FROM t, (VALUES (0), (1), (2)) v(o) WHERE n > 1 GROUP BY k),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN r USING (k)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END + CASE WHEN n_lines > 0 AND 100 * n_dup_lines > 30 * n_lines THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
