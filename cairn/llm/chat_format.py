r"""Chat formatting in budgeted windows, in DataFrame expressions only.

A conversation's turns are laid out in order.  Prefix sums of the turns' token
costs choose spans of whole turns that fill a budget; every window repeats the
system turn and a limited stretch of the turns before its span, and only
assistant turns of the span itself are under the loss mask, so each assistant
text is a target exactly once.

Template: ``<turn ROLE>TEXT</turn>`` and a newline per turn.  In roles and texts
``\`` becomes ``\b``, ``<`` becomes ``\l`` and ``>`` becomes ``\g``, so no text
can hold a marker and the original comes back exactly.

Defined cases: a null text or role is empty; equal turn numbers are ordered by
role and text and repeated rows stay repeated turns; null turn numbers come
first; a null conv_id is a conversation of its own; a turn over the budget
stands whole in a window of its own, flagged ``over_budget``; an empty table
gives an empty result.  Texts of any length are taken whole.  Only conv_id, turn,
role and text are read, so extra columns can't clash.

A conversation is atomic: its windows, and the digests asked for, are made from
its turns in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY_TOKENS = 256
HISTORY_TURNS = 4
#: Tokens of a turn's markers; also the least cost of a turn, which bounds the turns of a window.
TURN_OVERHEAD = 4
CLOSE = "</turn>\n"


def escape(c: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def byte_cost(text: Column) -> Column:
    """Token estimate: a token for every four bytes begun."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _long(x) -> Column:
    return F.lit(x).cast("long")


def _cuts(turns: Column, room: Column) -> Column:
    """First positions (from 0) of the spans: greedy fill of ``room`` by prefix sums.

    The array grows only where a span begins.
    """
    start = F.struct(_long(0).alias("from_sum"), F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("i"))

    def step(acc: Column, t: Column) -> Column:
        over = (t["upto"] - acc["from_sum"] > room) & (acc["i"] > F.element_at(acc["cuts"], -1))
        return F.struct(
            F.when(over, t["upto"] - t["cost"]).otherwise(acc["from_sum"]).alias("from_sum"),
            F.when(over, F.array_append(acc["cuts"], acc["i"])).otherwise(acc["cuts"]).alias("cuts"),
            (acc["i"] + 1).alias("i"),
        )

    return F.aggregate(turns, start, step, lambda acc: acc["cuts"])


def windows(
    conversations: DataFrame,
    budget: int = BUDGET,
    history_tokens: int = HISTORY_TOKENS,
    history_turns: int = HISTORY_TURNS,
    cost=byte_cost,
) -> DataFrame:
    """One row per window: conv_id, window, first_turn, n_turns, n_system, n_history, tokens, over_budget, formatted, loss_spans.

    ``loss_spans`` are (start, stop) in code points of ``formatted``, end
    exclusive.  ``n_system`` is 1 if a repeated system turn leads the window,
    ``n_history`` counts repeated turns after it.
    One shuffle, by conv_id.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    laid = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("raw"))

    costed = F.transform("raw", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"), (cost(t["text"]) + TURN_OVERHEAD).cast("long").alias("cost")))
    laid = laid.select("conv_id", costed.alias("turns"))
    # Prefix sums on the numbers alone, so that the fold copies no text.
    sums = F.aggregate(
        F.transform("turns", lambda t: t["cost"]),
        F.struct(_long(0).alias("s"), F.expr("cast(array() as array<bigint>)").alias("all")),
        lambda acc, c: F.struct((acc["s"] + c).alias("s"), F.array_append(acc["all"], acc["s"] + c).alias("all")),
        lambda acc: acc["all"],
    )
    laid = laid.withColumn("upto", sums)
    laid = laid.withColumn("system", F.get("turns", F.lit(0))["role"] == "system")
    laid = laid.withColumn("system_cost", F.when(F.col("system"), F.get("upto", F.lit(0))).otherwise(_long(0)))
    laid = laid.withColumn("room", F.greatest(_long(1), F.lit(budget) - F.col("system_cost") - history_tokens))
    numbers = F.transform("turns", lambda t, i: F.struct(t["cost"].alias("cost"), F.get(F.col("upto"), i).alias("upto")))
    laid = laid.withColumn("cuts", _cuts(numbers, F.col("room")))
    spans = laid.select("*", F.posexplode("cuts").alias("window", "first_turn"))
    spans = spans.withColumn("n_turns", F.coalesce(F.get("cuts", F.col("window") + 1), F.size("turns")) - F.col("first_turn"))
    before = F.get("upto", F.col("first_turn") - 1)
    fits = lambda k: (F.col("first_turn") - k >= F.when(F.col("system"), 1).otherwise(0)) & (before - F.coalesce(F.get(F.col("upto"), F.col("first_turn") - k - 1), _long(0)) <= history_tokens)
    history = F.size(F.filter(F.sequence(F.lit(1), F.lit(history_turns)), fits)) if history_turns else F.lit(0)
    spans = spans.withColumn("n_history", F.when(F.col("first_turn") > 0, history).otherwise(0))
    spans = spans.withColumn("n_system", F.when(F.col("system") & (F.col("first_turn") > 0), 1).otherwise(0))
    shown = F.concat(
        F.slice("turns", F.lit(1), F.col("n_system")),
        F.slice("turns", F.col("first_turn") - F.col("n_history") + 1, F.col("n_history") + F.col("n_turns")),
    )
    spans = spans.select("conv_id", "window", "first_turn", "n_turns", "n_system", "n_history", shown.alias("shown"), (F.size("turns") == 0).alias("_none"), F.col("room"))

    def piece(t: Column, i: Column) -> Column:
        head, body = F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">")), escape(t["text"])
        target = (t["role"] == "assistant") & (i >= F.col("n_system") + F.col("n_history"))
        return F.struct(F.concat(head, body, F.lit(CLOSE)).alias("s"), F.length(head).alias("head"), F.length(body).alias("body"), target.alias("target"), t["cost"].alias("cost"))

    spans = spans.withColumn("pieces", F.transform("shown", piece))
    sizes = F.transform("pieces", lambda p: F.struct((p["head"] + p["body"] + len(CLOSE)).alias("all"), p["head"].alias("head"), p["body"].alias("body"), p["target"].alias("target")))
    span_type = "cast(array() as array<struct<start:int,stop:int>>)"
    loss = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.expr(span_type).alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["all"]).alias("at"),
            F.when(p["target"], F.array_append(acc["spans"], F.struct((acc["at"] + p["head"]).alias("start"), (acc["at"] + p["head"] + p["body"]).alias("stop")))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    tokens = F.aggregate(F.transform("pieces", lambda p: p["cost"]), _long(0), lambda a, c: a + c)
    return spans.select(
        "conv_id", "window", "first_turn", "n_turns", "n_system", "n_history", tokens.alias("tokens"), (tokens > budget).alias("over_budget"),
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"), loss.alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and targets recovered from windows alone: conv_id, turns_text, n_turns, loss_text, formatted_chars."""
    bodies = F.slice(F.split("formatted", CLOSE, -1), F.col("n_system") + F.col("n_history") + 1, F.col("n_turns"))
    turn = lambda x: F.concat(unescape(F.substring_index(F.substr(x, F.lit(7)), ">", 1)), F.lit("\n"), unescape(F.substr(x, F.instr(x, ">") + 1)), F.lit("\n"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    per = formatted.select(
        "conv_id", "window", "n_turns", F.array_join(F.transform(bodies, turn), "").alias("turns_text"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").alias("chars")
    )
    ordered = per.groupBy("conv_id").agg(F.sum("n_turns").cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "turns_text", "loss_text"))).alias("w"))
    return ordered.select(
        "conv_id", "n_turns", F.array_join(F.transform("w", lambda x: x["turns_text"]), "").alias("turns_text"), F.array_join(F.transform("w", lambda x: x["loss_text"]), "").alias("loss_text"), "formatted_chars"
    )


def op4_chat_formatting(spark, sf_dir):
    told = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(planted).alias("text"))
    back = read_back(windows(told.unionByName(extra)))
    return back.select(
        "conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars"
    )


OP4_SQL = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
        (strlen(text) + 3) // 4 + 4 AS cost FROM c),
p AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS upto,
        first_value(CASE WHEN role = 'system' THEN cost ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS sys,
        length(role) + length(text) + 15 + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars FROM o),
s AS (SELECT conv_id, i, i AS first_turn, (upto - cost)::BIGINT AS from_sum FROM p WHERE i = 0
  UNION ALL SELECT p.conv_id, p.i, CASE WHEN p.upto - s.from_sum > greatest(1, 768 - p.sys) THEN p.i ELSE s.first_turn END,
    CASE WHEN p.upto - s.from_sum > greatest(1, 768 - p.sys) THEN p.upto - p.cost ELSE s.from_sum END
  FROM s JOIN p ON p.conv_id = s.conv_id AND p.i = s.i + 1),
f AS (SELECT DISTINCT conv_id, first_turn, from_sum FROM s WHERE first_turn > 0),
again AS (SELECT f.conv_id, sum(p.chars) AS chars FROM f JOIN p ON p.conv_id = f.conv_id AND p.i < f.first_turn
    AND ((p.i = 0 AND p.sys > 0) OR (p.i >= f.first_turn - 4 AND f.from_sum - (p.upto - p.cost) <= 256)) GROUP BY f.conv_id)
SELECT p.conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(p.chars) + coalesce(any_value(again.chars), 0))::BIGINT AS formatted_chars
FROM p LEFT JOIN again ON again.conv_id = p.conv_id GROUP BY p.conv_id
"""
