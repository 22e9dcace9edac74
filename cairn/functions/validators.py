"""Predicates on single rows, as boolean Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

# ``\z``: a ``$`` would let a line break follow.
CONTENT_ID = r"^[0-9a-f]{64}\z"
NODE_ID = r"^[A-Za-z0-9._-]{1,128}\z"
UUID_V7 = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}\z"
_H = "[0-9A-Fa-f]{1,4}"
_V4 = rf"{_OCTET}(\.{_OCTET}){{3}}"


def _groups(n: int) -> list[str]:
    """Forms of ``n`` groups, one stretch of which may be left out."""
    return [rf"({_H}:){{{n - 1}}}{_H}", rf"({_H}:){{1,{n - 1}}}:", *[rf"({_H}:){{1,{n - 1 - k}}}(:{_H}){{1,{k}}}" for k in range(1, n - 1)], rf":(:{_H}){{1,{n - 1}}}", "::"]


#: The last two groups may be written as an IPv4 address, and a zone may follow.
_MIXED = [rf"({_H}:){{6}}{_V4}", rf"({_H}:){{1,5}}:{_V4}", *[rf"({_H}:){{1,{5 - k}}}(:{_H}){{1,{k}}}:{_V4}" for k in range(1, 5)], rf":(:{_H}){{1,5}}:{_V4}", rf"::{_V4}"]
IPV6 = "^(" + "|".join(_groups(8) + _MIXED) + ")(%[A-Za-z0-9._~-]+)?\\z"


def content_id_ok(c: Column) -> Column:
    return c.rlike(CONTENT_ID)


def node_id_ok(c: Column) -> Column:
    return c.rlike(NODE_ID)


def uuid_v7_ok(c: Column) -> Column:
    return c.rlike(UUID_V7)


def address_ok(address: Column, port: Column) -> Column:
    return (address.rlike(IPV4) | address.rlike(IPV6)) & port.between(1, 65535)


def cdc_parameters_ok(low: Column, avg: Column, high: Column) -> Column:
    power = avg.bitwiseAND(avg - 1) == 0
    return (low >= K.MIN_CDC_SIZE) & (avg >= K.MIN_CDC_SIZE) & power & (low <= avg) & (avg <= high) & (high <= K.MAX_CHUNK_SIZE)


def strategy_ok(strategy: Column, chunk_size: Column, low: Column, avg: Column, high: Column) -> Column:
    """Each strategy has its own parameters and none of the other's."""
    none = low.isNull() & avg.isNull() & high.isNull()
    fixed = (strategy == K.FIXED_SIZE) & chunk_size.isNotNull() & (chunk_size > 0) & none
    cdc = (strategy == K.FASTCDC) & chunk_size.isNull() & F.coalesce(cdc_parameters_ok(low, avg, high), F.lit(False))
    return F.coalesce(fixed | cdc, F.lit(False))


def session_state_ok(state: Column, finalized: Column) -> Column:
    """A finalized version is set if and only if the session is committed."""
    return state.isin("open", "committed", "aborted") & ((state == "committed") == finalized.isNotNull())


def placement_ok(nodes: Column, replicas: Column, target: Column) -> Column:
    n = F.size(nodes)
    ascending = (F.array_sort(nodes) == nodes) & (F.size(F.array_distinct(nodes)) == n)
    return n.between(1, K.MAX_PLACEMENT_NODES) & ascending & replicas.between(1, K.MAX_REPLICATION_FACTOR) & (replicas <= n) & (F.get(nodes, F.lit(0)) == target)


def rule_ok(kind: Column, keep_last_n: Column, max_age_seconds: Column) -> Column:
    return kind.isin(*K.KINDS) & keep_last_n.between(0, K.MAX_KEEP_LAST_N) & (max_age_seconds.isNull() | max_age_seconds.between(0, K.MAX_AGE_SECONDS))


def policy_name_ok(name: Column) -> Column:
    return F.octet_length(name).between(1, K.MAX_POLICY_NAME_BYTES)


def counters_ok(*counters: Column) -> Column:
    out = F.lit(True)
    for c in counters:
        out = out & (c >= 0)
    return out


#: Columns that make two upload sessions the same request.
SESSION_IDENTITY = (
    "artifact_id", "target_node_id", "replication_factor", "chunking_strategy", "chunk_size_bytes",
    "fastcdc_min_chunk_size_bytes", "fastcdc_avg_chunk_size_bytes", "fastcdc_max_chunk_size_bytes", "parent_version_id", "nodes",
)


def same_session(left: str, right: str, columns=SESSION_IDENTITY) -> Column:
    """Whether the rows under two aliases agree in all of ``columns``; nulls equal each other."""
    side = lambda alias: F.struct(*[F.col(f"{alias}.{c}") for c in columns])
    return side(left).eqNullSafe(side(right))
