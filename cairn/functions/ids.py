"""Content identities as Column expressions; no Python runs on the executors.

Canonical bytes are built as hex text, because lengths and offsets are fixed-width
big-endian numbers, and hashed once.
"""

from __future__ import annotations

import secrets
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def as_bytes(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def sha256(binary: Column) -> Column:
    """Lowercase hex SHA-256 of bytes: the id of a chunk or of an object."""
    return F.sha2(binary, 256)


def u64(c: Column) -> Column:
    """Eight big-endian bytes as hex."""
    return F.lower(F.lpad(F.hex(c.cast("long")), 16, "0"))


def u32(n: int) -> str:
    return f"{n:08x}"


def text_hex(c: Column) -> Column:
    return F.lower(F.hex(as_bytes(c)))


def sized_text(c: Column) -> Column:
    """Byte length, then bytes."""
    return F.concat(u64(F.octet_length(c)), text_hex(c))


def _head(magic: str) -> Column:
    return F.lit(magic.encode().hex() + u32(K.DESCRIPTOR_VERSION))


def identity(canonical_hex: Column) -> Column:
    return F.sha2(F.unhex(canonical_hex), 256)


def layout_hex(object_id: Column, total: Column, chunks: Column, strategy: str = K.FIXED_SIZE, cdc: tuple[int, int, int] | None = None) -> Column:
    """``chunks``: array of structs chunk_id, byte_offset, chunk_size_bytes, in order."""
    bounds = [u64(F.lit(n)) for n in cdc or ()]
    listed = F.transform(chunks, lambda c: F.concat(c["chunk_id"], u64(c["byte_offset"]), u64(c["chunk_size_bytes"])))
    return F.concat(_head(K.LAYOUT_MAGIC), object_id, F.lit(K.STRATEGY_CODES[strategy]), *bounds, u64(total), u64(F.size(chunks)), F.array_join(listed, ""))


def _pairs_hex(m: Column) -> Column:
    """Number of pairs, then each key and value, by key in byte order."""
    return F.concat(u64(F.size(m)), F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(sized_text(e["key"]), sized_text(e["value"]))), ""))


def version_hex(artifact_id: Column, object_id: Column, parent: Column, metadata: Column) -> Column:
    parent_hex = F.coalesce(F.concat(F.lit("01"), parent), F.lit("00"))
    return F.concat(_head(K.VERSION_MAGIC), F.replace(artifact_id, F.lit("-"), F.lit("")), object_id, parent_hex, _pairs_hex(metadata))


def manifest_hex(entries: Column) -> Column:
    """``entries``: map from role to version id."""
    listed = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(sized_text(e["key"]), e["value"]))
    return F.concat(_head(K.MANIFEST_MAGIC), u64(F.size(entries)), F.array_join(listed, ""))


def layout_id(*args, **kwargs) -> Column:
    return identity(layout_hex(*args, **kwargs))


def version_id(*args) -> Column:
    return identity(version_hex(*args))


def manifest_id(entries: Column) -> Column:
    return identity(manifest_hex(entries))


def placement_digest(chunk_id: Column, node_id: Column) -> Column:
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(as_bytes(F.lit(K.PLACEMENT_MAGIC)), zero, as_bytes(chunk_id), zero, as_bytes(node_id)), 256)


def replica_nodes(chunk_id: Column, node_ids: Column, replicas: Column | int) -> Column:
    """The nodes a chunk belongs on: highest digest first, ties by node id."""
    ranked = F.transform(node_ids, lambda n: F.struct(placement_digest(chunk_id, n).alias("digest"), n.alias("node_id")))
    order = lambda a, b: F.when(a["digest"] > b["digest"], -1).when(a["digest"] < b["digest"], 1).when(a["node_id"] < b["node_id"], -1).when(a["node_id"] > b["node_id"], 1).otherwise(0)
    return F.transform(F.slice(F.array_sort(ranked, order), F.lit(1), F.lit(replicas) if isinstance(replicas, int) else replicas), lambda x: x["node_id"])


def storage_path(chunk_id: Column) -> Column:
    return F.concat_ws("/", F.lit("chunks"), F.substring(chunk_id, 1, 2), chunk_id)


def new_uuid_v7(millis: int | None = None) -> str:
    """A new UUID of version 7: 48 bits of milliseconds, 74 random bits.

    Made in the driver, one for a session or a run; never in a plan, where a task
    that runs again would make another.
    """
    millis = time.time_ns() // 1_000_000 if millis is None else millis
    if not 0 <= millis < 1 << 48:
        raise ValueError("milliseconds outside of 48 bits")
    low = 0x8 << 60 | secrets.randbits(62)
    digits = f"{millis << 16 | 0x7 << 12 | secrets.randbits(12):016x}{low:016x}"
    return "-".join((digits[:8], digits[8:12], digits[12:16], digits[16:20], digits[20:]))


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since the epoch, rounded half up; null stays null."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) + 500) / 1000).cast("long")


def human_bytes(n: Column) -> Column:
    """Bytes with one decimal in the largest unit of 1024 that fits."""
    out = F.format_string("%d B", n)
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return out


def safe_filename(name: Column) -> Column:
    """Letters, digits, dot, dash and underscore stay; runs of others become one underscore."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_")
