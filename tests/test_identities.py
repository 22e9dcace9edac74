"""Known values of identities, placement and chunk boundaries."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import ids, validators
from cairn.operators import chunking, lifecycle


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def chunks(*rows):
    return F.array(*[F.struct(F.lit(c).alias("chunk_id"), F.lit(o).cast("long").alias("byte_offset"), F.lit(s).cast("long").alias("chunk_size_bytes")) for c, o, s in rows])


@pytest.mark.parametrize("text, digest", [("", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"), ("abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")])
def test_sha256(spark, text, digest):
    assert value(spark, ids.sha256(ids.as_bytes(F.lit(text)))) == digest


def test_layout_ids(spark):
    fixed = ids.layout_id(F.lit("1" * 64), F.lit(4), chunks(("a" * 64, 0, 4)))
    assert value(spark, fixed) == "c369806353f848a91d93e88f63fc99ef190265ccd7eaba94187aa7d783786be8"
    cdc = ids.layout_id(F.lit("1" * 64), F.lit(128), chunks(("a" * 64, 0, 128)), "fastcdc", (64, 256, 1024))
    assert value(spark, cdc) == "8cfa747f1291b7491bb11e922b72a4c00103bc66473352f3004d573abb2d9ea2"


def test_version_and_manifest_ids(spark):
    metadata = F.create_map(F.lit("precision"), F.lit("bf16"), F.lit("framework"), F.lit("pytorch"))
    version = ids.version_id(F.lit("01890f3e-9c8a-7cc2-bc63-7f0c2e67a1d1"), F.lit("a" * 64), F.lit(None).cast("string"), metadata)
    assert value(spark, version) == "10c2ab368f0fc99e8926ec1bea038eb24f5e882e62e7d9547b27088d8236e868"
    manifest = ids.manifest_id(F.create_map(F.lit("model"), F.lit("a" * 64), F.lit("config"), F.lit("b" * 64)))
    assert value(spark, manifest) == "12adad980ddcf4a17a88a00d610e9cf823d1ec4f2c72a7362eea4060cd93c163"


@pytest.mark.parametrize("chunk, rf, nodes", [("a" * 64, 2, "C,A"), ("b" * 64, 2, "B,A"), ("c" * 64, 2, "C,A"), ("0123456789abcdef" * 4, 2, "A,B"), ("a" * 64, 3, "C,A,B")])
def test_placement(spark, chunk, rf, nodes):
    got = value(spark, ids.replica_nodes(F.lit(chunk), F.array(*[F.lit(f"node-{x}") for x in "ABC"]), rf))
    assert got == [f"node-{x}" for x in nodes.split(",")]


def test_cdc_known_boundaries():
    raw = bytes(i % 251 for i in range(4096))
    assert chunking.cdc_sizes(raw, 64, 128, 256) == [185, 163] + [251] * 14 + [234]
    assert chunking.cdc_sizes(b"\x5a" * 300, 64, 128, 256)[0] == 256
    assert chunking.cdc_sizes(b"", 64, 128, 256) == []


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 5000), st.sampled_from([(64, 64, 64), (64, 128, 256), (100, 128, 700), (64, 1024, 2048)]))
def test_cdc_equals_the_byte_rule(seed, n, parameters):
    raw = np.random.default_rng(seed).integers(0, 256, n).astype(np.uint8).tobytes()
    assert chunking.cdc_sizes(raw, *parameters) == chunking.cdc_reference(raw, *parameters)


def xorshift(n, seed):
    out, x = bytearray(), seed
    for _ in range(n):
        x ^= (x << 13) & (2**64 - 1)
        x ^= x >> 7
        x ^= (x << 17) & (2**64 - 1)
        out.append(x & 255)
    return bytes(out)


def test_cdc_survives_a_shift():
    base = xorshift(64 * 1024, 0xDEADBEEFCAFEBABE)
    shifted = b"shifted prefix" + base

    def shared(cut):
        pieces = lambda raw: {hashlib.sha256(raw[a:b]).digest(): b - a for a, b in cut(raw)}
        a, b = pieces(base), pieces(shifted)
        return sum(n for k, n in b.items() if k in a) / len(shifted)

    def cdc(raw):
        at = 0
        for n in chunking.cdc_sizes(raw, 256, 1024, 4096):
            yield at, at + n
            at += n

    fixed = lambda raw: ((k, min(k + 1024, len(raw))) for k in range(0, len(raw), 1024))
    assert shared(cdc) >= 0.4 and shared(cdc) > 2 * shared(fixed)


def test_fixed_chunks(spark):
    df = spark.createDataFrame([("a", b""), ("b", b"x" * 8), ("c", b"x" * 9)], "object_id string, content binary")
    got = {r.object_id: [(c.chunk_index, c.byte_offset, c.chunk_size_bytes) for c in r.chunks] for r in chunking.fixed_layouts(df, 4).collect()}
    assert got == {"a": [], "b": [(0, 0, 4), (1, 4, 4)], "c": [(0, 0, 4), (1, 4, 4), (2, 8, 1)]}
    with pytest.raises(ValueError):
        chunking.fixed_chunks(F.col("content"), 0)
    cdc = chunking.cdc_layouts(df, 64, 64, 64).collect()
    assert {r.object_id: len(r.chunks) for r in cdc} == {"a": 0, "b": 1, "c": 1}


@pytest.mark.parametrize("address, port, ok", [("10.0.0.1", 80, True), ("256.0.0.1", 80, False), ("::1", 1, True), ("fe80::1:2", 65535, True), ("1.2.3", 80, False), ("10.0.0.1", 0, False), ("a::b::c", 80, False), ("1:2:3:4:5:6:7:8", 9, True), ("::ffff:1.2.3.4", 80, True), ("1:2:3:4:5:6:7.8.9.10", 80, True), ("1:2:3:4:5:6:7:7.8.9.10", 80, False), ("fe80::1%eth0", 80, True), ("10.0.0.1%eth0", 80, False), ("1::2:3:1.2.3.4", 80, True), ("::256.1.1.1", 80, False), ("10.0.0.1\n", 80, False)])
def test_addresses(spark, address, port, ok):
    assert value(spark, validators.address_ok(F.lit(address), F.lit(port))) is ok


def test_strategy_and_session_rules(spark):
    none = F.lit(None).cast("long")
    n = lambda x: F.lit(x).cast("long")
    assert value(spark, validators.strategy_ok(F.lit("fixed-size"), n(4), none, none, none)) is True
    assert value(spark, validators.strategy_ok(F.lit("fixed-size"), n(4), n(64), none, none)) is False
    assert value(spark, validators.strategy_ok(F.lit("fastcdc"), none, n(64), n(128), n(256))) is True
    assert value(spark, validators.strategy_ok(F.lit("fastcdc"), none, n(64), n(100), n(256))) is False
    assert value(spark, validators.session_state_ok(F.lit("committed"), F.lit("v"))) is True
    assert value(spark, validators.session_state_ok(F.lit("open"), F.lit("v"))) is False
    assert value(spark, ids.human_bytes(n(1536))) == "1.5 KiB"
    assert value(spark, ids.safe_filename(F.lit("a b/c.bin"))) == "a_b_c.bin"


def test_new_uuids(spark):
    made = [ids.new_uuid_v7(k) for k in (0, 1, 1 << 40, (1 << 48) - 1)] + [ids.new_uuid_v7()]
    assert sorted(made[:4]) == made[:4] and all(value(spark, validators.uuid_v7_ok(F.lit(u))) for u in made)
    assert len({ids.new_uuid_v7(5) for _ in range(1000)}) == 1000
    for wrong in (-1, 1 << 48):
        with pytest.raises(ValueError, match="48 bits"):
            ids.new_uuid_v7(wrong)


@pytest.mark.parametrize("text, expected", [("", (True, None, None)), ("limit=7&limit=9&", (True, None, 9)), ("limit=0", (False, None, None)), ("limit=" + "9" * 40, (False, None, None)), ("&", (False, None, None)), ("limit=2&&", (False, None, None)), ("after=" + "a" * 64, (True, "a" * 64, None)), ("limit=2\n", (False, None, None)), (None, (False, None, None))])
def test_page_parameters(spark, text, expected):
    assert tuple(value(spark, lifecycle.page_parameters(F.lit(text).cast("string")))) == expected
