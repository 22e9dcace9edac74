"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle import assert_same, connect

from cairn.plans.oracle import oracle_sql
from cairn.plans.queries import REGISTRY

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, con, name):
    assert_same(REGISTRY[name](spark, small), con, SQL[name])


def test_all_but_the_chunker_have_sql():
    assert set(REGISTRY) - set(SQL) == {"fastcdc_chunks", "fastcdc_dedup"}


def test_content_defined_chunks_match_the_byte_rule(spark, small):
    from cairn.operators.chunking import cdc_reference
    from cairn.sources.catalog import CDC, Catalog

    contents = {r.object_id: bytes(r.content) for r in Catalog(spark, small).texts.collect()}
    sizes = {}
    for r in REGISTRY["fastcdc_chunks"](spark, small).orderBy("object_id", "chunk_index").collect():
        sizes.setdefault(r.object_id, []).append(r.chunk_size_bytes)
    assert sizes == {k: cdc_reference(v, *CDC) for k, v in contents.items() if v}
