"""The pipeline against a plain version on a small corpus."""

import random

import corpus_pipeline
import pytest
from test_operators import DDL, prose

from cairn.llm import decontamination, jaccard_join, sharding


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("pipeline"))
    item = prose(900, 14)
    rows = [(k, prose(k, 90), "en", f"s{k % 4}", 1) for k in range(60)]
    rows += [(100 + k, prose(k, 90), "en", "s1", 1) for k in range(5)]  # exact copies
    rows += [(110, prose(6, 90) + " and a bit", "en", "s1", 1), (120, None, None, None, None), (121, "12 34 !!", "en", "s2", 1)]
    rows += [(130, prose(901, 60) + " " + item + " " + prose(902, 60), "en", "s0", 1), (131, item, "en", "s0", 1)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, DDL).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, item


def test_stages(spark, folder):
    at, rows, item = folder
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        seen[name] = docs.collect()
    texts = {r[0]: r[1] for r in rows}
    known = {d for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    assert {r.doc_id for r in seen["language_id"]} == known
    classes = jaccard_join.brute_force([(d, texts[d]) for d in sorted(known)])
    stay = {d for d, c, _ in classes if d == c}
    assert {r.doc_id for r in seen["ngram_jaccard_join"]} == stay
    clean = {r.doc_id: r.text for r in seen["benchmark_decontamination"]}
    assert set(clean) == stay - {131} and item not in clean[130] and all(clean[d] == texts[d] for d in clean if d != 130)
    assert not any(r[5] for r in decontamination.brute_force(clean.items(), [(1, item)]))
    mixed = seen["source_mixing"]
    assert {r.doc_id for r in mixed} <= set(clean) and max(sum(r.doc_id == d for r in mixed) for d in clean) <= 3
    assert len(seen["sharding"]) == len(mixed)
    for s in range(sharding.N_SHARDS):
        assert sorted(r.slot for r in seen["sharding"] if r.shard == s) == list(range(sum(r.shard == s for r in seen["sharding"])))


def test_run_agrees_with_itself(spark, folder):
    at, _, _ = folder
    assert sorted(map(tuple, corpus_pipeline.run(spark, at).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, at).collect()))


def test_odd_tables(spark, tmp_path):
    """An empty table, nulls in every column, and extra columns with the names that operators use."""
    from test_operators import EDGES, odd

    at = str(tmp_path)
    spark.createDataFrame([(1, prose(5, 30)), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    for name, rows in (("edges", EDGES), ("none", [])):
        docs = odd(spark.createDataFrame(rows, DDL))
        columns = docs.columns
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, at)
            if stage_name != "sharding":
                assert out.columns == columns
            out.write.parquet(f"{at}/{name}-{stage_name}")
            docs = spark.read.parquet(f"{at}/{name}-{stage_name}")
        ids = {r.doc_id for r in docs.collect()}
        assert (ids == set()) if not rows else (ids <= {3, 4, 8, 9, None} and ids)
