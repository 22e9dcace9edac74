"""The corpus pipeline: five stages, each over all that its predecessor kept.

Every stage is a function of (spark, docs, sf_dir).  All but the last return the
columns of ``documents``.  A driver may write each result as Parquet and read it
again as the next stage's ``docs``; ``run`` does so in the shared folder.

1. language ID: documents without a recognisable language go.
2. n-gram Jaccard join: one document of each class of near copies stays.
3. benchmark decontamination: passages of the benchmark are cut out, documents
   that consist of them go.
4. mixing: documents are repeated towards the weights of their sources.
5. sharding: the mixed rows, copies as rows of their own, are put into shards.

Defined cases: null and empty texts and texts without a letter have no language and
go in stage 1; a null lang isn't learned, a null source is a source of its own; rows
without a doc_id stay (stages 2 to 4) and come first in stage 5; rows equal in doc_id
and text are one document after stage 2, rows that share a doc_id only are not; ties
go to the smaller doc_id; texts of any length are taken whole; an empty table gives
an empty result of the same columns; extra columns, whatever their names, pass
through the first four stages.
"""

from __future__ import annotations

from cairn.llm import decontamination, jaccard_join, language_id, mixing, sharding
from cairn.llm.common import load, written
from pyspark.sql import functions as F

#: Least share of the main language; half of the letters of a kept document are of it.
MIN_SCORE = 0.5


def language_stage(spark, docs, sf_dir):
    """Keeps documents whose main language is known and holds at least ``MIN_SCORE``.

    The model is learned from the rows this stage is given.
    """
    told = language_id.predict(docs, language_id.fit(docs))
    return told.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def near_copy_stage(spark, docs, sf_dir):
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def decontamination_stage(spark, docs, sf_dir):
    return decontamination.decontaminate(docs, load(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing_stage(spark, docs, sf_dir):
    return mixing.mix(docs)


def sharding_stage(spark, docs, sf_dir):
    """doc_id, size, text_crc32, shard, slot of every mixed row; copies share a shard."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_copy_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: No SQL for the first stages; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
