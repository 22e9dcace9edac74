"""Streams give what the batch form gives."""

import hashlib

import numpy as np

from pyspark.sql import functions as F

from cairn.operators import chunking
from cairn.streaming import streams


def drained(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def parts(spark, tmp_path, rows, ddl, n=3):
    for k in range(n):
        spark.createDataFrame(rows[k::n], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_chunks_once(spark, tmp_path):
    rows = [(bytes([k % 3]) * 10,) for k in range(9)]
    got = drained(streams.new_chunks(parts(spark, tmp_path, rows, "content binary"), 4), "chunks_once")
    batch = spark.createDataFrame(rows, "content binary").select(F.explode(chunking.fixed_chunks(F.col("content"), 4)).alias("c")).select("c.chunk_id").distinct()
    assert sorted(r.chunk_id for r in got.collect()) == sorted(r.chunk_id for r in batch.collect())


def test_hourly(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = drained(streams.hourly_stream(stream, "10000 days"), "hourly", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.hourly(events).collect()))


def test_fragments(spark, tmp_path):
    whole = {"a": bytes(range(200)), "b": b"q" * 64, "c": b""}
    rows = []
    for key, raw in whole.items():
        cuts = [0, 7, 90, len(raw)] if raw else [0, 0]
        rows += [(key, k, raw[x:y], k == len(cuts) - 2) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    for seq in range(3):  # one batch for each position
        spark.createDataFrame([r for r in rows if r[1] == seq], "object_key string, seq int, content binary, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("object_key string, seq int, content binary, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(streams.chunk_fragments(stream, 64), "fragments").collect()
    want = [(k, i // 64, i, len(raw[i : i + 64]), hashlib.sha256(raw[i : i + 64]).hexdigest()) for k, raw in whole.items() for i in range(0, len(raw), 64)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_content_defined_fragments(spark, tmp_path):
    """Fragments of any cut give the chunks of the whole object."""
    whole = {"a": np.random.default_rng(1).integers(0, 256, 30_000, dtype=np.uint8).tobytes(), "b": b"q" * 5000, "c": b"", "d": b"short"}
    rows = []
    for key, raw in whole.items():
        cuts = sorted({0, len(raw), *[min(len(raw), n) for n in (1, 90, 256, 4097, 4098, 20_000)]}) if raw else [0, 0]
        rows += [(key, k, raw[x:y], k == len(cuts) - 2) for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    ddl = "object_key string, seq int, content binary, last boolean"
    for seq in range(7):
        spark.createDataFrame([(a, b, bytearray(c), d) for a, b, c, d in rows if b == seq], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained(streams.chunk_fragments(stream, cdc=(64, 256, 1024)), "cdc_fragments").collect()
    want = []
    for key, raw in whole.items():
        at = 0
        for k, n in enumerate(chunking.cdc_reference(raw, 64, 256, 1024)):
            want.append((key, k, at, n, hashlib.sha256(raw[at : at + n]).hexdigest()))
            at += n
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 60


def test_batches_replace_themselves(spark, tmp_path):
    sink = streams.append_once(str(tmp_path / "out"))
    df = spark.range(3)
    sink(df, 0), sink(df, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
