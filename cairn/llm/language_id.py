"""Language identification by multilingual mixture inference.

A model holds, for each language, the smoothed probabilities of hashed byte
trigrams of lower-cased words.  A document is a mixture: expectation-maximisation
finds the share of each language under which its trigrams are likeliest, and the
set of languages is the one whose likelihood, less a penalty for each language
and unit of log(trigrams), is highest; languages are taken away one at a time
while that pays.  The prediction is the language with the largest share, the
score is that share.

Training counts every labelled document, none is left out.  Each task sends one
row of ``BUCKETS`` counts per language it met, not its trigrams.

A model comes in blocks of at most ``BLOCK`` languages, 32 MB each.  One block is one
pass over the documents.  With more, each pass infers the mixture over its block
and the languages that the passes before selected, whose likelihoods a document
carries along; so any number of languages can be learned, and no worker holds more
than a block.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and
so is everything if no labelled document was given; a null label isn't learned;
repeated rows are judged each for itself; an empty table gives an empty result;
ties between languages go to the smaller code.  Texts of any length are taken whole.
Other columns pass through; those named lang_pred, score or languages are replaced.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, load, written

BITS = 16
BUCKETS = 1 << BITS
#: Added to every count.
SMOOTHING = 0.1
STEPS = 25
#: Log-likelihood that a language must add, per log of the number of trigrams.
PENALTY = 3.0
#: Languages of a block of the model; a block is broadcast.
BLOCK = 128
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the text's letters, with a space between words and at both ends."""
    raw = np.frombuffer(f" {_NOT_LETTERS.sub(' ', text).lower()} ".encode(), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    return (code * np.uint32(2654435761) >> np.uint32(32 - BITS)).astype(np.int64)


#: Languages, sorted, and the logarithms of their trigram probabilities (buckets x languages), block by block.
Model = list[tuple[list[str], np.ndarray]]


def train(labelled: DataFrame) -> Model:
    bounded_batches(labelled.sparkSession)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        waiting: dict[str, list[np.ndarray]] = {}

        def add(lang: str) -> None:
            if lang not in held:
                held[lang] = np.zeros(BUCKETS, np.int64)
            held[lang] += np.bincount(np.concatenate(waiting.pop(lang)), minlength=BUCKETS)

        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                waiting.setdefault(lang, []).append(trigrams(text))
                if len(waiting[lang]) >= 64:
                    add(lang)
        for lang in list(waiting):
            add(lang)
        for lang, counts in sorted(held.items()):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    summed = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    summed = written(summed, "language-counts")
    names = sorted(r["lang"] for r in summed.select("lang").distinct().collect())
    return [_block(summed, names[k : k + BLOCK]) for k in range(0, len(names), BLOCK)]


def _block(summed: DataFrame, names: list[str]) -> tuple[list[str], np.ndarray]:
    """The model of some languages, from at most languages x buckets counts whatever the number of documents."""
    per = summed.filter(F.col("lang").isin(names)).groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).collect()
    counts = np.full((BUCKETS, len(names)), SMOOTHING)
    for row in per:
        counts[row["b"], names.index(row["lang"])] += row["n"]
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def mixture(likelihood: np.ndarray, weight: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the active columns, and the log-likelihood, by expectation-maximisation."""
    p = likelihood[:, active]
    total = weight.sum()
    share = np.full(len(active), 1 / len(active))
    for _ in range(STEPS if len(active) > 1 else 1):
        mixed = p @ share
        new = share * ((weight / mixed) @ p) / total
        moved, share = np.abs(new - share).max(), new
        if moved < 1e-4:
            break
    return share, float(weight @ np.log(p @ share))


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigram buckets of a text and how often each occurs, or None if it has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    return np.unique(trigrams(text), return_counts=True)


def select(rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Shares of all columns of ``rows`` (trigrams x languages, logarithms), 0 for those not selected."""
    rows = rows.astype(np.float64)
    likelihood = np.exp(rows - rows.max(axis=1)[:, None])  # scaled per trigram, which moves no share
    weight = weight.astype(np.float64)
    active = np.arange(rows.shape[1])
    share, value = mixture(likelihood, weight, active)
    cost = PENALTY * np.log(weight.sum() + 1)
    while len(active) > 1:
        # The language with the least share goes if the likelihood it adds doesn't pay for it.
        least = len(share) - 1 - int(np.argmin(share[::-1]))
        fewer = np.delete(active, least)
        share_2, value_2 = mixture(likelihood, weight, fewer)
        if value - value_2 > cost:
            break
        active, share, value = fewer, share_2, value_2
    out = np.zeros(rows.shape[1])
    out[active] = share / share.sum()
    return out


PREDICT = "lang_pred string, score double, languages array<struct<lang:string,share:double>>"
CARRIED = "_carried_langs array<string>, _carried_rows binary"
_SETS = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and languages (the selected set, largest share first)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(*[c for c in ("lang_pred", "score", "languages") if c in docs.columns])
    kept = list(docs.columns)
    if not model:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "languages": F.expr("cast(array() as array<struct<lang:string,share:double>>)")})

    def inferred(text, before, names, log_p):
        """(names, rows, shares) of the languages selected from a block and those before, or None."""
        found = counted(text)
        if found is None:
            return None
        grams, weight = found
        rows = log_p[grams]
        if before[0]:
            rows = np.concatenate((np.frombuffer(before[1], np.float32).reshape(len(grams), -1), rows), axis=1)
            names = [*before[0], *names]
        shares = select(rows, weight)
        on = np.flatnonzero(shares > 0)
        return [names[k] for k in on], rows[:, on], shares[on]

    def step(held, last):
        def run(batches):
            names, log_p = held.value
            for batch in batches:
                more: tuple[list, ...] = ([], [], []) if last else ([], [])
                carried = zip(batch["_carried_langs"].to_pylist(), batch["_carried_rows"].to_pylist(), strict=True) if "_carried_langs" in batch.schema.names else ((None, None) for _ in range(batch.num_rows))
                for text, before in zip(batch["text"].to_pylist(), carried, strict=True):
                    got = inferred(text, before, names, log_p)
                    if not last:
                        row = (got[0], np.ascontiguousarray(got[1]).tobytes()) if got else (None, None)
                    elif got is None:
                        row = (UNKNOWN, 0.0, [])
                    else:
                        # By share, ties by code.
                        sets = sorted(({"lang": n, "share": float(x)} for n, x in zip(got[0], got[2], strict=True)), key=lambda e: (-e["share"], e["lang"]))
                        row = (sets[0]["lang"], min(1.0, sets[0]["share"]), sets)
                    for column, value in zip(more, row, strict=True):
                        column.append(value)
                types = (pa.string(), pa.float64(), _SETS) if last else (pa.list_(pa.string()), pa.binary())
                added = ("lang_pred", "score", "languages") if last else ("_carried_langs", "_carried_rows")
                yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], *[pa.array(c, t) for c, t in zip(more, types, strict=True)]], names=[*kept, *added])

        return run

    fields = _columns(docs)
    for block in model[:-1]:
        docs = written(docs.mapInArrow(step(spark.sparkContext.broadcast(block), False), f"{fields}, {CARRIED}"), "language-block")
    return docs.mapInArrow(step(spark.sparkContext.broadcast(model[-1]), True), f"{fields}, {PREDICT}")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    return train(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"))


def op10_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def brute_force(text: str | None, counts: dict[str, dict[int, int]]) -> dict[str, float]:
    """Shares of the selected languages from trigram counts by language, number by number; for tests."""
    if not text or not any(c.isalpha() for c in text) or not counts:
        return {}
    grams: dict[int, int] = {}
    for g in trigrams(text).tolist():
        grams[g] = grams.get(g, 0) + 1
    totals = {lang: sum(c.values()) + SMOOTHING * BUCKETS for lang, c in counts.items()}
    p = {lang: {g: (counts[lang].get(g, 0) + SMOOTHING) / totals[lang] for g in grams} for lang in counts}
    n = sum(grams.values())

    def fitted(langs):
        share = dict.fromkeys(langs, 1 / len(langs))
        for _ in range(STEPS if len(langs) > 1 else 1):
            mixed = {g: sum(share[x] * p[x][g] for x in langs) for g in grams}
            new = {x: share[x] * sum(k * p[x][g] / mixed[g] for g, k in grams.items()) / n for x in langs}
            moved, share = max(abs(new[x] - share[x]) for x in langs), new
            if moved < 1e-4:
                break
        return share, sum(k * math.log(sum(share[x] * p[x][g] for x in langs)) for g, k in grams.items())

    langs = sorted(counts)
    share, value = fitted(langs)
    while len(langs) > 1:
        least = min(reversed(langs), key=lambda x: share[x])
        fewer = [x for x in langs if x != least]
        share_2, value_2 = fitted(fewer)
        if value - value_2 > PENALTY * math.log(n + 1):
            break
        langs, share, value = fewer, share_2, value_2
    total = sum(share.values())
    return {x: share[x] / total for x in langs}
