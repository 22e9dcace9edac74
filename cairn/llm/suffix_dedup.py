"""Removal of repeated byte strings by threshold-bounded interval expansion.

Each byte that a string of ``LENGTH`` bytes covers is removed if that string also
starts in a document with a smaller doc_id.  Strings are judged on the input.

Three passes, none of which holds more than a part of the corpus in a task:

1. Every window of ``LENGTH`` bytes is assigned to the least hash among its
   ``GRAM``-byte grams (the rightmost on a tie).  The choice rests on the window's
   bytes alone, so equal windows have the same gram.  Windows in a row that share
   their gram form one context, about 17 windows each.  (gram, context hash,
   place) goes to a part by the gram.  In a part, a context that an earlier
   document has as a whole is covered; copies are thus collapsed, already within
   the task that found them.  Contexts whose gram occurs in other contexts of
   other documents are asked for.
2. The bytes asked for are fetched and go to a part by the gram.  There a suffix
   array of the contexts gives their Burrows-Wheeler transform.  Common prefixes
   are derived breadth first by increasing length: the boundaries found with
   length l are extended backwards by one character, which gives those of length
   l + 1, and expansion stops at ``LENGTH``.  What no boundary separates then is one
   interval of equal windows, and its smallest doc_id covers the others.
3. Covered spans and texts meet by document, and the spans are cut.

Passes 1 and 2 end in tables in the shared folder.  There are as many parts as hold
``PART_BYTES`` of text each.  A gram that a sample of the documents shows to be hot
doesn't stand alone as a key: 17 bytes beside it are added, on the side where every
window has them, so its contexts spread over parts and equal windows still meet.

Contexts are told apart by a key of 32 bits within a part and a hash of 64 bits of
other bytes; among 10^13 contexts (170 TB of text) two different ones are taken
for equal with a chance under 0.001.  What the transform compares is bytes.

Defined cases: null and empty texts have no bytes; a null doc_id is neither
smaller nor larger than any other, so such a row keeps all and removes nothing;
rows with the same doc_id don't remove from each other; an empty table gives an
empty result; only doc_id and text are read, so extra columns can't clash.  Texts
are compared as bytes, so a cut can fall inside a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import POWER_BASE, Powers, bounded_batches, load, written

LENGTH = 50
GRAM = 16
#: Anchors gathered before they are dealt to parts.
FLUSH = 1 << 18
#: Bytes of text for a part and for a bucket of documents; passes deal about twice as much.
PART_BYTES = 32 << 20
#: One in so many documents tells which grams are hot.  That moves contexts between parts and changes no result.
PROBE = 64
#: Bytes beside a hot gram that are added to its key.
BESIDE = (LENGTH - GRAM) // 2
#: Bytes of contexts of which one suffix array is made.
SLICE = 1 << 20

def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def contexts_of(raw: bytes, powers: Powers, length: int = LENGTH, gram: int = GRAM, hot: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(first window, windows, key, context hash) of each context of a text.

    The key is the hash of the gram.  A context of a ``hot`` gram is cut in two:
    windows with more than ``BESIDE`` bytes before the gram, whose key takes those
    next to it in, and the others, which have as many behind it.
    """
    n = len(raw)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    b = np.frombuffer(raw, np.uint8)
    up, down = powers.to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    m = n - gram + 1
    h = (sums[gram:] - sums[:m]) * down[:m]
    # Hash above, place below: the least is the rightmost of equal grams.
    low = np.uint64(0xFFFFFFFF)
    code = ((h * np.uint64(0xD6E8FEB86659FD93)) & ~low) | (low - np.arange(m, dtype=np.uint64))
    at = (low - (_sliding_min(code, length - gram + 1) & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    windows = np.diff(np.concatenate((first, [len(at)])))
    place = at[first]
    keys = _scrambled(h[place])
    if hot is not None and len(hot) and (is_hot := np.isin(keys, hot)).any():
        beside = (length - gram) // 2
        before = np.where(is_hot, np.clip(place - first - beside, 0, windows), 0)
        after = windows - before
        lead, tail = np.flatnonzero(is_hot & (before > 0)), np.flatnonzero(after > 0)
        side = np.zeros(len(tail), np.uint64)
        cut = is_hot[tail]
        right = place[tail][cut] + gram
        side[cut] = (sums[right + beside] - sums[right]) * down[right]
        left = place[lead] - beside
        keys = np.concatenate((_scrambled(keys[lead] + (sums[place[lead]] - sums[left]) * down[left]), np.where(cut, _scrambled(keys[tail] ^ side), keys[tail])))
        first, windows, place = np.concatenate((first[lead], (first + before)[tail])), np.concatenate((before[lead], after[tail])), np.concatenate((place[lead], place[tail]))
    stop = first + windows - 1 + length
    inside = (sums[stop] - sums[first]) * down[first]
    offset = (place - first).astype(np.uint64)
    return first, windows, keys, _scrambled(inside + offset * np.uint64(0xA0761D6478BD642F) + windows.astype(np.uint64))


def interval_classes(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, class of each place in it) of a text of symbols 1..255.

    Suffixes have the same class if they agree in ``length`` symbols.  The order is
    by at least that many symbols; the empty suffix is first.
    """
    n = len(text)
    padded = np.concatenate((text.astype(np.uint64), np.zeros(8, np.uint64)))
    key = padded
    for size in (1, 2, 4):
        key = (key[:-size] << np.uint64(8 * size)) | key[size:]
    key = key[: n + 1]
    order = np.argsort(key)  # ties may stand in any order
    key = key[order]
    fresh = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.zeros(n + 1 + length * 2, np.int64)  # past the end: the empty suffix
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n + 1), 0))
    depth = 8
    while depth < length:
        # Only suffixes that still tie are sorted on, by the rank of what follows.
        tied = np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))))
        if not len(tied):
            break
        sub = order[tied]
        pair = (rank[sub] << np.int64(32)) | rank[np.minimum(sub + depth, n)]
        by = np.argsort(pair)
        sub, pair = sub[by], pair[by]
        order[tied] = sub
        fresh[tied] = np.concatenate(([True], pair[1:] != pair[:-1]))
        # Ranks of tied suffixes alone move, and each class of them starts in ``tied``.
        rank[sub] = np.maximum.accumulate(np.where(fresh[tied], tied, 0))
        depth *= 2
    place = np.empty(n + 1, np.int32)
    place[order] = np.arange(n + 1, dtype=np.int32)
    # The transform's symbol before suffix order[j] leads from place j to the place of the suffix one
    # longer; ``next_place`` is that step read the other way.
    symbol = np.concatenate((text, [0]))[order]
    next_place = place[np.minimum(order + 1, n)]
    new = np.concatenate(([True], symbol[1:] != symbol[:-1]))  # common prefix 0
    boundary = new.copy()
    # Neighbours that tie by now agree in at least ``length`` symbols: no boundary comes between them.
    open_ = np.flatnonzero(fresh & ~boundary).astype(np.int32)
    lo, hi = next_place[open_ - 1], next_place[open_]
    lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
    # Where the places after two neighbours are neighbours too, a boundary there leads straight to one here.
    near = hi - lo == 1
    before = np.full(n + 1, -1, np.int32)
    before[hi[near]] = open_[near]
    open_, lo, hi = open_[~near], lo[~near], hi[~near]
    at = np.flatnonzero(new)
    for _ in range(1, length):
        if not len(at):
            break
        # A boundary of the last length between two occurrences of a symbol, extended by it, parts their suffixes.
        count = np.cumsum(new, dtype=np.int32)
        parted = count[hi] > count[lo]
        new[at] = False
        led = before[at]
        at = np.concatenate((led[led >= 0], open_[parted]))
        new[at] = boundary[at] = True
        stay = ~parted
        open_, lo, hi = open_[stay], lo[stay], hi[stay]
    return order, np.cumsum(boundary) - 1


def covered_windows(contexts: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(context, first, last) of the runs of windows that a context with a smaller doc shares."""
    sizes = np.array([len(c) for c in contexts])
    text = np.frombuffer(b"\xfe".join([*contexts, b""]), np.uint8) + np.uint8(1)  # no byte of UTF-8 is 0xFE
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    start = np.cumsum(sizes + 1) - (sizes + 1)
    offset = np.arange(len(text)) - start[owner]
    valid = offset <= sizes[owner] - length
    order, cls = interval_classes(text, length)
    place_doc = np.full(len(order), np.iinfo(np.int64).max)
    inside = order < len(text)
    ok = np.zeros(len(order), bool)
    ok[inside] = valid[order[inside]]
    place_doc[ok] = docs[owner[order[ok]]]
    edges = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    least = np.minimum.reduceat(place_doc, edges)
    hit = np.zeros(len(text) + 1, bool)
    hit[order[ok]] = place_doc[ok] > least[cls[ok]]
    change = np.flatnonzero(np.diff(np.concatenate(([False], hit)).astype(np.int8)))
    return [(int(owner[a]), int(offset[a]), int(offset[b - 1])) for a, b in change.reshape(-1, 2)]


#: Blobs of numpy arrays: ``kind`` 0 contexts for a part, 1 covered spans and 2 requests for a bucket of documents, 3 bytes for a part.
BLOB = "kind int, target int, docs binary, tags binary, counts binary, a binary, b binary, c binary, d binary"
_NAMES = ("kind", "target", "docs", "tags", "counts", "a", "b", "c", "d")
_ARROW = (pa.int32(), pa.int32(), *[pa.binary()] * 7)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW, strict=True)], names=_NAMES)


def _dealt(kind: int, target: np.ndarray, docs: np.ndarray, tags: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """A row for each target.  Within it equal (doc, tag) in a row are stored once."""
    if not len(target):
        return []
    order = np.argsort(target, kind="stable")
    target, docs, tags, columns = target[order], docs[order], tags[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1], [True])))
    out = []
    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
        d, t = docs[x:y], tags[x:y]
        runs = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]))))
        counts = np.diff(np.concatenate((runs, [y - x]))).astype(np.uint32)
        data = [c[x:y].tobytes() for c in columns]
        out.append((kind, int(target[x]), d[runs].tobytes(), t[runs].tobytes(), counts.tobytes(), *data, *[None] * (4 - len(data))))
    return out


def _undealt(rows: list[dict], *types) -> tuple[np.ndarray, ...]:
    """(docs, tags, columns...) of rows of one kind."""
    read = lambda name, t: np.concatenate([np.frombuffer(r[name], t) for r in rows] or [np.zeros(0, t)])
    counts = read("counts", np.uint32)
    return np.repeat(read("docs", np.int64), counts), np.repeat(read("tags", np.int64), counts), *[read(n, t) for n, t in zip("abcd", types, strict=False)]


def _bucket(docs: np.ndarray, n: int) -> np.ndarray:
    return (_scrambled(docs.view(np.uint64) * np.uint64(POWER_BASE)) % np.uint64(n)).astype(np.int32)


def _copies_covered(keys, inner, docs) -> np.ndarray:
    """Which contexts stand as a whole in a smaller document of those given."""
    order = np.lexsort((docs, inner, keys))
    k, i, d = keys[order], inner[order], docs[order]
    start = np.concatenate(([True], (k[1:] != k[:-1]) | (i[1:] != i[:-1])))
    least = d[np.flatnonzero(start)][np.cumsum(start) - 1]
    out = np.zeros(len(keys), bool)
    out[order] = d > least
    return out


def hot_grams(texts: DataFrame, parts: int) -> np.ndarray:
    """Keys of grams that would fill a good share of a part, by a sample of the documents; at most 4 for each part."""

    def count(batches):
        powers = Powers()
        for batch in batches:
            keys = [contexts_of(raw, powers)[2] for raw in batch["text"].to_pylist()]
            found, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    some = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit("probe")), F.lit(PROBE)) == 0).mapInArrow(count, "key long, n long")
    per = written(some.groupBy("key").agg(F.sum("n").alias("n")), "suffix-probe")
    every = per.agg(F.sum("n")).first()[0] or 0
    rows = per.filter(F.col("n") >= max(512, every // (4 * parts))).select("key").collect()
    return np.array(sorted(r["key"] for r in rows), np.int64).view(np.uint64)


def _find_contexts(batches, parts: int, buckets: int, hot: np.ndarray):
    """Texts -> contexts dealt by gram, and spans that the same task can see are covered."""
    powers, held, waiting = Powers(), [], 0
    flush_at = min(8 * FLUSH, max(FLUSH, 32 * parts))  # many parts get blobs of some contexts still

    def flush():
        docs, tags, first, windows, keys, inner = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        copy = _copies_covered(keys, inner, docs)
        stay = ~copy
        target = ((keys >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        rows = _dealt(0, target[stay], docs[stay], tags[stay], keys[stay].astype(np.uint32), inner[stay], first[stay].astype(np.uint32), windows[stay].astype(np.uint8))
        return _batch(rows + _dealt(1, _bucket(docs[copy], buckets), docs[copy], tags[copy], first[copy], (first + windows - 1 + LENGTH)[copy]))

    for batch in batches:
        for doc, tag, raw in zip(batch["doc_id"].to_pylist(), batch["tag"].to_pylist(), batch["text"].to_pylist(), strict=True):
            found = contexts_of(raw, powers, hot=hot)
            n = len(found[0])
            if n:
                held.append((np.full(n, doc, np.int64), np.full(n, tag, np.int64), *found))
                waiting += n
            if waiting >= flush_at:
                yield flush()
                waiting = 0
    if held:
        yield flush()


def _groups(batches, names):
    """Rows as dicts, by target; they come sorted by it."""
    at, held = None, []
    for batch in batches:
        for row in batch.select(list(names)).to_pylist():
            if row["target"] != at:
                if held:
                    yield at, held
                at, held = row["target"], []
            held.append(row)
    if held:
        yield at, held


class _Outbox:
    """Rows for buckets of documents, gathered over the parts of a task so that each bucket gets few blobs."""

    def __init__(self, kind: int, buckets: int) -> None:
        self.kind, self.buckets, self.held, self.size = kind, buckets, [], 0

    def add(self, docs: np.ndarray, *columns: np.ndarray) -> None:
        if len(docs):
            self.held.append((docs, *columns))
            self.size += len(docs)

    def rows(self) -> list[tuple]:
        """(docs, tags, columns...) dealt; the box is empty afterwards."""
        if not self.held:
            return []
        docs, tags, *columns = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        return _dealt(self.kind, _bucket(docs, self.buckets), docs, tags, *columns)


def _settle(batches, buckets: int):
    """Contexts of a part -> covered spans, and requests for the bytes of the others that may share a window."""
    covered, wanted = _Outbox(1, buckets), _Outbox(2, buckets)
    for _, rows in _groups(batches, _NAMES):
        passing = [r for r in rows if r["kind"] == 1]
        if passing:
            covered.add(*_undealt(passing, np.int64, np.int64))
        docs, tags, keys, inner, first, windows = _undealt([r for r in rows if r["kind"] == 0], np.uint32, np.uint64, np.uint32, np.uint8)
        del rows
        if len(docs):
            first, windows = first.astype(np.int64), windows.astype(np.int64)
            copy = _copies_covered(keys, inner, docs)
            covered.add(docs[copy], tags[copy], first[copy], (first + windows - 1 + LENGTH)[copy])
            left = np.flatnonzero(~copy)
            left = left[np.lexsort((docs[left], keys[left]))]
            k, d = keys[left], docs[left]
            start = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
            group = np.cumsum(start) - 1
            # Sorted by gram and document: a group has several documents if its ends differ.
            heads = np.flatnonzero(start)
            tails = np.concatenate((heads[1:], [len(k)])) - 1
            want = left[(d[heads] != d[tails])[group]] if len(k) else left
            wanted.add(docs[want], tags[want], keys[want], (first[want] << np.int64(8) | windows[want]).astype(np.uint64))
        for box in (covered, wanted):
            if box.size >= FLUSH:
                yield _batch(box.rows())
    yield _batch(covered.rows() + wanted.rows())


WITH_TEXT = "target int, kind int, doc_id long, tag long, text binary, docs binary, tags binary, counts binary, a binary, b binary"


def _beside_texts(texts: DataFrame, blobs: DataFrame, buckets: int) -> DataFrame:
    """Texts and blobs of the same bucket in the same partition, blobs first."""
    from pyspark.sql.types import IntegerType

    own = texts.mapInArrow(lambda bs: _with_bucket(bs, buckets), "target int, doc_id long, tag long, text binary")
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    texts = own.select("target", F.lit(9).alias("kind"), "doc_id", "tag", "text", *none("docs", "tags", "counts", "a", "b"))
    blobs = blobs.select(F.col("target").cast(IntegerType()), "kind", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("tag"), *none("text"), "docs", "tags", "counts", "a", "b")
    return blobs.unionByName(texts).repartitionById(buckets, "target").sortWithinPartitions("target", "kind")


def _with_bucket(batches, buckets: int):
    """Bucket of each text, and the text compressed for the shuffle."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        docs = np.array([0 if d is None else d for d in batch["doc_id"].to_pylist()], np.int64)
        packed = pa.array([packer.compress(t) for t in batch["text"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(_bucket(docs, buckets).astype(np.int32)), batch["doc_id"], batch["tag"], packed], names=["target", "doc_id", "tag", "text"])


def _by_document(batches, *types):
    """(doc_id, tag, text, columns for that document) of each text row."""
    at, waiting, index = None, [], None
    unpacker = zstandard.ZstdDecompressor()
    for batch in batches:
        for row in batch.to_pylist():
            if row["target"] != at:
                at, waiting, index = row["target"], [], None
            if row["kind"] != 9:
                waiting.append(row)
                continue
            if index is None:
                docs, tags, *columns = _undealt(waiting, *types)
                order = np.lexsort((tags, docs))
                docs, tags, columns = docs[order], tags[order], [c[order] for c in columns]
                starts = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])))) if len(docs) else np.zeros(0, np.int64)
                stops = np.concatenate((starts[1:], [len(docs)])) if len(docs) else starts
                index = {(int(docs[a]), int(tags[a])): (a, b) for a, b in zip(starts, stops, strict=True)}
                waiting = []
            a, b = index.get((row["doc_id"], row["tag"]), (0, 0))
            yield row["doc_id"], row["tag"], unpacker.decompress(row["text"]), [c[a:b] for c in columns]


def _fetch(batches, parts: int):
    """Requests beside texts -> the bytes of each context, dealt by its gram."""
    held, size = [], 0

    def flush():
        docs, tags, keys, place, raw = zip(*held, strict=True)
        held.clear()
        keys = np.array(keys, np.uint64)
        target = (_scrambled(keys) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(target, kind="stable")
        rows = _dealt(3, target, np.array(docs, np.int64), np.array(tags, np.int64), np.array(place, np.uint64), keys.astype(np.uint32))
        cuts = np.flatnonzero(np.diff(target[order], prepend=-1, append=-1))
        each = [b"".join(raw[k] for k in order[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return _batch([(*row[:7], data, None) for row, data in zip(rows, each, strict=True)])

    for doc, tag, text, (keys, place) in _by_document(batches, np.uint32, np.uint64):
        for key, p in zip(keys.tolist(), place.tolist(), strict=True):
            first, windows = p >> 8, p & 255
            held.append((doc, tag, key, p, text[first : first + windows - 1 + LENGTH]))
        size += len(keys)
        if size >= FLUSH // 4:
            yield flush()
            size = 0
    if held:
        yield flush()


def _expand(batches, buckets: int):
    """Contexts of a part -> spans covered by windows of smaller documents.

    A part is worked off in slices of whole grams, as many as fit ``SLICE`` bytes.
    """
    covered = _Outbox(1, buckets)
    for _, rows in _groups(batches, _NAMES):
        docs, tags, place, keys = _undealt(rows, np.uint64, np.uint32)
        first, windows = (place >> np.uint64(8)).astype(np.int64), (place & np.uint64(255)).astype(np.int64)
        raw, ends = b"".join(r["c"] for r in rows), np.cumsum(windows - 1 + LENGTH)
        del rows
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
        sums = np.concatenate(([0], np.cumsum((windows - 1 + LENGTH)[order])))
        at = 0
        while at < len(order):
            # The last gram that begins within the slice is the next one's first.
            limit = np.searchsorted(sums, sums[at] + SLICE)
            later = heads[(heads > at) & (heads <= limit)]
            stop = int(later[-1]) if len(later) and limit < len(order) else len(order) if limit >= len(order) else int(np.append(heads[heads > at], len(order))[0])
            some = order[at:stop]
            contexts = [raw[ends[k] - windows[k] + 1 - LENGTH : ends[k]] for k in some.tolist()]
            found = np.array(covered_windows(contexts, docs[some]), np.int64).reshape(-1, 3)
            k = some[found[:, 0]]
            covered.add(docs[k], tags[k], first[k] + found[:, 1], first[k] + found[:, 2] + LENGTH)
            at = stop
        if covered.size >= FLUSH:
            yield _batch(covered.rows())
    yield _batch(covered.rows())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def covered_spans(docs: DataFrame) -> tuple[DataFrame, int]:
    """Blobs of covered (start, stop) spans by bucket of documents, and the number of buckets."""
    spark = docs.sparkSession
    bounded_batches(spark)
    long = docs.filter("doc_id is not null and octet_length(text) >= " + str(LENGTH))
    size = long.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    known = _texts(long)
    hot = hot_grams(known, parts)
    found = known.mapInArrow(lambda bs: _find_contexts(bs, parts, buckets, hot), BLOB)
    settled = written(found.repartitionById(parts, "target").sortWithinPartitions("target").mapInArrow(lambda bs: _settle(bs, buckets), BLOB), "suffix-settled")
    asked = _beside_texts(known, settled.filter("kind = 2"), buckets).mapInArrow(lambda bs: _fetch(bs, parts), BLOB)
    more = written(asked.repartitionById(parts, "target").sortWithinPartitions("target").mapInArrow(lambda bs: _expand(bs, buckets), BLOB), "suffix-expanded")
    return settled.filter("kind = 1").unionByName(more), buckets


def _merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    cut = np.flatnonzero(np.concatenate(([True], starts[1:] > stops[:-1]))) if len(starts) else np.zeros(0, np.int64)
    return list(zip(starts[cut].tolist(), stops[np.concatenate((cut[1:], [len(stops)])) - 1].tolist(), strict=True)) if len(cut) else []


CLEAN = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs, in bytes) and kept (remaining bytes) of every row."""
    blobs, buckets = covered_spans(docs)

    def run(batches):
        rows: list[tuple] = []
        size = 0

        def ready():
            columns = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "n_bytes", "spans", "kept"])

        for doc, _, text, (starts, stops) in _by_document(batches, np.int64, np.int64):
            spans = _merged(starts, stops) if doc is not None else []
            edges = [0, *[x for s in spans for x in s], len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((doc, len(text), [{"start": a, "stop": b} for a, b in spans], kept))
            size += len(kept)
            if size > 8_000_000 or len(rows) >= 2048:
                yield ready()
                rows, size = [], 0
        if rows:
            yield ready()

    return _beside_texts(_texts(docs), blobs, buckets).mapInArrow(run, CLEAN)


def op7_suffix_dedup(spark, sf_dir):
    done = remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def brute_force(docs: list[tuple[int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """What the query returns, from a table of all strings; for tests."""
    least: dict[bytes, int] = {}
    for doc, text in docs:
        for k in range(len(text) - length + 1):
            w = text[k : k + length]
            least[w] = min(least.get(w, doc), doc)
    out = []
    for doc, text in docs:
        gone = bytearray(len(text))
        for k in range(len(text) - length + 1):
            if least[text[k : k + length]] < doc:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((doc, len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out
