"""N-gram Jaccard self-join by chosen paths.

A document is its set of five-word shingles (a shorter one is a single shingle of
all its words).  Two documents are linked if the Jaccard similarity of their sets
is at least 0.8.

Chosen paths: every set samples those of its shingles whose hash is under
``RUNS / (0.8 * size)`` and goes into a bucket for each; slice r of that range of
hashes is run r, so all runs share one pass and one bucket per shingle.  A shingle
that one set of a linked pair sampled is sampled by the other with a chance of 0.8
at least.  Buckets up to ``LIMIT`` sets are compared by brute force.  A set that
stands in enough of them for the wanted recall is settled and leaves its larger
buckets; the rest of those is split: every set goes on with one shingle of its own,
the least of the first slot of its sketch in an order drawn for the bucket, which
two sets have in common with the chance of their similarity.  Splitting is repeated
until buckets are small, and the runs below the first level are repeated with fresh
orders until every set has its recall.

* Sets are compared in buckets by sketches (one-permutation minhash, 256 slots of
  a byte) with a margin of five standard deviations under the threshold, and what
  passes is united into candidate groups.  Every pair inside a candidate group is
  then compared exactly, so a group's links are complete even where no run put
  the pair in one bucket.
* Equal sets are one class from the start; copies are never compared.
* The sets of a large bucket that a split left nearly whole are compared with its
  first set.  If they are like it on the whole, no split would make the bucket
  small: sets that nearly equal the first are united with it and leave all buckets
  (whatever is near to them is near to it too), the others are compared in blocks,
  all pairs of blocks.
* Large candidate groups are verified in blocks too: a task holds two blocks.
* Shingles and sets are known by 64-bit hashes.
* Pairs are never emitted.  A task returns, for each set, the number of its links
  and the root of its component among the rows it saw.

Components are found by label propagation on tables in the shared folder; the
driver only reads the number of labels that changed.

Defined cases: null and empty texts, and texts without words, have no shingles,
no links and are classes of their own; rows that repeat a doc_id are documents
like any other (each counts as a link of its copies); a row without a doc_id is
linked only through a set that a row with one has too; an empty table gives an
empty result; only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Powers, bounded_batches, load, written
from .decontamination import WORD_BYTES, words_of

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
#: What the misses of independent paths must add up to, as a negative logarithm; and the runs whose expected shared shingles give it.
NEED = -math.log(1 - RECALL)
RUNS = math.ceil(NEED)
#: Sets of a bucket up to which it is compared by brute force.
LIMIT = 1024
SLOTS = 256
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 22
#: Sets of a block in exact verification.
BLOCK = 1024
#: Sketch similarity from which a pair is a candidate, and from which a set leaves with its first set.
CANDIDATE = THRESHOLD - 5 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SLOTS)
ABSORB = 0.94
#: Mean similarity to its first set from which a large bucket isn't split but compared; and the part a split must leave for that to be asked.
DENSE = 0.9 * THRESHOLD
#: Levels after which any bucket is compared, not split.
DEEPEST = 24
#: A smaller set has no link to a different one: a shingle more or less is over the threshold.
LEAST = math.ceil(THRESHOLD / (1 - THRESHOLD) - 1e-9)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def settles(depth: int) -> float:
    """What a path of ``depth`` shared choices adds to ``NEED``: each is shared with a chance of the threshold at least."""
    return -math.log(1 - THRESHOLD**depth)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, powers: Powers) -> np.ndarray:
    """A hash of each word, from polynomial prefix sums over the bytes; no word becomes an object."""
    low = text.translate(WORD_BYTES)
    out, at = [], 0
    while at < len(low):
        stop = len(low)
        if stop - at > PIECE:
            stop = low.find(b" ", at + PIECE) + 1 or stop
        raw = np.frombuffer(low, np.uint8, stop - at, at)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], raw != 32, [False])).astype(np.int8)))
        starts, stops = edges[::2], edges[1::2]
        up, down = powers.to(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(raw * up[: len(raw)], out=sums[1:])
        out.append(mixed((sums[stops] - sums[starts]) * down[starts]))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes | None, powers: Powers) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    h = word_hashes(text or b"", powers)
    if not len(h):
        return h
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + n]
    out = mixed(out)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True)


def sketch(s: np.ndarray) -> np.ndarray:
    """A byte for each slot: of the least shingle that falls in it, 0 if none does.  Shingles come sorted."""
    out = np.zeros(SLOTS, np.uint8)
    slot = (s >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(s) else np.zeros(0, np.int64)
    out[slot[first]] = (mixed(s[first]) % np.uint64(255)).astype(np.uint8) + 1
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row."""
    same = ((a == b) & (a > 0)).sum(axis=-1)
    return same / np.maximum(((a | b) > 0).sum(axis=-1), 1)


def chosen(s: np.ndarray) -> np.ndarray:
    """The shingles of a set that its runs sample, with the chance ``RUNS / (threshold * size)`` each."""
    if len(s) < LEAST:
        return s[:0]
    return s[mixed(s ^ np.uint64(0x5851F42D4C957F2D)) <= np.uint64(min(2**64 - 1, int(2**64 * RUNS / (THRESHOLD * len(s)))))]


def class_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, sets).  rows: doc_id, set_id, text_hash of every document; sets: set_id, copies, keys, sketch of every distinct set.

    ``set_id`` is a hash of the whole shingle set, null without one; ``keys`` are
    the buckets the set goes into on the first level.
    """

    def run(batches):
        powers = Powers()
        for batch in batches:
            ids, sketches, keys = [], [], []
            for text in batch["text"].to_pylist():
                s = shingles(text, powers)
                if not len(s):
                    ids.append(None), sketches.append(None), keys.append(None)
                    continue
                ids.append(set_id(s))
                sketches.append(sketch(s).tobytes())
                keys.append(chosen(s).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(ids, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "text_hash", "set_id", "keys", "sketch"]
            )

    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    every = written(texts.mapInArrow(run, "doc_id long, text_hash long, set_id long, keys array<bigint>, sketch binary"), "jaccard-rows")
    sets = every.filter("set_id is not null").groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    return every.select("doc_id", "set_id", "text_hash"), sets


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


EDGES = "a long, b long"


def _edges_of(ids: np.ndarray, keys: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """Forest of the candidate pairs inside the buckets; rows are sorted by key."""
    n, out = len(ids), []
    places: dict[int, int] = {}
    node = [places.setdefault(int(x), len(places)) for x in ids]
    union, names = _Union(len(places)), list(places)
    sizes = np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [n])))
    starts = np.cumsum(sizes) - sizes

    def unite(i, j):
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if union.join(node[a], node[b]):
                out.append((names[node[a]], names[node[b]]))

    # Small buckets together: rows at each distance within a bucket, all buckets at once.
    small = np.flatnonzero(np.repeat(sizes <= 32, sizes))
    for step in range(1, 32):
        i = small[small + step < n]
        i = i[keys[i] == keys[i + step]]
        if not len(i):
            break
        for k in range(0, len(i), 1 << 14):
            part = i[k : k + (1 << 14)]
            good = similarity(sketches[part], sketches[part + step]) >= CANDIDATE
            unite(part[good], part[good] + step)
    # Larger ones: each set against those after it that aren't of its group yet.
    for start, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        rows = np.arange(start, start + size)
        group = np.array([union.root(node[k]) for k in rows])
        for k in range(size - 1):
            other = k + 1 + np.flatnonzero(group[k + 1 :] != group[k])
            if not len(other):
                continue
            good = other[similarity(sketches[rows[other]], sketches[rows[k]]) >= CANDIDATE]
            if len(good):
                unite(np.full(len(good), rows[k]), rows[good])
                group[np.isin(group, group[good])] = group[k]
    return out


def _bucket_edges(rows: DataFrame) -> DataFrame:
    """Candidate edges inside buckets: key, set_id, sketch -> a, b.  Every bucket is within ``LIMIT``."""

    def run(batches):
        held: list[tuple] = []

        def ready(parts):
            ids, keys, sk = (np.concatenate([p[k] for p in parts]) for k in range(3))
            edges = _edges_of(ids, keys, sk)
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch["key"].to_numpy(zero_copy_only=False)
            ids = batch["set_id"].to_numpy(zero_copy_only=False)
            sk = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8).reshape(-1, SLOTS)
            held.append((ids, keys, sk))
            if sum(len(p[0]) for p in held) >= 20_000 and keys[0] != keys[-1]:
                cut = int(np.flatnonzero(keys == keys[-1])[0])  # the last bucket may go on
                yield ready([*held[:-1], (ids[:cut], keys[:cut], sk[:cut])])
                held = [(ids[cut:], keys[cut:], sk[cut:])]
        if held:
            yield ready(held)

    dealt = rows.select("key", "set_id", "sketch").repartition("key").sortWithinPartitions("key", "set_id")
    return dealt.mapInArrow(run, EDGES)


def _split(rows: DataFrame) -> DataFrame:
    """Buckets split by the shingles of their sets: each set goes on with one, known by its slot and byte.

    ``turn`` tells apart the orders drawn for the same bucket; ``was`` is the size of the bucket before.
    """

    def run(batches):
        slots = mixed(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            keys = mixed(batch["key"].to_numpy(zero_copy_only=False).view(np.uint64) + mixed(batch["turn"].to_numpy(zero_copy_only=False).astype(np.uint64) + np.uint64(1)))
            values = np.frombuffer(b"".join(batch["sketch"].to_pylist()), np.uint8).reshape(-1, SLOTS)
            order = mixed(keys[:, None] + slots) >> np.uint64(1)
            order[values == 0] = np.uint64(2**64 - 1)
            least = order.argmin(axis=1)
            token = (least.astype(np.uint64) << np.uint64(8)) | values[np.arange(len(values)), least]
            fresh = mixed(keys + (token + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
            yield pa.RecordBatch.from_arrays([pa.array(fresh.view(np.int64)), batch["set_id"], batch["sketch"], batch["n"]], names=["key", "set_id", "sketch", "was"])

    return written(rows.select("key", "set_id", "sketch", "n", "turn").mapInArrow(run, "key long, set_id long, sketch binary, was long"), "jaccard-split")


def _against_first(rows: DataFrame) -> DataFrame:
    """Rows beside the first set of their bucket, and whether the bucket is dense: key, set_id, sketch, n, first, near, dense."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("sketch", "first_sketch"))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("key", "set_id", "sketch", "n", "first")], pa.array(similarity(a, b))], names=["key", "set_id", "sketch", "n", "first", "near"])

    firsts = rows.groupBy("key").agg(F.min("set_id").alias("first"), F.min_by("sketch", "set_id").alias("first_sketch"))
    told = written(rows.join(firsts, "key").mapInArrow(run, "key long, set_id long, sketch binary, n long, first long, near double"), "jaccard-first")
    return written(told.join(told.groupBy("key").agg((F.avg("near") >= DENSE).alias("dense")), "key"), "jaccard-dense")


def _dense_edges(dense: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(edges, sets that a first set stands for) of dense buckets."""
    other = dense.filter(F.col("set_id") != F.col("first"))
    # Where sets leave with the first one, what is near to them must be found by it.
    star = other.filter(F.col("near") >= CANDIDATE - (1 - ABSORB)).select(F.col("first").alias("a"), F.col("set_id").alias("b")).distinct()
    # A first set that another first set stands for stands for nobody, so likeness doesn't drift along a chain.
    equal = other.filter(F.col("near") >= ABSORB).select("set_id", "first").distinct()
    gone = written(equal.join(equal.select(F.col("set_id").alias("first")).distinct(), "first", "left_anti").select("set_id").distinct(), "jaccard-gone")
    return [star, _blocks(dense.join(gone, "set_id", "left_anti").select("key", "set_id", "sketch"))], gone


def _settled(parts: list[DataFrame]) -> DataFrame:
    """set_id and its sum of ``gain``."""
    return _union(parts).groupBy("set_id").agg(F.sum("gain").alias("gain"))


def _descend(rows: DataFrame, gained: DataFrame, depth: int) -> tuple[list[DataFrame], DataFrame, int]:
    """Splits buckets until they are small.  (edges, gains, depth): candidate edges; set_id, gain of all sets in ``rows``.

    ``rows``: key, set_id, sketch, was.  ``gained`` is what the sets have been given
    before; a set with ``NEED`` leaves, one that a first set stands for too.
    """
    edges, gains = [], [gained]
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        held = written(rows.join(sizes, "key"), "jaccard-level")
        small, large = held.filter(F.col("n") <= LIMIT), held.filter(F.col("n") > LIMIT)
        gain = F.lit(settles(depth)).alias("gain")
        gains.append(small.select("set_id", gain))
        edges.append(_bucket_edges(small.filter("n > 1")))
        if large.isEmpty():
            return edges, written(_settled(gains), "jaccard-gains"), depth
        deep = F.lit(depth >= DEEPEST)
        whole = F.coalesce(F.col("n") >= DENSE * F.col("was"), F.lit(False)) | deep
        stuck = large.filter(whole)
        still = large.filter(~whole).select("key", "set_id", "sketch", "n")
        if not stuck.isEmpty():
            told = _against_first(stuck).withColumn("dense", F.col("dense") | deep)
            dense = told.filter("dense")
            if not dense.isEmpty():
                more, gone = _dense_edges(dense)
                edges += more
                gains += [dense.select("set_id", gain), gone.select("set_id", F.lit(NEED).alias("gain"))]
            still = still.unionByName(told.filter("not dense").select("key", "set_id", "sketch", "n"))
        done = _settled(gains).filter(F.col("gain") >= NEED).select("set_id")
        rows, depth = _split(still.join(done, "set_id", "left_anti").withColumn("turn", F.lit(0))), depth + 1


def candidate_edges(sets: DataFrame) -> DataFrame:
    """Edges that span the candidate groups of sets."""
    first = sets.select(F.explode("keys").alias("key"), "set_id")
    sizes = first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    meet = written(first.join(sizes, "key"), "jaccard-buckets")
    # Sketches go only to sets that meet another; keys and ids are all that was dealt so far.
    small, large = meet.filter(F.col("n") <= LIMIT), meet.filter(F.col("n") > LIMIT)
    edges = [_bucket_edges(small.join(sets.select("set_id", "sketch"), "set_id"))]
    if large.isEmpty():
        return _all(edges)
    hot = large.groupBy("set_id").agg(F.count(F.lit(1)).alias("hot"))
    gained = hot.join(sets.select("set_id", F.size("keys").alias("all")), "set_id").select("set_id", ((F.col("all") - F.col("hot")) * settles(1)).alias("gain"))
    gained = written(gained.filter(F.col("gain") < NEED), "jaccard-gains")
    rows = written(large.join(gained.select("set_id"), "set_id").join(sets.select("set_id", "sketch"), "set_id").select("key", "set_id", "sketch", "n"), "jaccard-large")
    more, gained, deepest = _descend(rows.drop("n").withColumn("was", F.lit(None).cast("long")), gained, 1)
    paths, turn = rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("paths")), 1
    while True:
        edges += more
        # Runs that a set still needs, if its paths end where the longest did.
        short = paths.join(gained.filter(F.col("gain") < NEED), "set_id")
        short = short.select("set_id", F.ceil((NEED - F.col("gain")) / (F.col("paths") * settles(deepest))).cast("int").alias("runs"))
        again = rows.join(short, "set_id").withColumn("turn", F.explode(F.sequence(F.lit(turn), F.lit(turn - 1) + F.col("runs"))))
        todo = _split(again)
        if todo.isEmpty():
            return _all(edges)
        turn += short.agg(F.max("runs")).first()[0]
        more, gained, deepest = _descend(todo, gained, 2)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _all(frames: list[DataFrame]) -> DataFrame:
    return _union(frames).distinct()


def _blocks(large: DataFrame) -> DataFrame:
    """Candidate edges of buckets over the limit: every pair of blocks of them is a bucket."""
    sizes = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / (LIMIT // 2)).cast("int").alias("blocks"))
    placed = large.join(sizes, "key").withColumn("_block", F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("blocks")).cast("int"))
    return _bucket_edges(_block_pairs(placed, "key").withColumn("key", F.xxhash64("key", "low", "high")))


def _block_pairs(placed: DataFrame, key: str) -> DataFrame:
    """A row for each pair of blocks that a row's block is in: low, high."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_other")
    return placed.select("*", other).withColumn("low", F.least("_block", "_other")).withColumn("high", F.greatest("_block", "_other")).drop("_other")


def components(edges: DataFrame, label: str = "jaccard-components") -> DataFrame:
    """(id, root) of every id in ``edges``; the root is the smallest id of its component.

    Large star / small star: every round joins the neighbours of an id to the
    smallest of them, until no edge moves.  Rounds grow with the logarithm of the
    longest path; each is written to the shared folder.
    """
    one = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    held, before = written(one, label), None
    while True:
        both = held.select("u", "v").unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        star = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: smaller neighbours, and the id itself, to the smallest of them.
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        pulled = star.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        held = written(pulled.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label)
        state = held.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == state:
            break
        before = state
    roots = held.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "id")
    return roots.unionByName(held.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


VERIFIED = "set_id long, links long, root long"


def _verify_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of ``left`` x ``right`` (places in ``sets``) are at or over the threshold, exactly.

    Intersections are products of 0/1 matrices over the shingles that two sets
    or more share, some columns at a time.
    """
    size = np.array([len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int((count > 1).sum())
    both = np.zeros((len(left), len(right)), np.float32)
    step = max(64, (1 << 22) // len(sets))
    for at in range(0, width, step):
        a, b = np.searchsorted(column, (at, at + step))
        m = np.zeros((len(sets), min(step, width - at)), np.float32)
        m[row[a:b], column[a:b] - at] = 1
        both += m[left] @ m[right].T
    union = (size[left, None] + size[None, right]).astype(np.float32) - both
    return both >= np.float32(THRESHOLD) * union - np.float32(1e-3)


def _verify_group(ids: np.ndarray, copies: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], low: int, high: int) -> list[tuple[int, int, int]]:
    """Set, links and component root over the pairs of a group that belong to blocks (low, high)."""
    left, right = np.flatnonzero(blocks == low), np.flatnonzero(blocks == high)
    links, root = np.zeros(len(ids), np.float64), np.full(len(ids), -1)
    if len(left) and len(right):
        linked = _verify_pairs(sets, left, right)
        if low == high:
            np.fill_diagonal(linked, False)
        links[left] += linked @ copies[right]
        if low != high:
            links[right] += copies[left] @ linked
        near = np.zeros((len(ids), len(ids)), bool)
        near[np.ix_(left, right)] = linked
        near |= near.T
        for k in range(len(ids)):
            if root[k] < 0:
                reach = np.zeros(len(ids), bool)
                fresh = np.array([k])
                while len(fresh):
                    reach[fresh] = True
                    fresh = np.flatnonzero(near[fresh].any(axis=0) & ~reach)
                root[reach] = k
    return [(int(i), int(n), int(ids[r] if r >= 0 else i)) for i, n, r in zip(ids, links, root, strict=True)]


def verified(members: DataFrame) -> DataFrame:
    """Exact links: root, set_id, copies, text -> set_id, links, root, of every task's share of the pairs."""
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "root").withColumn("_block", F.pmod(F.xxhash64("set_id", F.lit(11)), F.col("blocks")).cast("int"))
    dealt = _block_pairs(placed, "root").withColumn("group", F.xxhash64("root", "low", "high"))
    dealt = dealt.select("group", "root", "low", "high", "_block", "set_id", "copies", "shingles").repartition("group").sortWithinPartitions("group", "root", "low", "high")

    def run(batches):
        held: list = []
        at = None

        def ready():
            ids, copies, blocks, raw = zip(*{row[0]: row for row in held}.values(), strict=True)
            found = _verify_group(np.array(ids), np.array(copies, np.float64), np.array(blocks), [np.frombuffer(x, np.uint64) for x in raw], at[1], at[2])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["set_id", "links", "root"])

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("root", "low", "high", "set_id", "copies", "_block", "shingles")]
            for root, low, high, *row in zip(*columns, strict=True):
                if (root, low, high) != at:
                    if len(held) > 1:
                        yield ready()
                    held, at = [], (root, low, high)
                held.append(row)
        if len(held) > 1:
            yield ready()

    return dealt.mapInArrow(run, VERIFIED)


def _with_shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (doc_id, set_id, ...) with the shingles of each set, from the text of its document."""
    names = wanted.columns

    def run(batches):
        powers = Powers()
        for batch in batches:
            found = [shingles(t, powers) for t in batch["text"].to_pylist()]
            # A doc_id may stand on rows of other sets too.
            own = pa.array([k for k, (s, i) in enumerate(zip(found, batch["set_id"].to_pylist(), strict=True)) if set_id(s) == i], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch[c].take(own) for c in names], pa.array([found[k].tobytes() for k in own.to_pylist()], pa.binary())], names=[*names, "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)
    return wanted.join(texts, "doc_id").select(*names, "text").mapInArrow(run, f"{fields}, shingles binary")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, known).  rows as in ``class_sets``; known: set_id, doc_id, text_hash, copies, links, root of every set.

    doc_id and text_hash are of the row that stands for the set, ``root`` names its component.
    """
    rows, sets = class_sets(docs)
    groups = components(candidate_edges(sets), "jaccard-groups").withColumnRenamed("id", "set_id")
    # One document stands for each set of a candidate group.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    speaker = rows.filter("set_id is not null").groupBy("set_id").agg(first.alias("_first"), F.count(F.lit(1)).alias("copies")).select("set_id", "_first.*", "copies")
    members = written(_with_shingles(docs, speaker.drop("text_hash").join(groups, "set_id")), "jaccard-members")
    told = written(verified(members), "jaccard-verified")
    links = told.groupBy("set_id").agg(F.sum("links").alias("links"))
    linked = components(told.filter("set_id <> root").select(F.col("set_id").alias("a"), F.col("root").alias("b")), "jaccard-classes").withColumnRenamed("id", "set_id")
    known = speaker.join(links, "set_id", "left").join(linked, "set_id", "left")
    return rows, known.select("set_id", "doc_id", "text_hash", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set_id").alias("root"))


def link_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links of every row of ``docs``.

    ``class_id`` is the smallest doc_id of the component of linked documents,
    ``n_links`` the number of other documents at or over the threshold.
    """
    rows, known = _classes(docs)
    names = known.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    known = known.join(names, "root").select("set_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = rows.join(known, "set_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class: one of its smallest doc_id for each class.

    Classes that share their smallest doc_id, because it stands on different texts,
    keep a row each.  Texts without words are classes of their own; of rows equal in
    doc_id and text one stays.  Rows without a doc_id stay.
    """
    rows, known = _classes(docs)
    spoken = known.filter("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("_first")).select("_first.*")
    wordless = rows.filter("set_id is null and doc_id is not null").select("doc_id", "text_hash")
    stay = spoken.unionByName(wordless).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    kept = docs.withColumn("_text_hash", F.xxhash64("text"))
    kept = kept.join(stay, (F.col("doc_id") == F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    same = Window.partitionBy("doc_id", "_text_hash").orderBy("text")
    kept = kept.withColumn("_copy", F.row_number().over(same)).filter("_copy = 1").drop("_copy", "_text_hash")
    return kept.unionByName(docs.filter("doc_id is null"))


def op5_jaccard_join(spark, sf_dir):
    return link_classes(load(spark, sf_dir, "documents").select("doc_id", "text"))


def brute_force(docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
    """doc_id, class_id, n_links by comparing all pairs of word sets; for tests."""
    sets = []
    for _, text in docs:
        words = words_of(None if text is None else text.encode())
        size = min(SHINGLE, len(words))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set())
    union, links = _Union(len(docs)), [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= THRESHOLD * len(sets[i] | sets[j]) - 1e-9:
                union.join(i, j)
                links[i] += 1
                links[j] += 1
    least: dict[int, int] = {}
    for k, (doc_id, _) in enumerate(docs):
        least[union.root(k)] = min(least.get(union.root(k), doc_id), doc_id)
    return [(doc_id, least[union.root(k)], links[k]) for k, (doc_id, _) in enumerate(docs)]
