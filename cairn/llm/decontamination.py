"""Benchmark decontamination with a generalised suffix automaton.

Test items are normalised to words and put into one suffix automaton over word
ids.  A document's words are streamed through it; the length of the longest
match that ends at each word says which words lie in an occurrence of a window
of an item.  Hit spans are cut out, and a document that is covered beyond a
limit is dropped.

Words: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  A window is
``window`` consecutive words of an item; a shorter item is one window.

The automaton is broadcast, so its size is bounded: items are taken in blocks of
at most ``BLOCK_WORDS`` words, each block makes one automaton and one pass over
the documents, and the passes are merged per document.  A longer item is cut into
pieces that overlap by a word less than a window, so every window is in one piece.
A block has at most two states a word, and a state with a single way on takes two
integers: 41 bytes a word as it is sent and 340 in a worker, measured on a text of
many rare words; a full block is 20 MB and 170 MB.

Defined cases: null and empty texts have no words and are never contaminated;
items without words are ignored; items that repeat an item_id count once in
``n_items``; a null item_id is left out of ids and counts but its words still
hit; rows that repeat a doc_id keep one result row each; an empty table gives an
empty result, an empty benchmark hits nothing.  ``scan`` returns its own columns
and the key only, so extra columns don't clash.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, load, written

WINDOW = 10
BLOCK_WORDS = 500_000
#: Documents covered beyond this share are dropped, the rest lose the spans.
MAX_COVERAGE = 0.5
#: Documents with a hit span longer than this are dropped.
MAX_SPAN = 1_000

#: Bytes of words as they are normalised; every other byte becomes a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]
        ends: list[tuple[int, int, int]] = []  # state after each word, item, words read
        self.ids = [item for item, _ in items]
        for k, (_, words) in enumerate(items):
            last = 0
            for n, w in enumerate(words, 1):
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                if n >= window or n == len(words):
                    ends.append((last, k, min(n, window)))
        #: (state that holds the window, its length) -> items; the state is the one reached by the window alone.
        self.found: dict[tuple[int, int], set[int] | tuple[int, ...]] = {}
        for state, k, size in ends:
            self.found.setdefault((self._holding(state, size), size), set()).add(k)
        self.sizes = sorted({size for _, size in self.found})
        self.least = self.sizes[0] if self.sizes else 0
        self._pack()

    def _pack(self) -> None:
        """Transitions as integers: the only word of a state and where it leads; -1 without one, -2 with several, which ``many`` holds."""
        only = [next(iter(ways.items())) if len(ways) == 1 else (-2 if ways else -1, -1) for ways in self.next]
        self.only_word, self.only_next = (array("i", column) for column in zip(*only, strict=True))
        self.many = {state: ways for state, ways in enumerate(self.next) if len(ways) > 1}
        self.link, self.length = array("i", self.link), array("i", self.length)
        self.found = {key: tuple(sorted(items)) for key, items in self.found.items()}
        del self.next

    @classmethod
    def of(cls, state: dict) -> "Automaton":
        """From plain data, as it is broadcast."""
        a = cls.__new__(cls)
        a.__dict__ |= state
        return a

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, q, c)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return cur

    def _split(self, p: int, q: int, c: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _holding(self, state: int, size: int) -> int:
        """The state on ``state``'s suffix path whose strings include the suffix of ``size`` words."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans (word numbers, end exclusive, merged) and the items that occur.

        Only stretches of known words as long as the shortest window can hold a
        match; the others are skipped.
        """
        least = self.least
        if not least or len(words) < least:
            return [], set()
        ids = np.fromiter(map(self.vocabulary.get, words, _MINUS), np.int32, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for a, b in known.reshape(-1, 2):
            if b - a >= least:
                self._stream(ids[a:b].tolist(), int(a), spans, items)
        return spans, items

    def _stream(self, ids: list[int], at: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        only_word, only_next, many, link, length, least, found = self.only_word, self.only_next, self.many, self.link, self.length, self.least, self.found
        state = n = 0
        for k, c in enumerate(ids, at + 1):
            while True:
                word = only_word[state]
                to = only_next[state] if word == c else many[state].get(c, -1) if word == -2 else -1
                if to >= 0 or not state:
                    break
                state = link[state]
                n = length[state]
            if to < 0:
                n = 0
                continue
            state, n = to, n + 1
            if n < least:
                continue
            for size in self.sizes:
                if size > n:
                    break
                got = found.get((self._holding(state, size), size))
                if got:
                    items.update(got)
                    if spans and spans[-1][1] >= k - size:
                        spans[-1] = (min(spans[-1][0], k - size), k)
                    else:
                        spans.append((k - size, k))


class _Minus:
    """An endless second argument for ``map``: what an unknown word maps to."""

    def __iter__(self):
        return self

    def __next__(self) -> int:
        return -1


_MINUS = _Minus()


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW):
    """The items in blocks of bounded size, read block by block; long items in overlapping pieces."""
    step = max(1, block_words - window + 1)
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text"))
    for row in rows.toLocalIterator():
        words = words_of(bytes(row["text"]) if row["text"] is not None else None)
        for at in range(0, max(1, len(words) - window + 1), step):
            piece = words[at : at + step + window - 1]
            if block and held + len(piece) > block_words:
                yield block
                block, held = [], 0
            block.append((row["item_id"], piece))
            held += len(piece)
    yield block


SCAN = "doc_id long, copy long, n_words long, spans array<struct<start:int,stop:int>>, item_ids array<string>"


def _shared(spark, block: list, window: int):
    """The automaton of a block, broadcast as plain data."""
    return spark.sparkContext.broadcast(vars(Automaton(block, window)))


def _pass(docs: DataFrame, held, sparse: bool) -> DataFrame:
    def run(batches):
        a = Automaton.of(held.value)
        for batch in batches:
            rows = []
            for doc_id, copy, text in zip(batch["doc_id"].to_pylist(), batch["copy"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                spans, items = a.scan(words)
                if spans or not sparse:
                    rows.append((doc_id, copy, len(words), [{"start": x, "stop": y} for x, y in merged(spans)], sorted({a.ids[k] for k in items} - {None})))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=["doc_id", "copy", "n_words", "spans", "item_ids"])

    return docs.mapInArrow(run, SCAN)


_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])), pa.list_(pa.string())]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (word numbers), item_ids of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("copy"), F.col("text").cast("binary").alias("text"))
    held = [_shared(docs.sparkSession, block, window) for block in item_blocks(benchmark, block_words, window)]
    if len(held) == 1:
        return _pass(texts, held[0], sparse=False).drop("copy")
    # Numbered rows are written first, so that a number is the same row in every pass.
    texts = written(texts, "decontamination-texts")
    every = reduce(DataFrame.unionByName, [_pass(texts, block, sparse=k > 0) for k, block in enumerate(held)])
    together = every.groupBy("doc_id", "copy").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    return together.mapInArrow(_merge_spans, SCAN.replace("copy long, ", ""))


def _merge_spans(batches):
    for batch in batches:
        spans = [[{"start": a, "stop": b} for a, b in merged((s["start"], s["stop"]) for s in row)] for row in batch["spans"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_words"], pa.array(spans, _TYPES[3]), batch["item_ids"]], names=["doc_id", "n_words", "spans", "item_ids"])


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def placed(raw: bytes) -> tuple[list[bytes], list[int]]:
    """The words of ``raw`` and where each begins."""
    low = raw.translate(WORD_BYTES)
    words, at, done = low.split(), [], 0
    for w in words:
        at.append(low.index(w, done))
        done = at[-1] + len(w)
    return words, at


def without(raw: bytes, words: list[bytes], at: list[int], spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without ``spans`` of its words; a line break stands where a span was."""
    parts, done = [], 0
    for a, b in spans:
        parts.append(raw[done : at[a]])
        done = at[b - 1] + len(words[b - 1])
    return b"\n".join([*parts, raw[done:]])


def over(spans: list[tuple[int, int]], n_words: int, max_coverage: float, max_span: int) -> bool:
    """Whether a document with these hit spans is dropped."""
    return sum(b - a for a, b in spans) > max_coverage * n_words or max((b - a for a, b in spans), default=0) > max_span


def cut(text: str, automaton: Automaton, max_coverage: float, max_span: int) -> str | None:
    """``text`` without its hit spans; None if it is over a limit.

    Cutting can bring the two sides of a span together, so it is repeated until
    nothing is hit.  The limits count what the whole text held.
    """
    raw, first = text.encode(), True
    while True:
        words, at = placed(raw)
        spans = merged(automaton.scan(words)[0])
        if first and over(spans, len(words), max_coverage, max_span):
            return None
        if not spans:
            return raw.decode()
        raw, first = without(raw, words, at, spans), False


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, max_span: int = MAX_SPAN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without contamination: spans are cut out, documents over a limit dropped.

    All columns stay; ``n_chars``, if there, is counted anew where a text was cut.
    The result doesn't depend on the blocks the items are in: one block takes one
    pass over the documents; more take a pass each over the documents, and again
    over those that were cut, until nothing is hit.
    """
    bounded_batches(docs.sparkSession)
    held = [_shared(docs.sparkSession, block, window) for block in item_blocks(benchmark, block_words, window)]
    if len(held) > 1:
        return _cut_in_rounds(docs, held, max_coverage, max_span)

    def run(batches, held=held[0]):
        a = Automaton.of(held.value)
        for batch in batches:
            keep, texts, changed = [], [], {}
            for k, text in enumerate(batch["text"].to_pylist()):
                hit = bool(text and a.scan(words_of(text.encode()))[0])
                clean = cut(text, a, max_coverage, max_span) if hit else text
                if hit and clean is None:
                    continue
                keep.append(k)
                texts.append(clean)
                if hit:
                    changed[len(keep) - 1] = len(clean)
            left = batch.take(pa.array(keep, pa.int64()))
            names = left.schema.names
            left = left.set_column(names.index("text"), left.schema.field("text"), pa.array(texts, left.schema.field("text").type))
            if changed and "n_chars" in names:
                counts = left["n_chars"].to_pylist()
                for k, n in changed.items():
                    counts[k] = n
                left = left.set_column(names.index("n_chars"), left.schema.field("n_chars"), pa.array(counts, left.schema.field("n_chars").type))
            yield left

    return docs.mapInArrow(run, docs.schema)


def _cut_in_rounds(docs: DataFrame, held: list, max_coverage: float, max_span: int) -> DataFrame:
    """``cut`` for several blocks: each round merges the spans of all blocks before it cuts.

    Rows are numbered and written first, so that a number is the same row in every pass.
    """
    numbered = written(docs.withColumn("_cut_row", F.monotonically_increasing_id()), "decontamination-rows")
    todo = numbered.select("_cut_row", F.col("text").cast("binary").alias("text"))
    rounds = []
    while True:
        texts = todo.select(F.lit(None).cast("long").alias("doc_id"), F.col("_cut_row").alias("copy"), "text")
        hits = reduce(DataFrame.unionByName, [_pass(texts, block, sparse=True) for block in held])
        spans = hits.groupBy(F.col("copy").alias("_cut_row")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
        limits = None if rounds else (max_coverage, max_span)
        done = written(todo.join(spans, "_cut_row").select("_cut_row", "text", "spans").mapInArrow(_cutter(limits), "_cut_row long, text binary"), "decontamination-round")
        if done.isEmpty():
            break
        rounds.append(done.select("_cut_row", F.lit(len(rounds)).alias("round"), F.col("text").cast("string").alias("text")))
        todo = done.filter("text is not null")
    if not rounds:
        return numbered.drop("_cut_row")
    last = reduce(DataFrame.unionByName, rounds).groupBy("_cut_row").agg(F.max(F.struct("round", "text")).alias("_cut_last"))
    out = numbered.join(last, "_cut_row", "left").filter("_cut_last is null or _cut_last.text is not null")
    hit, text = F.col("_cut_last").isNotNull(), F.col("_cut_last.text")
    new = {"text": F.when(hit, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*docs.columns)


def _cutter(limits: tuple[float, int] | None):
    """Cuts the spans out of each text once; a document over ``limits`` gets null."""

    def run(batches):
        for batch in batches:
            texts = []
            for raw, row in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                words, at = placed(raw)
                spans = merged((s["start"], s["stop"]) for s in row)
                texts.append(None if limits and over(spans, len(words), *limits) else without(raw, words, at, spans))
            yield pa.RecordBatch.from_arrays([batch["_cut_row"], pa.array(texts, pa.binary())], names=["_cut_row", "text"])

    return run


def op1_decontamination(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, load(spark, sf_dir, "benchmark"))
    hit = n_hit()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def brute_force(docs, items, window: int = WINDOW):
    """What the query returns, by comparing every window; for tests."""
    wanted: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_of(None if text is None else text.encode())
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            wanted.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    sizes = {len(w) for w in wanted}
    for doc_id, text in docs:
        words = words_of(None if text is None else text.encode())
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                got = wanted.get(tuple(words[k : k + size]))
                if got:
                    hit.update(range(k, k + size))
                    found |= got
        yield doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def runs(flags) -> list[tuple[int, int]]:
    """Spans of true flags; for tests."""
    out, at = [], 0
    for flag, group in groupby(flags):
        n = len(list(group))
        if flag:
            out.append((at, at + n))
        at += n
    return out
