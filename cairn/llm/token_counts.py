"""Token counts per section by offset-mapped attribution.

A whole document is encoded once with a public byte-level vocabulary.  Its tokens
tile the bytes of the text, so running sums of token lengths are the token spans.
They are joined to the section spans as intervals: both lists are sorted, and each
section boundary finds the token it falls in by binary search.

A token that crosses a boundary is allocated by one explicit rule:
``majority`` (to the section that holds most of its bytes, the earliest on a tie),
``first`` (where it begins) or ``last`` (where it ends).  Bytes outside every
section count for the section named "" (none).

Sections: any (name, start, stop) list in code points, sorted and disjoint; by
default the lines of a text: ``lead`` (the first line, with its line break),
``body`` and ``tail`` (the last line, if there are at least three lines).

Defined cases: a null or empty text has one row, section ``lead``, with no tokens;
repeated rows are counted each for itself; a section without tokens has a row with
0; an empty table gives an empty result; only doc_id and text (and the sections
column, if named) are read, so extra columns can't clash.

The vocabulary file is a parameter and is read on the driver; its ranks (a fixed
size, about a megabyte) are broadcast.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, load

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-token pattern of the vocabulary: fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("majority", "first", "last")
#: Runs of white space this long are encoded without the pattern (the stack of its engine is limited).
LONG_SPACE = 1 << 14
#: White space of the pattern's engine; that of Python has four more characters.
_SPACE = r"[^\S\x1c-\x1f]"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Byte lengths of a text's tokens, in order."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.encoding = tiktoken.Encoding("cairn", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.size[k] = len(token)

    def lengths(self, text: str) -> np.ndarray:
        ids = [np.asarray(self._ids(part), np.int64) for part in pieces(text)]
        return self.size[np.concatenate(ids)] if ids else np.zeros(0, np.int64)


    def _ids(self, part: str):
        if len(part) >= LONG_SPACE and re.fullmatch(f"{_SPACE}+", part):
            return self.encoding._encode_single_piece(part)
        return self.encoding.encode_to_numpy(part, allowed_special=set(), disallowed_special=())


def pieces(text: str, longest: int = LONG_SPACE):
    """``text`` cut at pre-token boundaries only where white space runs on for ``longest`` or more.

    A run of white space is one pre-token up to its last character, which goes
    with the word after it; such a run is a piece of its own, never cut, so the
    pieces have the tokens of the whole text.
    """
    if len(text) < longest:
        if text:
            yield text
        return
    done = 0
    for m in re.finditer(rf"{_SPACE}{{{longest},}}", text):
        if m.start() > done:
            yield text[done : m.start()]
        stop = m.end() - (m.end() < len(text))
        yield text[m.start() : stop]
        done = stop
    if done < len(text):
        yield text[done:]


def line_sections(text: str) -> list[tuple[str, int, int]]:
    first = text.find("\n")
    if first < 0:
        return [("lead", 0, len(text))]
    last = text.rfind("\n", 0, len(text) - 1) if text.endswith("\n") else text.rfind("\n")
    if last <= first:
        return [("lead", 0, first + 1), ("body", first + 1, len(text))]
    return [("lead", 0, first + 1), ("body", first + 1, last + 1), ("tail", last + 1, len(text))]


def attribute(lengths: np.ndarray, bounds: list[tuple[int, int]], rule: str = "majority") -> np.ndarray:
    """Tokens of each byte interval, and last those of none.

    ``bounds``: sorted, disjoint (start, stop) in bytes.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = np.zeros(len(bounds) + 1, np.int64)
    if not len(lengths):
        return counts
    flat = np.array(bounds, np.int64).reshape(-1, 2)
    # Disjoint pieces of the axis, in order: what lies before, in and between the intervals.
    cuts = np.concatenate(([0], flat.ravel(), [max(int(ends[-1]), int(flat[-1, 1]) if len(flat) else 0) + 1]))
    owner = np.full(2 * len(bounds) + 1, len(bounds))
    owner[1::2] = np.arange(len(bounds))
    piece = lambda at: np.searchsorted(cuts, at, side="right") - 1
    a, b = piece(starts), piece(ends - 1)
    if rule == "first":
        chosen = a
    elif rule == "last":
        chosen = b
    else:
        chosen = a.copy()
        for k in np.flatnonzero(a != b):  # at most one token for each boundary
            inside = np.minimum(cuts[a[k] + 1 : b[k] + 2], ends[k]) - np.maximum(cuts[a[k] : b[k] + 1], starts[k])
            chosen[k] = a[k] + int(np.argmax(inside))
    return np.bincount(owner[chosen], minlength=len(bounds) + 1)


COUNTS = "doc_id long, section string, n_chars long, n_bytes long, n_tokens long"


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "majority", sections: str | None = None) -> DataFrame:
    """doc_id, section, n_chars, n_bytes and n_tokens of each section of each row.

    ``sections`` names a column of (name, start, stop) structs; without it the
    lines of the text are used.
    """
    if rule not in RULES:
        raise ValueError(rule)
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches):
        encoder = Encoder(held.value)
        for batch in batches:
            out: list[tuple] = []
            named = batch[sections].to_pylist() if sections else None
            for k, (doc_id, text) in enumerate(zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)):
                text = text or ""
                spans = [(s["name"], s["start"], s["stop"]) for s in named[k] or ()] if named else line_sections(text)
                out += [(doc_id, *row) for row in count_sections(text, spans, encoder, rule)]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "section", "n_chars", "n_bytes", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([sections] if sections else [])).mapInArrow(run, COUNTS)


def count_sections(text: str, spans: list[tuple[str, int, int]], encoder: Encoder, rule: str) -> list[tuple[str, int, int, int]]:
    parts, at, bounds = [], 0, []
    done = 0
    for _, start, stop in spans:
        at += len(text[done:start].encode())
        n = len(text[start:stop].encode())
        parts.append((stop - start, n))
        bounds.append((at, at + n))
        at, done = at + n, stop
    at += len(text[done:].encode())
    counts = attribute(encoder.lengths(text), bounds, rule)
    rows = [(name, chars, size, int(n)) for (name, _, _), (chars, size), n in zip(spans, parts, counts[:-1], strict=True)]
    if counts[-1]:
        rows.append(("", len(text) - sum(c for c, _ in parts), at - sum(n for _, n in parts), int(counts[-1])))
    return rows


def op2_token_counts(spark, sf_dir):
    return section_tokens(load(spark, sf_dir, "documents"))
