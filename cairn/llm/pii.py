r"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, digits joined as in addresses
and card numbers, plus signs before digits, schemes, identifier cues) in one pass
over a text.  A deterministic local parser expands each anchor to the stretch of
characters its kind can hold, and validates what it finds there.  A match never
leaves such a stretch and leftmost matches of different stretches don't touch
each other, so parsing the stretches gives what a scan of the whole text would.

Base kinds: email, ip (parts up to 255), card (16 to 19 digits, Luhn), phone (8 to
15 digits).  Added kinds: iban (country, length and mod 97), ssn (after a cue),
login (user and password in a URL), secret (a value of 16 or more after a cue such
as ``token =`` or ``"token":``).  Cues are found in upper, lower and mixed case.

Spans are in code points, end exclusive.  Time is linear in the length of a text,
also for long runs of digits, and numbers of any length are compared as text.
Defined cases: null and empty texts
have none; repeated rows are scanned each for itself; an empty table gives an
empty result; only doc_id and text are read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, load

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "login", "secret")
KINDS = BASE + ADDED

_DIGITS = "0123456789"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Digit groups joined by single dots; it never fails once begun, so runs of digits are read once.
_GROUPS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_IP_RUN = re.compile(r"[0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_CARD_RUN = re.compile(r"[0-9\x20-]*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PHONE_RUN = re.compile(r"[+\x20().0-9-]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOGIN = re.compile(r"[^\s:@/]+:[^\s:@/]+@[A-Za-z0-9.-]+")
_SECRET = re.compile(r"[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_\-+/=]{16,})")
#: Cues, in lower case as they are looked for, and how far after one its value may begin.
_IBAN_CUES = ("iban",)
_SSN_CUES = ("ssn", "social security")
_SECRET_CUES = ("token", "secret", "api_key", "apikey", "password")
_REACH = 12


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for x in _DIGITS:
        a.add_word("+" + x, ("phone", 2))
        for y in _DIGITS:
            a.add_word(f"{x}.{y}", ("ip", 3))
            for join in ("", " ", "-"):
                a.add_word(x + join + y, ("card", 2 + len(join)))
    a.add_word("://", ("login", 3))
    for kind, cues in (("iban", _IBAN_CUES), ("ssn", _SSN_CUES), ("secret", _SECRET_CUES)):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def _folded(text: str) -> str:
    """``text`` with A-Z in lower case and every other character, so every position, as it was."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = int(x) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _n_digits(s: str) -> int:
    return sum(map(s.count, _DIGITS))


def _below_256(part: str) -> bool:
    """Compared as text: a group may have more digits than a number is made of."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _ips(text: str, begin: int, end: int):
    """Spans of four groups each, from the left of every chain of groups, whose groups are at most 255."""
    for chain in _GROUPS.finditer(text, begin, end):
        parts, at = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(map(_below_256, four)):
                yield at, at + size
            at += size + 1


def _cards(text: str, begin: int, end: int):
    return (m.span() for m in _CARD.finditer(text, begin, end) if _card_ok(m[0]))


def _phones(text: str, begin: int, end: int):
    return (m.span() for m in _PHONE.finditer(text, begin, end) if _phone_ok(m[0]))


def _card_ok(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(s: str) -> bool:
    return 8 <= _n_digits(s) <= 15


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: Kind -> characters of its stretches, stretch and parser.
_RUNS = {
    "ip": (frozenset(_DIGITS + "."), _IP_RUN, _ips),
    "card": (frozenset(_DIGITS + " -"), _CARD_RUN, _cards),
    "phone": (frozenset(_DIGITS + "+ ().-"), _PHONE_RUN, _phones),
}


def find(text: str | None, automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    done = dict.fromkeys(KINDS, 0)
    for at, (kind, size) in automaton.iter(_folded(text)):
        stop = at + 1
        start = stop - size
        if start < done[kind] and kind != "email":
            continue
        if kind == "email":
            begin = at
            while begin > done[kind] and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at and at >= done[kind] and (m := _DOMAIN.match(text, stop)):
                out[kind].append((begin, m.end()))
                done[kind] = m.end()
        elif kind in _RUNS:
            chars, stretch, parse = _RUNS[kind]
            begin = start
            while begin > done[kind] and text[begin - 1] in chars:
                begin -= 1
            end = stretch.match(text, start).end()
            out[kind] += parse(text, begin, end)
            done[kind] = end
        elif kind == "login":
            if m := _LOGIN.match(text, stop):
                out[kind].append(m.span())
                done[kind] = m.end()
        elif kind == "secret":
            if m := _SECRET.match(text, stop):
                out[kind].append(m.span(1))
                done[kind] = m.end()
        else:
            pattern = _IBAN if kind == "iban" else _SSN
            m = pattern.search(text, stop, stop + _REACH + 48)
            if m and m.start() <= stop + _REACH:
                end = m.end()
                if kind == "iban":
                    while end > m.start() and not _iban_ok(text[m.start() : end]):
                        end -= 1
                    if end == m.start():
                        continue
                out[kind].append((m.start(), end))
                done[kind] = end
    return out


def listed(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


DETECT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, a count of each base kind, base_spans and spans (``kind:start:end``, by kind, then start)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        a = _automaton()
        for batch in batches:
            found = [find(t, a) for t in batch["text"].to_pylist()]
            counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *counts, pa.array([listed(f, BASE) for f in found], pa.string()), pa.array([listed(f) for f in found], pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DETECT)


def redact(text: str | None, automaton=None) -> str | None:
    """``text`` with each span replaced by its kind in brackets."""
    if not text:
        return text
    spans = sorted((a, b, k) for k, found in find(text, automaton or _automaton()).items() for a, b in found)
    parts, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            parts += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*parts, text[done:]])


def op9_pii(spark, sf_dir):
    found = detect(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def brute_force(text: str | None) -> str:
    """Base spans by scanning the whole text with the plain patterns; for tests."""
    text = text or ""
    patterns = {
        "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
        "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p[-4300:]) <= 255 and not p[:-4300].strip("0") for p in s.split("."))),
        "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 16 <= _n_digits(s) <= 19 and luhn(re.sub("[ -]", "", s))),
        "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 8 <= _n_digits(s) <= 15),
    }
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, (p, good) in patterns.items() for m in p.finditer(text) if good(m[0]))


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
