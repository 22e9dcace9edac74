"""Cases of the operators that once were left out."""

import hashlib
import time

import numpy as np
import pytest
from cairn.llm import decontamination, jaccard_join, pii, suffix_dedup, token_counts

VALUE = "0123456789abcdef0123456789abcdef01234567"


@pytest.mark.parametrize("cue", ["token", "TOKEN", "Token", "SECRET", "API_KEY", "ApiKey", "Password"])
@pytest.mark.parametrize("form", ['{} = "{}"', '{{"{}": "{}"}}', "'{}' : '{}'", "{}={}"])
@pytest.mark.parametrize("before", ["", "İ ſ K ẞ 😀 "])
def test_secrets_after_cues_in_any_case(cue, form, before):
    text = before + form.format(cue, VALUE) + " end"
    at = text.index(VALUE)
    assert pii.find(text, pii._automaton())["secret"] == [(at, at + len(VALUE))]
    assert pii.redact(text) == text.replace(VALUE, "[secret]")


def test_upper_case_text():
    text = f'NOTE. TOKEN = "{VALUE}" SOCIAL SECURITY 123-45-6789, iBAN DE89 3704 0044 0532 0130 00, A@B.CD'.upper()
    assert pii.redact(text) == 'NOTE. TOKEN = "[secret]" SOCIAL SECURITY [ssn], IBAN [iban], [email]'
    # The Kelvin sign is no k.
    assert pii.find(f"toKen = {VALUE}", pii._automaton())["secret"] == []


LONG = ["1.2.3." + "0" * 5000, "1.2.3." + "0" * 5000 + "255", "0" * 5000 + "1.2.3.4.5.6.7.8.9", "1.2.3." + "9" * 5000, "1.2.3.256.1.2.3.4", "1..2.3.4.5", "a1.2.3.4.", ".1.2.3.4.5.6.7.8", "1.1" + "1" * 6000 + ".2.3", "+1" + " " * 4000 + "2", "4111 1111 1111 1111" + " " * 3000 + "1"]


@pytest.mark.parametrize("text", LONG)
def test_long_numbers(text):
    found = pii.find(text, pii._automaton())
    assert pii.listed(found, pii.BASE) == pii.brute_force(text)


@pytest.mark.parametrize("text", ["1.1" + "1" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "+1 " * 300_000, "a@" * 500_000, "1 " * 500_000, "@" + "b" * 1_000_000, "token " * 150_000])
def test_time_is_linear(text):
    a, began = pii._automaton(), time.process_time()
    pii.find(text, a)
    assert time.process_time() - began < 15


def test_decontamination_does_not_depend_on_blocks(spark):
    """Documents hit by two items, each item a block of its own, in either order."""
    w = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    a, b = w("a", 12), w("b", 12)
    halves = a.split()
    joined = " ".join(halves[:6]) + " " + b + " " + " ".join(halves[6:])
    docs = [
        (1, a + " " + w("x", 8) + " " + b + " " + w("y", 8), 1),  # 12 of 40 words each: over half only together
        (2, a + " " + b + " " + w("x", 100), 2),  # one span of 24 words across both items
        (3, w("x", 50) + " " + joined + " é " + w("y", 50), 3),  # cutting b makes a
        (3, w("x", 50), 4), (4, None, None), (5, w("x", 40) + " " + b, 5),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars int").repartition(3)
    for items in ([a, b], [b, a]):
        bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1)
        kept = {}
        for words in (10, 1000):
            out = decontamination.decontaminate(df, bench, max_span=20, block_words=words)
            assert out.schema == df.schema
            kept[words] = sorted(map(tuple, out.collect()), key=repr)
        assert kept[10] == kept[1000]
        assert sorted(d for d, _, _ in kept[10]) == [3, 3, 4, 5]
        clean = [(d, t) for d, t, _ in kept[10]]
        assert not any(r[5] for r in decontamination.brute_force(clean, list(enumerate(items))))
        assert {n for d, t, n in kept[10] if d == 5} == {len(t) for d, t, _ in kept[10] if d == 5}
    none = spark.createDataFrame([(1, w("p", 12)), (2, w("q", 12))], "item_id long, text string")
    assert decontamination.decontaminate(df, none, block_words=10).count() == len(docs)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_hot_grams_change_no_result(spark, monkeypatch, share):
    """Passages in many surroundings, with none, half or all of the grams taken as hot."""
    import random

    r = random.Random(7)
    passage = "".join(r.choice("abcdefgh ") for _ in range(160))
    texts = []
    for k in range(60):
        a, b = sorted(r.sample(range(161), 2))
        texts.append("".join(r.choice("abc ") for _ in range(r.randrange(80))) + passage[a:b] + "".join(r.choice("xyz ") for _ in range(r.randrange(80))))
    texts += [passage, passage, passage[:49], passage[:50], "", None, "z" * 300, "z" * 120]
    grams = np.unique(np.concatenate([suffix_dedup.contexts_of((t or "").encode(), suffix_dedup.Powers())[2] for t in texts]))
    hot = np.array(sorted(r.sample(grams.tolist(), int(share * len(grams)))), np.uint64)
    monkeypatch.setattr(suffix_dedup, "hot_grams", lambda *a: hot)
    rows = list(enumerate(texts))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = suffix_dedup.brute_force([(d, (t or "").encode()) for d, t in rows])
    assert sorted((x.doc_id, x.n_bytes, x.n_bytes - len(x.kept), len(x.spans), hashlib.sha256(x.kept).hexdigest()) for x in got) == sorted(want)


def test_hot_grams_are_found(spark):
    df = spark.createDataFrame([(k, bytearray(f"{k:06}" + "q" * 900, "ascii")) for k in range(4000)], "doc_id long, text binary")
    assert len(suffix_dedup.hot_grams(df, 1)) >= 1 and len(suffix_dedup.hot_grams(df.limit(0), 4)) == 0


def test_items_longer_than_a_block(spark):
    """Pieces of a long item hold each of its windows once."""
    words = [f"w{k}" for k in range(95)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "just a few"), (3, " ".join(words[50:62]))], "item_id long, text string").coalesce(1)
    rows = [(k, "x y z " + " ".join(words[k : k + 10]) + " q") for k in range(86)] + [(200, "here are just a few words"), (201, " ".join(words)), (202, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {}
    for size in (12, 20, 1000):
        found = decontamination.scan(docs, bench, block_words=size)
        got[size] = sorted((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.item_ids) for r in found.collect())
    assert got[12] == got[20] == got[1000] and sum(bool(r[2]) for r in got[12]) == 88


def test_automaton_size():
    """What is broadcast takes about 41 bytes a word, and 340 in a worker, whose many words occur once."""
    import pickle
    import random
    import tracemalloc

    r = random.Random(1)
    words = [f"v{int(r.paretovariate(0.7))}".encode() for _ in range(60_000)]
    state = pickle.dumps(vars(decontamination.Automaton([(str(k), words[k : k + 300]) for k in range(0, len(words), 300)], 10)))
    tracemalloc.start()
    held = pickle.loads(state)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held and len(state) < 60 * len(words) and size < 450 * len(words)


def test_one_row_for_each_class_where_doc_ids_repeat(spark):
    w = lambda c: " ".join(f"{c}{k}" for k in range(60))
    rows = [
        (1, w("a")), (2, w("b")), (2, w("a") + " more"),  # doc 2: a text of its own, and a near copy of doc 1
        (3, w("c")), (3, w("d")), (3, w("d")), (4, w("d") + "!"),  # doc 3: two classes, one of them with repeats
        (5, "..."), (5, None), (5, "?"), (5, "?"), (6, w("e")), (6, w("e").upper()), (None, w("a")),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.one_of_each(df).collect()), key=repr)
    sixth = [r for r in got if r[0] == 6]
    assert len(sixth) == 1 and sixth[0] in rows
    assert [r for r in got if r[0] != 6] == sorted([(1, w("a")), (2, w("b")), (3, w("c")), (3, w("d")), (5, "..."), (5, None), (5, "?"), (None, w("a"))], key=repr)


@pytest.mark.parametrize("text", ["a " + "\n" * 20_001 + "b", "a" + "\n" * 20_001, " \n" * 9_000 + "\x1c" + "\n" * 16_385 + "b", "\n" * 16_384 + "b", "\n" * 16_384, "x" + "\r\n　" * 7_001 + "\x1f y"])
def test_long_white_space_has_the_tokens_of_the_whole_text(text):
    encoder = token_counts.Encoder(token_counts.read_ranks(token_counts.VOCABULARY))
    assert encoder.lengths(text).tolist() == encoder.size[encoder.encoding.encode(text)].tolist()


def test_white_space_beyond_the_stack_of_the_engine():
    encoder = token_counts.Encoder(token_counts.read_ranks(token_counts.VOCABULARY))
    assert encoder.lengths("a" + " " * 1_000_000 + "b").sum() == 1_000_002
