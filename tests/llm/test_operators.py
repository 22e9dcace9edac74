"""The operators against brute force, round trips and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, connect
from pyspark.sql import functions as F

from cairn.llm import chat_format, decontamination, jaccard_join, language_id, mixing, pii, quality_rules, sharding, suffix_dedup, token_counts
from cairn.llm.queries import oracle_sql, queries

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000
WORDS = "the of and to in that it is was for on with as his they at be this from have or by one had not but".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "ing", "ed", "tion", "er"]) + r.choice("abcdefgh") for _ in range(n))


#: Nulls in every column, empty and long texts, ties and repeated rows.
EDGES = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", len(LONG)), (4, prose(1, 80), "en", "b", 1), (4, prose(1, 80), "en", "b", 1), (5, prose(1, 80), "fr", None, 1),
    (None, "some text without an id", "en", "b", 1), (6, "...", "de", "b", 3), (7, "\n\n\t ", None, "c", 4), (8, "é" * 70, "fr", "c", 70), (9, prose(2, 200), "en", "c", 1), (10, prose(2, 200) + " one more", "en", "c", 1),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def odd(df):
    """The same rows with extra columns whose names operators use themselves."""
    names = ("size", "rate", "copies", "target", "key", "set_id", "spans", "n_words", "fail_bits", "score", "lang_pred", "tag", "shard", "_m", "languages")
    return df.withColumns({n: F.lit("x") for n in names})


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, small, name):
    assert_same(queries()[name](spark, small), connect(small), oracle_sql()[name])


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


# 1. Decontamination.


def test_decontamination_equals_brute_force(spark, small, plain):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    got = sorted(map(tuple, decontamination.op1_decontamination(spark, small).collect()))
    want = sorted(decontamination.brute_force(plain, items))
    assert got == want and any(r[-1] for r in want)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5), st.lists(st.sampled_from("abcd"), max_size=60), st.integers(1, 6))
def test_automaton_equals_brute_force(items, text, window):
    listed = [(str(k), " ".join(x)) for k, x in enumerate(items)]
    a = decontamination.Automaton([(k, decontamination.words_of(t.encode())) for k, t in listed], window)
    spans, found = a.scan([w.encode() for w in text])
    hit = sum(b - x for x, b in decontamination.merged(spans))
    ((_, _, want_hit, want_items, digest, _),) = decontamination.brute_force([(0, " ".join(text))], listed, window)
    assert (hit, len(found)) == (want_hit, want_items)
    assert hashlib.sha256(",".join(sorted(a.ids[k] for k in found)).encode()).hexdigest() == digest


def test_decontamination_in_blocks(spark, edges):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, prose(2, 40)), (3, None), (4, ""), (5, "one more"), (None, "without an id")], "item_id long, text string")
    whole = decontamination.scan(edges, items)
    blocks = decontamination.scan(edges, items, block_words=10)
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_words, [(s.start, s.stop) for s in r.spans], sorted(r.item_ids))
    assert sorted(map(key, whole.collect()), key=repr) == sorted(map(key, blocks.collect()), key=repr)
    assert whole.count() == len(EDGES)


def test_decontaminate_cuts_and_drops(spark, edges, empty):
    item = prose(7, 12)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    mixed = prose(8, 60) + ". " + item + "! " + prose(9, 60)
    df = spark.createDataFrame([(1, mixed, "en", "s", len(mixed)), (2, item + " tail", "en", "s", 1), (3, prose(10, 50), "en", "s", 1), (4, None, None, None, None)], DDL)
    got = {r.doc_id: r for r in decontamination.decontaminate(df, items).collect()}
    assert set(got) == {1, 3, 4} and item not in got[1].text and got[1].n_chars == len(got[1].text) and got[3].text == prose(10, 50)
    assert not decontamination.scan(df.filter("doc_id = 1").select("doc_id", F.lit(got[1].text).alias("text")), items).first().spans
    assert decontamination.decontaminate(edges, items.limit(0)).count() == len(EDGES)
    assert decontamination.decontaminate(empty, items).count() == 0 and decontamination.scan(empty, items).count() == 0


# 2. Token counts.


def test_tokens_are_counted_once(spark, small, plain):
    encoder = token_counts.Encoder(token_counts.read_ranks(token_counts.VOCABULARY))
    got = {}
    for r in token_counts.op2_token_counts(spark, small).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.n_chars, r.n_bytes, r.n_tokens)
    for doc_id, text in plain:
        sections = token_counts.line_sections(text)
        # Token by token: the section that holds most bytes, the earliest on a tie.
        raw, bounds, at = text.encode(), [], 0
        for _, a, b in sections:
            n = len(text[a:b].encode())
            bounds.append((at, at + n))
            at += n
        want, at = dict.fromkeys((s[0] for s in sections), 0), 0
        for t in encoder.encoding.encode_ordinary(text):
            n = len(encoder.encoding.decode_single_token_bytes(t))
            inside = [max(0, min(at + n, y) - max(at, x)) for x, y in bounds]
            want[sections[inside.index(max(inside))][0]] += 1
            at += n
        assert at == len(raw) and {k: v[2] for k, v in got[doc_id].items()} == want


def test_token_rules():
    lengths, bounds = np.array([3, 4, 3]), [(0, 4), (4, 8)]
    count = lambda rule: token_counts.attribute(lengths, bounds, rule).tolist()
    assert count("first") == [2, 1, 0] and count("last") == [1, 1, 1] and count("majority") == [1, 1, 1]
    assert token_counts.attribute(np.array([2]), [(0, 1), (1, 2)], "majority").tolist() == [1, 0, 0]
    assert token_counts.attribute(np.array([2, 2]), [(1, 1), (1, 3)], "first").tolist() == [0, 1, 1]


def test_token_edges(spark, edges, empty):
    got = token_counts.section_tokens(odd(edges))
    assert got.filter("doc_id = 1").first()[1:] == ("lead", 0, 0, 0)
    assert got.filter("doc_id = 7").agg(F.sum("n_chars")).first()[0] == 4
    assert token_counts.section_tokens(empty).count() == 0
    spaces = " " * 100_000 + "x"
    assert "".join(token_counts.pieces(spaces)) == spaces
    named = edges.filter("doc_id = 9").withColumn("parts", F.expr("array(named_struct('name', 'head', 'start', 0, 'stop', 10))"))
    assert {r.section for r in token_counts.section_tokens(named, sections="parts").collect()} == {"head", ""}
    with pytest.raises(ValueError):
        token_counts.section_tokens(edges, rule="other")


# 3. Quality rules.


def brute_repeats(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    return len({k + o for ks in seen.values() if len(ks) > 1 for k in ks for o in range(3)})


def test_repeat_words(spark):
    r = random.Random(5)
    texts = [None, "", "a b c", "a b c a b c", "a a a a", LONG[:5000]] + [" ".join(r.choice("abcd") for _ in range(r.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x.n_repeat_words for x in quality_rules.ledger(df).collect()}
    assert got == {k: brute_repeats(t) for k, t in enumerate(texts)}


def test_ledger_policies_and_ablations(spark, edges, empty):
    book = quality_rules.ledger(odd(edges))
    assert book.count() == len(EDGES) and "text" not in book.columns
    rows = book.collect()
    assert next(r for r in rows if r.doc_id == 1).n_words == 0
    for r in quality_rules.ablations(book).collect():
        mask = quality_rules.policy_mask(quality_rules.POLICIES[r.policy])
        bit = quality_rules.policy_mask([r.rule])
        fails = [x.fail_bits & mask for x in rows]
        assert r.n_failed == sum(bool(f & bit) for f in fails) and r.n_only_this == sum(f == bit for f in fails)
        assert r.n_kept == sum(f == 0 for f in fails) and r.n_kept_without == sum(f & ~bit == 0 for f in fails)
    assert quality_rules.ablations(quality_rules.ledger(empty)).count() == 0


# 4. Chat formatting.


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip(spark):
    r = random.Random(3)
    rows = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (1, 0, None, None), (2, 0, "sys<tem>", "\\l<turn user>"), (2, 0, "a", "b"), (2, 0, "a", "b"), (None, 1, "user", "x")]
    for conv in range(10, 20):
        rows += [(conv, t, "system" if t == 0 and conv % 2 else r.choice(["user", "assistant"]), r.choice(["", "é", "\\", "<", "ab "]) * r.randint(0, 900)) for t in range(r.randint(1, 25))]
    df = spark.createDataFrame(rows, TURNS)
    for arguments in ({}, {"budget": 60, "history_tokens": 0, "history_turns": 0}, {"budget": 200, "history_tokens": 50, "history_turns": 2}):
        made = chat_format.windows(df, **arguments).cache()
        got = {x.conv_id: x for x in chat_format.read_back(made).collect()}
        by = {}
        for row in rows:
            by.setdefault(row[0], []).append((row[1], row[2] or "", row[3] or ""))
        assert set(got) == set(by)
        for conv, turns in by.items():
            turns.sort()
            assert got[conv].turns_text == "".join(f"{role}\n{text}\n" for _, role, text in turns) and got[conv].n_turns == len(turns)
            assert got[conv].loss_text == "".join(text for _, role, text in turns if role == "assistant")
        budget = arguments.get("budget", chat_format.BUDGET)
        for w in made.collect():
            assert w.tokens <= budget or (w.over_budget and w.n_turns == 1)
            assert w.n_history <= arguments.get("history_turns", chat_format.HISTORY_TURNS)
        for conv in range(11, 20, 2):
            assert all(w.formatted.startswith("<turn system>") for w in made.filter(F.col("conv_id") == conv).collect())
        made.unpersist()
    assert chat_format.windows(df.limit(0)).count() == 0


# 5. Jaccard join.


def families(n=12):
    out, k = [], 0
    for f in range(n):
        base = prose(100 + f, 120).split()
        out.append((k, " ".join(base)))
        k += 1
        for c in range(f % 5):
            copy = list(base)
            for _ in range(c):
                copy[random.Random(f * 10 + c).randrange(len(copy))] = f"edit{c}"
            out.append((k, " ".join(copy)))
            k += 1
    return [*out, (k, None), (k + 1, ""), (k + 2, "three short words"), (k + 3, "Three short words!"), (k + 4, "...")]


@pytest.mark.parametrize("limit", [512, 3])
def test_jaccard_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(jaccard_join, "LIMIT", limit)
    rows = families()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.link_classes(df).collect()))
    assert got == sorted(jaccard_join.brute_force(rows))


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Families around a common text, loose (similar by half), dense (by 0.85) and close (0.97), in buckets far over the limit."""
    monkeypatch.setattr(jaccard_join, "LIMIT", 8)
    rows, r = [], random.Random(3)
    for name, n, edits in (("loose", 70, 12), ("dense", 60, 2), ("close", 50, 1)):
        base = prose(name, 160 if name != "close" else 400).split()
        for c in range(n):
            copy = list(base)
            for _ in range(edits if c % 3 else edits // 2):
                copy[r.randrange(len(copy))] = f"{name}{r.randrange(40)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(1000 + k, f"a b c d {k} " * (1 + k % 2)) for k in range(30)]  # small sets that share most of their shingles
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(jaccard_join.brute_force(rows))
    assert sum(n for _, _, n in want) > 1000
    assert sorted(map(tuple, jaccard_join.link_classes(df).collect())) == want


def test_jaccard_recall_on_all_documents(spark):
    """Every link of the documents at sf0.01 is found: recall 1.0 against brute force."""
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(jaccard_join.brute_force(rows))
    got = sorted(map(tuple, jaccard_join.link_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == want and sum(n for _, _, n in want) > 100


@pytest.mark.parametrize("piece", [16, 1 << 22])
def test_word_hashes_tell_words_apart(monkeypatch, piece):
    monkeypatch.setattr(jaccard_join, "PIECE", piece)
    text = (prose(5, 300) + " Écu Ünder AB ab 12 a-b " + "x" * 100 + "  ").encode()
    words = decontamination.words_of(text)
    hashes = jaccard_join.word_hashes(text, jaccard_join.Powers()).tolist()
    assert len(hashes) == len(words)
    assert len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))
    assert jaccard_join.word_hashes(b" - ", jaccard_join.Powers()).tolist() == []


def test_jaccard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = prose(55, 150).split()
    rows = [(k, " ".join([*base[:k], f"edit{k}", *base[k + 1 :]])) for k in range(0, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_join.link_classes(df).collect())) == sorted(jaccard_join.brute_force(rows))


def test_jaccard_edges(spark, edges, empty):
    got = jaccard_join.link_classes(odd(edges)).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: (r.class_id, r.n_links) for r in got}
    assert by[4] == (4, 2) and by[5] == (4, 2) and by[10] == (9, 1) and by[1] == (1, 0)
    assert jaccard_join.link_classes(empty).count() == 0
    kept = [r.doc_id for r in jaccard_join.one_of_each(edges).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, None, 6, 7, 8, 9], key=str)


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)]
    union = jaccard_join._Union(1100)
    for a, b in pairs:
        union.join(a, b)
    got = {x.id: x.root for x in jaccard_join.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: union.root(x) for a, b in pairs if a != b for x in (a, b)}


# 6. Mixing.


def test_mixing(spark, small, edges, empty):
    found = mixing.op6_mixing(spark, small).collect()
    sized = spark.read.parquet(f"{small}/documents.parquet").withColumn("size", mixing.word_count("text"))
    assert sum(r.target for r in mixing.source_rates(sized).collect()) == pytest.approx(sum(r.size for r in found))
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in found)
    assert sorted(map(tuple, mixing.op6_mixing(spark, small).collect())) == sorted(map(tuple, found))
    planned = mixing.plan_mix(odd(edges)).collect()
    assert len(planned) == len(EDGES) and mixing.mix(empty).count() == 0 and mixing.mix(odd(edges)).columns == odd(edges).columns
    assert mixing.mix(edges).count() == sum(r.copies for r in planned)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=7))
def test_targets_fill_up(spark, sizes):
    rows = [(f"s{k}", n) for k, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.source_rates(spark.createDataFrame(rows, "source string, size long")).collect()}
    weights = {f"s{k}": mixing.WEIGHTS[k % 3] for k in range(len(sizes))}
    fixed, left = {}, dict(rows)
    while True:  # share, stop at three times, share the excess again
        rest = sum(sizes) - sum(fixed.values())
        w = sum(weights[s] for s in left)
        over = [s for s in left if rest * weights[s] / w > 3 * left[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 3 * left.pop(s)
    want = fixed | {s: rest * weights[s] / w for s in left}
    assert got == pytest.approx(want)


# 7. Repeated strings.


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=200).map(lambda b: bytes(1 + c % 3 for c in b)), st.sampled_from([2, 5, 11]))
def test_interval_classes(raw, length):
    order, cls = suffix_dedup.interval_classes(np.frombuffer(raw, np.uint8), length)
    seen = {}
    for p, c in zip(order.tolist(), cls.tolist(), strict=True):
        if p + length <= len(raw):
            assert seen.setdefault(raw[p : p + length], c) == c
    assert len(set(seen.values())) == len(seen)


def brute(df_rows):
    return sorted(suffix_dedup.brute_force([(d, (t or "").encode()) for d, t in df_rows]))


def digest(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)


def test_repeats_equal_brute_force(spark, small, plain):
    assert sorted(map(tuple, suffix_dedup.op7_suffix_dedup(spark, small).collect())) == brute(plain)


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_repeats_planted(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "SLICE", limit)
    monkeypatch.setattr(suffix_dedup, "FLUSH", limit)
    r = random.Random(11)
    passages = [prose(k, 15)[: r.randint(45, 80)] for k in range(6)] + ["ab" * 60, "z" * 130, "é" * 40]
    rows = [(k, "".join(r.choice([prose(r.randrange(10**6), 4), r.choice(passages), r.choice(passages)[3:]]) for _ in range(r.randint(0, 8)))) for k in range(60)]
    rows += [(60, None), (61, ""), (7, rows[3][1]), (7, rows[7][1])]
    assert digest(spark, rows) == brute(rows)


def test_repeats_edges(spark, edges, empty):
    got = suffix_dedup.remove_repeats(odd(edges)).collect()
    assert len(got) == len(EDGES) and suffix_dedup.remove_repeats(empty).count() == 0
    assert bytes(next(r for r in got if r.doc_id is None).kept) == b"some text without an id"


# 8. Sharding.


def check_shards(rows, texts, n=8):
    place = {}
    for r in rows:
        assert place.setdefault(texts[r.doc_id], r.shard) == r.shard
    for s in range(n):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sharding(spark, small, plain):
    rows = sharding.op8_sharding(spark, small).collect()
    texts = dict(plain)
    check_shards(rows, texts)
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {d: (len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in plain}
    groups = {}
    for d, t in plain:
        g = groups.setdefault(t, [d, 0])
        g[0], g[1] = min(g[0], d), g[1] + len(t.encode()) + 1
    sizes = [n for _, n in sorted(groups.values())]
    load = [sum(r.size for r in rows if r.shard == s) for s in range(8)]

    def fits(capacity):
        shards, held = 1, 0
        for n in sizes:
            shards, held = (shards, held + n) if held + n <= capacity else (shards + 1, n)
        return shards <= 8

    least = next(c for c in range(max(max(sizes), sum(sizes) // 8), sum(sizes) + 1) if fits(c))
    assert max(load) == least


@pytest.mark.parametrize("chunks", [4, 1 << 18])
def test_cuts_of_any_sizes(spark, chunks):
    r = random.Random(chunks)
    for _ in range(4):
        ends = np.cumsum([r.choice([1, 2, 50, 400]) for _ in range(r.randint(1, 60))]).tolist()
        prefix = sharding.Prefix(spark.createDataFrame([(e,) for e in ends], "end long"), chunks)
        capacity, cuts = sharding.minimax_cuts(prefix, 5)
        sizes = np.diff([0, *cuts]).tolist()
        assert cuts[-1] == ends[-1] and set(cuts) <= {0, *ends} and max(sizes) <= capacity
        step = [b - a for a, b in zip([0, *ends[:-1]], ends, strict=True)]

        def shards(capacity, step=step):
            n, held = 1, 0
            for x in step:
                n, held = (n, held + x) if held + x <= capacity else (n + 1, x)
            return n

        assert shards(capacity) <= 5 and (capacity == max(step) or shards(capacity - 1) > 5)


def test_sharding_edges(spark, edges, empty):
    rows = sharding.shard(odd(edges)).collect()
    assert len(rows) == len(EDGES) and sharding.shard(empty).count() == 0
    assert len({r.shard for r in rows if r.doc_id in (4, 5)}) == 1


# 9. Personal data.


def test_pii_equals_brute_force(spark, small, plain):
    got = {r.doc_id: r.base_sha256 for r in pii.op9_pii(spark, small).collect()}
    assert got == {d: pii.digest(pii.brute_force(t)) for d, t in plain}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1249.@-+ ()%é0", max_size=70))
def test_pii_scans_like_the_patterns(text):
    assert pii.listed(pii.find(text, pii._automaton()), pii.BASE) == pii.brute_force(text)


def test_pii_added_kinds():
    a = pii._automaton()
    text = "IBAN DE89 3704 0044 0532 0130 00, ssn: 123-45-6789, http://me:pw@host.com token = abcdefabcdefabcdef01"
    found = pii.find(text, a)
    assert [text[x:y] for x, y in found["iban"]] == ["DE89 3704 0044 0532 0130 00"] and [text[x:y] for x, y in found["ssn"]] == ["123-45-6789"]
    assert [text[x:y] for x, y in found["login"]] == ["me:pw@host.com"] and len(found["secret"]) == 1
    assert pii.redact("write to a@b.cd now") == "write to [email] now" and pii.redact(None) is None
    assert pii.find("9" * 5000 + ".1.1.1", a)["ip"] == []


def test_pii_edges(edges, empty):
    assert pii.detect(odd(edges)).count() == len(EDGES) and pii.detect(empty).count() == 0


# 10. Language.


def test_language_accuracy(spark):
    rows = language_id.op10_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixture(spark, docs):
    model = language_id.fit(docs)
    by = {}
    for r in docs.filter("n_chars > 2000").collect():
        by.setdefault(r.lang, r.text)
    both = by["en"][:1500] + " " + by["fr"][:1500]
    df = spark.createDataFrame([(1, both), (2, by["de"])], "doc_id long, text string")
    got = {r.doc_id: {x.lang: x.share for x in r.languages} for r in language_id.predict(df, model).collect()}
    assert set(got[1]) == {"en", "fr"} and min(got[1].values()) > 0.3 and set(got[2]) == {"de"}


def test_language_equals_brute_force(spark, docs):
    """Selected sets and shares of all documents, some of them mixed, against plain expectation-maximisation."""
    counts = {}
    for r in docs.filter(~language_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect():
        of = counts.setdefault(r.lang, {})
        for g in language_id.trigrams(r.text).tolist():
            of[g] = of.get(g, 0) + 1
    texts = [r.text for r in docs.collect()]
    rows = [*enumerate(texts), *[(1000 + k, (texts[k] or "")[:900] + " " + (texts[-k - 1] or "")[:900]) for k in range(40)]]
    got = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string"), language_id.fit(docs)).collect()}
    several = 0
    for k, text in rows:
        want = language_id.brute_force(text, counts)
        shares = {x.lang: x.share for x in got[k].languages}
        assert set(shares) == set(want) and all(abs(shares[x] - want[x]) < 1e-3 for x in want), k
        assert got[k].lang_pred == (min(want, key=lambda x: (-round(want[x], 6), x)) if want else "und")
        several += len(want) > 1
    assert several >= 10


def test_many_languages(spark, monkeypatch):
    """129 languages are learned, in two blocks; a text in two of them, of different blocks, is told apart."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k, n: "".join(random.Random(k * 1000 + n).choice(letters) for _ in range(6))
    text = lambda k: " ".join(word(k, n % 40) for n in range(200))
    rows = [(k, text(k), f"l{k:03}") for k in range(129)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [len(names) for names, _ in model] == [128, 1]
    docs = spark.createDataFrame([*[(k, text(k)) for k in range(0, 129, 8)], (500, text(3) + " " + text(128)), (501, None)], "doc_id long, text string")
    got = {r.doc_id: {x.lang for x in r.languages} for r in language_id.predict(docs, model).collect()}
    assert got == {**{k: {f"l{k:03}"} for k in range(0, 129, 8)}, 500: {"l003", "l128"}, 501: set()}


def test_language_edges(spark, edges, empty, docs):
    model = language_id.fit(docs)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(odd(edges), model).collect()}
    assert [got[k] for k in (1, 2, 6, 7)] == ["und"] * 4 and got[9] != "und"
    assert language_id.predict(empty, model).count() == 0
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(edges, none).collect()} == {"und"}
