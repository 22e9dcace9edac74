"""Small hand-made catalogs: retention, mark and sweep, restorability, writes."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import constants as K
from cairn.operators import availability as av
from cairn.operators import dedup, lifecycle, liveness, validate, writes
from cairn.sources import schemas, stores

DAY = 86400
NOW = 1_750_000_000


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def ids_only(spark, *names):
    return frame(spark, "version_id string", *[(n,) for n in names])


def decide(spark, versions, rules, pinned=(), tagged=(), manifest=(), retired=()):
    """versions: (id, kind, age in seconds)."""
    rows = [(v, "art", kind, "committed", (NOW - age) * 1_000_000, 10) for v, kind, age in versions]
    found = lifecycle.with_kind(frame(spark, "version_id string, artifact_id string, kind string, state string, created_us long, logical_size_bytes long", *rows))
    found = lifecycle.candidates(found, ids_only(spark, *retired), ids_only(spark, *pinned), ids_only(spark, *tagged), ids_only(spark, *manifest))
    all_rules = {k: (0, 0) for k in K.KINDS} | rules
    return lifecycle.decide(found, frame(spark, "artifact_kind string, keep_last_n int, max_age_seconds long", *[(k, *v) for k, v in all_rules.items()]), NOW * 1_000_000)


def reasons(df):
    return {r.version_id: r.reason for r in df.collect()}


def test_rules_by_kind(spark):
    versions = [("g1", None, 9), ("g2", "generic", 5), ("c1", "model-checkpoint", 9), ("c2", "model-checkpoint", 8), ("c3", "model-checkpoint", 7), ("d1", "dataset-snapshot", 2000 * DAY), ("d2", "dataset-snapshot", 60)]
    got = decide(spark, versions, {"generic": (1, None), "model-checkpoint": (2, None), "dataset-snapshot": (0, DAY)})
    assert reasons(got) == {"g1": "policy-retire", "g2": "keep-last-n", "c1": "policy-retire", "c2": "keep-last-n", "c3": "keep-last-n", "d1": "policy-retire", "d2": "age-not-reached"}
    dry, run = lifecycle.stats(got).first(), lifecycle.stats(got, "apply").first()
    assert (dry.scanned, dry.candidates, dry.retired, run.retired, run.retired_bytes) == (7, 3, 0, 3, 30)


def test_protection_and_priority(spark):
    got = reasons(decide(spark, [("t", None, 5), ("m", None, 4), ("f", None, 3)], {}, tagged=["t"], manifest=["m"]))
    assert got == {"t": "tagged", "m": "manifest-referenced", "f": "policy-retire"}
    order = ["candidate", "pinned", "tagged", "manifest", "last"]
    got = reasons(decide(spark, [(v, None, 10 - k) for k, v in enumerate(order)], {"generic": (1, 0)}, pinned=["pinned", "manifest"], tagged=["tagged"], manifest=["manifest"]))
    assert got == {"candidate": "policy-retire", "pinned": "pinned", "tagged": "tagged", "manifest": "pinned", "last": "keep-last-n"}


def test_ties_and_protected_versions_take_a_slot(spark):
    assert reasons(decide(spark, [("b", None, 5), ("a", None, 5)], {"generic": (1, 0)})) == {"a": "keep-last-n", "b": "policy-retire"}
    assert reasons(decide(spark, [("new", None, 1), ("old", None, 2)], {"generic": (1, 0)}, pinned=["new"])) == {"new": "pinned", "old": "policy-retire"}


def test_age_is_strict_and_retired_versions_are_out(spark):
    assert reasons(decide(spark, [("x", None, DAY), ("y", None, DAY - 1), ("z", None, 1)], {"generic": (0, DAY)}, retired=["z"])) == {"x": "policy-retire", "y": "age-not-reached"}


def test_unknown_kind_raises(spark):
    with pytest.raises(Exception, match="invalid artifact kind"):
        decide(spark, [("x", "nonsense", 1)], {}).collect()


def test_pages(spark):
    df = ids_only(spark, "a", "b", "c", "d")
    first = lifecycle.page(df, None, 2).collect()
    assert [r.version_id for r in first] == ["a", "b"] and lifecycle.next_after(first, 2) == "b"
    second = lifecycle.page(df, "b", 2).collect()
    assert lifecycle.next_after(second, 2) == "d" and lifecycle.page(df, "d", 2).collect() == []
    with pytest.raises(ValueError):
        lifecycle.page(df, None, 257)


def snapshot(spark, retired=("v2",), versions=(("v1", "o1"), ("v2", "o2"))):
    layouts = [("l1", "o1"), ("l2", "o2")]
    chunks = [("l1", "shared"), ("l1", "live"), ("l2", "shared"), ("l2", "dead")]
    names = ("shared", "live", "dead")
    return liveness.Snapshot(
        frame(spark, "version_id string, root_object_id string", *versions), ids_only(spark, *retired), frame(spark, "session_id string, finalized_version_id string"), frame(spark, "session_id string, layout_id string"),
        frame(spark, "object_id string", ("o1",), ("o2",)), frame(spark, "layout_id string, object_id string", *layouts), frame(spark, "layout_id string, chunk_id string", *chunks),
        frame(spark, "chunk_id string", *[(c,) for c in names]), frame(spark, "chunk_id string, node_id string", *[(c, "n") for c in names]),
    )


def test_sweep(spark):
    s = snapshot(spark)
    assert {r.chunk_id: r.collectible for r in liveness.classified(frame(spark, "chunk_id string", ("shared",), ("live",), ("dead",), ("stray",)), s).collect()} == {"shared": False, "live": False, "dead": True, "stray": True}
    assert liveness.dry_run_counts(s, "n").first().asDict() == {"locations": 1, "layouts": 1, "objects": 0, "chunks": 0}
    assert liveness.apply_counts(s, "n").first().asDict() == {"locations": 1, "layouts": 1, "objects": 0, "chunks": 1}
    now = liveness.swept(s, "n")
    assert {r.chunk_id for r in now.chunks.collect()} == {"shared", "live"} and {r.chunk_id for r in now.locations.collect()} == {"shared", "live"}
    assert now.objects.count() == 2  # an object whose versions are all retired keeps its row


def test_object_without_version_goes(spark):
    s = snapshot(spark, retired=(), versions=(("v1", "o1"),))
    assert liveness.dry_run_counts(s, "n").first().objects == 0 and liveness.apply_counts(s, "n").first().objects == 1


def test_finalized_session_keeps_a_layout(spark):
    s = snapshot(spark, versions=(("v1", "o1"),), retired=())
    s.sessions, s.finalizations = frame(spark, "session_id string, finalized_version_id string", ("s", "v1")), frame(spark, "session_id string, layout_id string", ("s", "l2"))
    assert {r.layout_id for r in liveness.live_layouts(s).collect()} == {"l1", "l2"}


LOCATION = "chunk_id string, node_id string, state string"


def test_restorable(spark):
    layouts = frame(spark, "layout_id string, object_id string", ("l1", "o"), ("l2", "o"), ("l3", "empty"))
    chunks = frame(spark, "layout_id string, chunk_id string", ("l1", "a"), ("l2", "b"))
    nodes = frame(spark, "node_id string, address string, port int, state string", ("n1", "10.0.0.1", 1, "active"), ("n2", "10.0.0.2", 2, "draining"), ("n3", "10.0.0.3", 3, "disabled"))
    best = lambda *rows: {r.object_id: r.layout_id for r in av.restorable(layouts, chunks, frame(spark, LOCATION, *rows), nodes).collect()}
    assert best(("a", "n1", "available"), ("b", "n2", "available")) == {"o": "l1", "empty": "l3"}
    assert best(("a", "n1", "missing"), ("b", "n2", "available")) == {"o": "l2", "empty": "l3"}
    assert best(("a", "n3", "available"), ("b", "n1", "corrupt")) == {"empty": "l3"}
    located = frame(spark, LOCATION, ("a", "n3", "available"))
    assert {r.object_id for r in av.restorable(layouts, chunks, located, node="n3").collect()} == {"o", "empty"}


def test_replicas(spark):
    desired = frame(spark, "chunk_id string, node_id string", ("a", "n1"), ("a", "n2"))
    located = frame(spark, LOCATION, ("a", "n1", "available"), ("a", "n9", "available"), ("a", "n2", "corrupt"))
    assert [(r.chunk_id, r.node_id) for r in av.under_replicated(desired, located).collect()] == [("a", "n2")]


def test_restore_is_verified(spark):
    import hashlib

    h = lambda b: hashlib.sha256(b).hexdigest()
    plan = frame(spark, "version_id string, chunk_index long, chunk_id string", ("v", 0, h(b"ab")), ("v", 1, h(b"c")), ("w", 0, h(b"zz")))
    store = frame(spark, "chunk_id string, node_id string, content binary", (h(b"ab"), "n1", b"broken"), (h(b"ab"), "n2", b"ab"), (h(b"c"), "n1", b"c"), (h(b"zz"), "n1", b"z"))
    got = {r.version_id: (r.chunks, r.bad_chunks, r.first_bad, r.verified) for r in av.verify_restore(plan, store, frame(spark, "version_id string, root_object_id string", ("v", h(b"abc")), ("w", h(b"zz")))).collect()}
    assert got == {"v": (2, 0, None, True), "w": (1, 1, 0, False)}


def test_finalize_order_of_reasons(spark):
    sessions = frame(spark, "session_id string, state string, version_id string, chunk_size long, finalized_version_id string", ("a", "aborted", "v", 4, None), ("b", "open", "gone", 4, None), ("c", "committed", "v", 4, "v"), ("d", "committed", "v", 4, "x"), ("e", "open", "v", 4, None), ("f", "open", "v", 4, None), ("g", "open", "v", 4, None), ("h", "open", "v", 4, None), ("empty", "open", "v", 4, None))
    sent = frame(spark, "session_id string, chunk_index long, chunk_id string, chunk_size_bytes long", ("e", 0, "x", 3), ("e", 1, "y", 1), ("f", 0, "nope", 4), ("g", 0, "x", 4), ("h", 0, "x", 4), ("h", 1, "x", 3))
    chunks = frame(spark, "chunk_id string, size_bytes long", ("x", 4), ("y", 1))
    got = writes.finalize_outcomes(sessions, sent, chunks, frame(spark, "session_id string, chunk_id string", ("g", "x")), ids_only(spark, "gone"))
    assert {r.session_id: r.outcome for r in got.collect()} == {"a": "session-not-open", "b": "version-retired", "c": "ok", "d": "retry-mismatch", "e": "size-mismatch", "f": "chunk-missing", "g": "under-replicated", "h": "chunk-size-conflict", "empty": "ok"}


def test_finalize_of_content_defined_sessions(spark):
    fields = "session_id string, state string, version_id string, chunk_size long, finalized_version_id string, min_size long, max_size long"
    sessions = frame(spark, fields, *[(s, "open", v, None, None, 4, 9) for s, v in (("a", "v"), ("b", "w"), ("c", "x"), ("d", "v"))], ("e", "open", "y", None, None, None, None))
    sent = frame(spark, "session_id string, chunk_index long, chunk_id string, chunk_size_bytes long", ("a", 0, "x", 6), ("a", 1, "y", 1), ("b", 0, "y", 1), ("b", 1, "x", 6), ("c", 0, "z", 10), ("d", 0, "x", 6), ("e", 0, "x", 6))
    chunks = frame(spark, "chunk_id string, size_bytes long", ("x", 6), ("y", 1), ("z", 10))
    got = writes.finalize_outcomes(sessions, sent, chunks, frame(spark, "session_id string, chunk_id string"), ids_only(spark))
    assert {r.session_id: r.outcome for r in got.collect()} == {"a": "ok", "b": "size-mismatch", "c": "size-mismatch", "d": "ok", "e": "size-mismatch"}
    assert [r.version_id for r in writes.finalized_versions(got, sessions, ids_only(spark, "w")).collect()] == ["v"]
    assert writes.finalized_versions(got, sessions, ids_only(spark, "v")).count() == 0


def test_deleted_chunks(spark, tmp_path):
    import hashlib

    rows = [(hashlib.sha256(bytes([k])).hexdigest(), bytes([k])) for k in range(3)]
    chunks = frame(spark, "chunk_id string, content binary", *rows)
    stores.write_chunks(chunks, str(tmp_path))
    some = frame(spark, "chunk_id string", (rows[0][0],), (rows[0][0],), ("0" * 64,), ("../outside",), (None,))
    assert stores.delete_chunks(some, str(tmp_path)) == 1 and stores.delete_chunks(some, str(tmp_path)) == 0
    assert sorted(r.chunk_id for r in stores.inventory(spark, str(tmp_path)).collect()) == sorted(r[0] for r in rows[1:])
    place = tmp_path / "chunks" / "00" / ("0" * 64)
    place.parent.mkdir(exist_ok=True)
    place.symlink_to(tmp_path / "elsewhere")
    with pytest.raises(Exception, match="is a link"):
        stores.delete_chunks(some, str(tmp_path))


def test_writes(spark):
    old = frame(spark, "k string, v int, at int", ("a", 1, 1), ("b", 1, 1))
    new = frame(spark, "k string, v int, at int", ("b", 2, 2), ("c", 3, 2))
    merged = writes.upsert(old, new, ["k"], "at")
    assert sorted((r.k, r.v) for r in merged.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    assert sorted((r.k, r.v) for r in writes.upsert(merged, new, ["k"], "at").collect()) == [("a", 1), ("b", 2), ("c", 3)]
    once = writes.insert_if_absent(old, new, ["k"])
    assert sorted(map(tuple, writes.insert_if_absent(once, new, ["k"]).collect())) == sorted(map(tuple, once.collect()))
    assert [r.k for r in writes.conflicts(old, new, ["k"], ["v"]).collect()] == ["b"]
    with pytest.raises(Exception, match="key exists"):
        writes.insert(old, new, ["k"]).collect()
    guards = writes.busy(frame(spark, "state string", ("open",)), frame(spark, "state string"), frame(spark, "state string", ("completed",)))
    assert writes.start_outcome(guards, "lifecycle").first().outcome == "open-sessions" and writes.start_outcome(guards, "replication").first().outcome == "ok"


def test_reports(spark):
    rows = frame(spark, "layout_id string, chunk_index long, byte_offset long, chunk_size_bytes long", ("ok", 0, 0, 64), ("ok", 1, 64, 10), ("gap", 0, 0, 64), ("gap", 2, 65, 64))
    assert {r.layout_id: (r.contiguous, r.indexed) for r in validate.layout_report(rows).collect()} == {"ok": (True, True), "gap": (False, False)}
    assert {r.layout_id: r.conforms for r in validate.conformance_report(rows, cdc=(64, 128)).collect()} == {"ok": True, "gap": True}
    assert {r.layout_id: r.conforms for r in validate.conformance_report(rows, 32).collect()} == {"ok": False, "gap": False}
    page = frame(spark, "page string, position int, chunk_id string", ("p", 0, "a"), ("p", 1, "b"), ("q", 0, "b"), ("q", 1, "b"))
    assert [r.page for r in validate.unordered(page, "page", "chunk_id").collect()] == ["q"]
    sets = frame(spark, "session_id string, nodes array<string>, replicas int, target string", ("s", ["a", "b"], 2, "a"), ("t", ["b", "a"], 1, "b"))
    assert {r.session_id: r.valid for r in validate.bad_placements(sets).collect()} == {"s": True, "t": False}
    assert [tuple(r) for r in validate.unready_nodes(sets.limit(1), frame(spark, "node_id string, state string", ("a", "active"), ("b", "draining"))).collect()] == [("s", "b")]


def test_reuse_of_nothing(spark):
    none = frame(spark, "chunk_id string, chunk_size_bytes long")
    assert dedup.reuse_stats(none, none).first().reuse_ratio == 0.0


def policy(kinds, keep=1, name="p", extra=""):
    rules = ",".join(f'{{"artifact_kind":"{k}","keep_last_n":{keep},"max_age_seconds":null{extra}}}' for k in kinds)
    return f'{{"name":"{name}","rules":[{rules}]}}'


@pytest.mark.parametrize(("key", "value", "good"), [("max_age_seconds", '"abc"', False), ("max_age_seconds", "1.5", False), ("max_age_seconds", "true", False), ("max_age_seconds", "null", True), ("max_age_seconds", "60", True), ("keep_last_n", '"1"', False), ("keep_last_n", "1.0", False), ("keep_last_n", "null", False), ("artifact_kind", "5", False)])
def test_policy_values_have_their_types(spark, key, value, good):
    text = policy(K.KINDS)
    rule = {"artifact_kind": '"generic"', "keep_last_n": "1", "max_age_seconds": "null"} | {key: value}
    rest = ",".join(f'{{"artifact_kind":"{k}","keep_last_n":1,"max_age_seconds":null}}' for k in K.KINDS[1:])
    text = '{"name":"p","rules":[{' + ",".join(f'"{k}":{v}' for k, v in rule.items()) + "}," + rest + "]}"
    named = text.replace('"name":"p"', '"name":7')
    got = {r.json: r.valid for r in stores.parse_policies(frame(spark, "json string", (text,), (named,))).collect()}
    assert got == {text: good, named: False}


def test_kinds_without_one_rule_raise(spark):
    found = frame(spark, "version_id string, artifact_id string, artifact_kind string, created_us long, logical_size_bytes long, pinned boolean, tagged boolean, in_manifest boolean", ("a", "x", "generic", 1, 1, False, False, False), ("b", "x", "embedding-index", 1, 1, True, False, False))
    ddl = "artifact_kind string, keep_last_n int, max_age_seconds long"
    for rows in ([("generic", 1, None)], [("generic", 1, None), ("generic", 2, None), ("embedding-index", 1, None)]):
        with pytest.raises(Exception, match="not one rule"):
            lifecycle.decide(found, frame(spark, ddl, *rows), 5).collect()
        assert lifecycle.rule_problems(found, frame(spark, ddl, *rows)).count() == 1


def test_every_reference_is_checked(spark):
    """A child row without its parent is reported for each reference, a null for none."""
    tables = {}
    for name in {t for r in schemas.REFERENCES for t in (r[0], r[2])}:
        columns = sorted({r[1] for r in schemas.REFERENCES if r[0] == name} | {r[3] for r in schemas.REFERENCES if r[2] == name})
        ddl = ", ".join(f"{c} string" for c in columns)
        tables[name] = frame(spark, ddl, tuple(f"{name}.{c}" for c in columns), tuple(None for _ in columns))
    got = {r.reference: r.n for r in validate.dangling(tables).collect()}
    assert got == {f"{c}.{col}": int(f"{c}.{col}" != f"{p}.{key}") for c, col, p, key in schemas.REFERENCES} and len(got) == 32


def test_source_failovers(spark):
    plan = frame(spark, "chunk_id string, good boolean", ("a", False), ("a", True), ("b", False), ("c", True), ("d", False))
    sources = frame(spark, "chunk_id string, node_id string, answer string", ("a", "1", "error"), ("a", "2", "absent"), ("a", "3", "ok"), ("a", "4", "error"), ("b", "1", "error"), ("b", "2", "error"), ("c", "1", "error"))
    assert sorted(map(tuple, av.source_failovers(plan, sources).collect())) == [("a", 1, True), ("b", 2, False), ("d", 0, False)]


def test_policy_files(spark):
    cases = {policy(K.KINDS): True, policy(K.KINDS[:4]): False, policy((*K.KINDS, "generic")): False, policy(K.KINDS, 1001): False, policy(K.KINDS, name=""): False, policy(K.KINDS, extra=',"more":1'): False, "not json": False}
    got = stores.parse_policies(frame(spark, "json string", *[(c,) for c in cases])).collect()
    assert {r.json: r.valid for r in got} == cases


def test_chunk_store(spark, tmp_path):
    import hashlib

    rows = [(hashlib.sha256(bytes([k])).hexdigest(), bytes([k])) for k in range(5)]
    chunks = frame(spark, "chunk_id string, content binary", *rows)
    assert stores.write_chunks(chunks, str(tmp_path)) == 5 and stores.write_chunks(chunks, str(tmp_path)) == 0
    first = rows[0][0]
    for name in (f"{first[:2]}/.{first}.tmp", f"{first[:2]}/short", f"zz/{first}"):
        (tmp_path / "chunks" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "chunks" / name).write_bytes(b"x")
    held = stores.inventory(spark, str(tmp_path))
    assert [r.chunk_id for r in held.collect()] == sorted(r[0] for r in rows)
    assert {r.chunk_id: bytes(r.content) for r in stores.read_chunks(spark, str(tmp_path)).collect()} == dict(rows)
    (tmp_path / "chunks" / first[:2] / first).write_bytes(b"damaged")
    with pytest.raises(Exception, match="corrupt chunk"):
        stores.read_chunks(spark, str(tmp_path)).collect()
    assert stores.removed(held, frame(spark, "chunk_id string", (first,), ("unknown",))).count() == 4
    stores.write_store(chunks, str(tmp_path / "parquet"))
    assert stores.read_store(spark, str(tmp_path / "parquet"), first).count() == 1


def test_schemas(spark):
    assert len(schemas.DDL) == 28 and set(schemas.KEYS) == set(schemas.DDL)
    for name, keys in schemas.KEYS.items():
        assert set(keys) <= set(schemas.schema(name).names)
    for child, column, parent, key in schemas.REFERENCES:
        assert column in schemas.schema(child).names and key in schemas.schema(parent).names


def test_artifact_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    got = stores.read_files(spark, str(tmp_path)).select("object_id", "total_size_bytes", F.col("content")).first()
    assert got.object_id.startswith("ba7816bf") and got.total_size_bytes == 3
    assert stores.to_json(frame(spark, "a int", (1,))).first().json == '{"a":1}'
