"""Versioned tables: merges touch few parts, replays change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from sedimenta import store
from sedimenta.contracts import tree_of
from sedimenta.operators import merge as m
from sedimenta.store import VersionedTable

COLUMNS = tree_of("k bigint, v bigint, h string, lo bigint, hi bigint")


def table(spark, path, **kw):
    return VersionedTable(spark, str(path), COLUMNS, ["k"], buckets=4, **kw)


def rows(spark, data):
    return spark.createDataFrame(data, "k bigint, v bigint, h string, lo bigint, hi bigint")


def newer():
    return m.newer_and_different(list(COLUMNS), ["k"], "v", "h")


def state(t):
    return sorted(tuple(r) for r in t.read().collect())


def test_merge_replay_commits_nothing(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    first = rows(spark, [(1, 1, "a", 0, 0), (2, 1, "b", 0, 0)])
    assert t.merge(first, newer()) == {"inserted": 2, "updated": 0, "deleted": 0}
    before, version = state(t), t.version().number
    assert t.merge(first, newer()) == {"inserted": 0, "updated": 0, "deleted": 0}
    assert (state(t), t.version().number) == (before, version)


def test_merge_touches_only_its_parts(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(rows(spark, [(k, 1, "a", 0, 0) for k in range(40)]), newer())
    before = dict(t.version().parts)
    t.merge(rows(spark, [(7, 2, "b", 0, 0)]), newer())
    after = t.version().parts
    assert sum(before[p] != after[p] for p in before) == 1
    assert dict((r[0], r[2]) for r in state(t))[7] == "b"


def test_source_with_repeated_key_is_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="several rows"):
        table(spark, tmp_path / "t").merge(rows(spark, [(1, 1, "a", 0, 0), (1, 2, "b", 0, 0)]), newer())


def test_order_of_batches_does_not_matter_for_spans(spark, tmp_path):
    spec = m.span_and_profile(["k"], "v", profile=["h"], first="lo", last="hi")
    rng = random.Random(3)
    batches = [[(k, 10 * b + k % 3, f"h{b}", rng.randrange(50), rng.randrange(50, 99)) for k in range(5)] for b in range(3)]
    states = []
    for i, order in enumerate(([0, 1, 2], [2, 0, 1])):
        t = table(spark, tmp_path / f"t{i}")
        for b in order:
            t.merge(rows(spark, batches[b]), spec)
        states.append(state(t))
    assert states[0] == states[1]


def test_replace_parts_with_nothing_and_new_columns(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), tree_of("b string, x bigint"), ["x"], part_by=["b"])
    t.replace_parts(spark.createDataFrame([("one", 1), ("one", 2)], "b string, x bigint"), ["one"])
    t.replace_parts(spark.createDataFrame([("two", 3, "new")], "b string, x bigint, y string"), ["two"], new_columns={"y": "string"})
    assert sorted((r.b, r.x, r.y) for r in t.read().collect()) == [("one", 1, None), ("one", 2, None), ("two", 3, "new")]
    t.replace_parts(spark.createDataFrame([], "b string, x bigint"), ["one"])
    assert [r.x for r in t.read().collect()] == [3]
    with pytest.raises(ValueError, match="outside"):
        t.replace_parts(spark.createDataFrame([("odd", 9)], "b string, x bigint"), ["two"])


def test_time_travel_compact_and_vacuum(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(rows(spark, [(1, 1, "a", 0, 0)]), newer())
    t.merge(rows(spark, [(1, 2, "b", 0, 0)]), newer())
    assert [r.h for r in t.read(1).collect()] == ["a"]
    t.compact(["k"])
    assert [r.h for r in t.read().collect()] == ["b"]
    assert t.merge(rows(spark, [(1, 3, "c", 0, 0), (2, 1, "d", 0, 0)]), newer()) == {"inserted": 1, "updated": 1, "deleted": 0}
    assert t.key_faults() == 0
    assert t.vacuum(1) >= 2
    assert sorted(r.h for r in t.read().collect()) == ["c", "d"]


def test_merge_after_compaction_touches_only_its_parts(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(rows(spark, [(k, 1, "a", 0, 0) for k in range(40)]), newer())
    t.compact(["lo"])
    before = dict(t.version().parts)
    assert set(before) <= {"0", "1", "2", "3"}
    t.merge(rows(spark, [(7, 2, "b", 0, 0)]), newer())
    after = t.version().parts
    assert sum(before[p] != after[p] for p in before) == 1 and t.key_faults() == 0 and t.read().count() == 40


def test_a_table_that_outgrew_its_buckets_gets_more(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    t.merge(rows(spark, [(k, 1, "a", 0, 0) for k in range(40)]), newer())
    monkeypatch.setattr(store, "PART_BYTES", t.size() // 7)
    t.compact(["k"])
    assert t.version().buckets == 8 and len(t.version().parts) > 4
    assert t.merge(rows(spark, [(k, 2, "b", 0, 0) for k in range(38, 42)]), newer()) == {"inserted": 2, "updated": 2, "deleted": 0}
    assert t.read().count() == 42 and t.key_faults() == 0


def test_sync_writes_only_parts_that_differ(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    spec = m.full_sync(list(COLUMNS), ["k"], "h")
    data = [(k, 1, "a", 0, 0) for k in range(40)]
    assert t.merge(rows(spark, data), spec)["inserted"] == 40
    before, number = dict(t.version().parts), t.version().number
    assert t.merge(rows(spark, data), spec) == {"inserted": 0, "updated": 0, "deleted": 0} and t.version().number == number
    assert t.merge(rows(spark, data[:-1]), spec) == {"inserted": 0, "updated": 0, "deleted": 1}
    after = t.version().parts
    assert sum(before[p] != after.get(p) for p in before) == 1 and t.read().count() == 39


def test_the_source_of_a_merge_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def mark(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t = table(spark, tmp_path / "t")
    t.merge(rows(spark, [(k, 1, "a", 0, 0) for k in range(9)]).mapInArrow(mark, "k bigint, v bigint, h string, lo bigint, hi bigint"), newer())
    assert seen.value == 9 and t.read().count() == 9


def test_the_log_does_not_grow_with_the_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SNAPSHOT_EVERY", 3)
    t = table(spark, tmp_path / "t")
    for i in range(7):
        t.append(rows(spark, [(i, 1, "a", 0, 0)]))
    sizes = [len(t.files.read(f"{t.path}/_log/{n:08d}.json")) for n in t.versions()]
    assert max(sizes) - min(sizes) < 20
    assert [t.read(n).count() for n in t.versions()] == list(range(1, 8)) == [len(v.parts) for v in t.history()]
    assert t.gather(5) and len(t.version().parts) == 1 and t.read().count() == 7
    t.vacuum(2)
    assert t.versions() == [7, 8] and t.read(7).count() == t.read().count() == 7


def test_null_keys_match_nothing(spark):
    t, s = rows(spark, [(None, 1, "a", 0, 0)]), rows(spark, [(None, 2, "b", 0, 0)])
    out = m.merge(t, s, newer())
    assert sorted(r._action for r in out.collect()) == ["I", "K"]


def test_guarded_update_and_revival(spark):
    cols = ["k", "v", "h", "score", "as_of", "gone", "gone_at"]
    ddl = "k bigint, v bigint, h string, score bigint, as_of bigint, gone boolean, gone_at bigint"
    spec = m.newer_with_guard(cols, ["k"], "v", "h", guarded=["score"], as_of="as_of", deleted="gone", deleted_at="gone_at")
    target = spark.createDataFrame([(1, 1, "a", 10, 9, False, None), (2, 1, "a", 10, 1, True, 3), (3, 1, "a", 10, 1, True, 8)], ddl)
    source = spark.createDataFrame([(k, 5, "b", 99, 5, False, None) for k in (1, 2, 3)], ddl)
    got = {r.k: (r.score, r.as_of, r.gone, r.gone_at) for r in m.merge(target, source, spec).collect()}
    assert got == {1: (10, 9, False, None), 2: (99, 5, False, None), 3: (99, 5, True, 8)}


def test_bridge_changes_delete_what_is_gone(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "q bigint, tag string")
    want = spark.createDataFrame([(1, "b"), (1, "d")], "q bigint, tag string").withColumn("flag", F.lit(True))
    src = m.bridge_changes(old, want, want, "q", ["q", "tag"])
    out = m.applied(m.merge(old.withColumn("flag", F.lit(True)), src, m.bridge_sync(["q", "tag"], "flag")))
    assert sorted((r.q, r.tag) for r in out.collect()) == [(1, "b"), (1, "d"), (2, "c")]
