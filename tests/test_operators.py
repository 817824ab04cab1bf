"""Core operators against brute force, with their edge cases."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from sedimenta.contracts import RAW, ddl_of
from sedimenta.functions import columns as c
from sedimenta.functions.tree_edit import ADD, DELETE, FORBIDDEN, MOVE, RENAME, assign, script
from sedimenta.operators import marts
from sedimenta.operators.changefeed import apply_changes
from sedimenta.operators.drift import name_distance, read_consistent, read_records, schema_changes, strict_object
from sedimenta.operators.history import latest_observation, versions
from sedimenta.operators.select import mark_first, newest, split_by_rules

FEED = "k bigint, at bigint, act bigint, h string, extra string"


def current(feed, deletes):
    best = {}
    for k, at, act, h, _ in feed:
        if k is None:
            continue
        rank = (at if at is not None else -1, act if act is not None else -1, [-ord(x) for x in h])
        if k not in best or rank > best[k][0]:
            best[k] = (rank, h)
    return sorted((k, h) for k, (rank, h) in best.items() if not any(d == k and t is not None and t > rank[0] for d, t in deletes))


def applied(spark, feed, deletes, **kw):
    f = spark.createDataFrame(feed, FEED)
    d = spark.createDataFrame(deletes, "k bigint, at bigint")
    out = apply_changes(f, "k", [F.col("act").asc_nulls_first(), F.col("h").desc()], ["act", "h"], deletes=d, sequence="at", **kw)
    return sorted((r.k, r.h) for r in out.collect())


def test_changes_in_any_order_and_repeated(spark):
    rng = random.Random(1)
    feed = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 6]), rng.choice("abc"), "x") for _ in range(60)]
    deletes = [(rng.choice([1, 2, 3, 9]), rng.choice([0, 2, 3, None])) for _ in range(3)]
    want = current(feed, deletes)
    for _ in range(2):
        rng.shuffle(feed)
        assert applied(spark, feed + feed[:20], deletes, salts=3) == want


def test_changes_empty_ties_and_base(spark):
    assert applied(spark, [], []) == []
    assert applied(spark, [(1, 5, 1, "b", "x"), (1, 5, 1, "a", "y")], [(1, 5)]) == [(1, "a")]  # equal time: the record stays
    assert applied(spark, [(1, 5, 1, "b", "x")], [(1, 6)]) == []
    base = spark.createDataFrame([(1, 9, 1, "new", "x")], FEED)
    assert applied(spark, [(1, 5, 1, "old", "x"), (2, 1, 1, "c", "")], [], base=base) == [(1, "new"), (2, "c")]


def test_history_equals_brute_force_for_any_block(spark):
    rng = random.Random(7)
    one = {(rng.randint(1, 4), rng.randint(0, 40)): rng.choice(["a", "b", None]) for _ in range(120)}
    want = []
    for k in sorted({k for k, _ in one}):
        seq = sorted(((t, v) for (kk, t), v in one.items() if kk == k), key=lambda x: x[0])
        starts = [(t, v) for i, (t, v) in enumerate(seq) if i == 0 or seq[i - 1][1] != v]
        want += [(k, v, t, starts[i + 1][0] if i + 1 < len(starts) else None, i + 1) for i, (t, v) in enumerate(starts)]
    df = spark.createDataFrame([(k, t, v, 0) for (k, t), v in one.items()] + [(None, 1, "x", 0), (1, None, "x", 0)], "k bigint, t bigint, v string, __from int")
    for block in (None, F.floor(F.col("t") / 4)):
        got = [(r.k, r.v, r.valid_from, r.valid_to, r.version_no) for r in versions(df, ["k"], "t", ["v"], block=block).collect()]
        assert sorted(got, key=lambda r: (r[0], r[2])) == want
    assert versions(df.limit(0), ["k"], "t", ["v"]).count() == 0


def test_latest_observation_takes_corrections(spark):
    df = spark.createDataFrame([(1, 5, 1, "old"), (1, 5, 2, "new"), (1, 5, 2, "newer"), (None, 5, 1, "x")], "k bigint, t bigint, seen bigint, v string")
    assert sorted(map(tuple, latest_observation(df.where("k IS NOT NULL"), ["k", "t"], ["v"], ["seen"]).collect())) == [(1, 5, "newer")]


def test_assignment_is_least():
    import itertools

    rng = random.Random(5)
    for n, m in ((1, 1), (2, 4), (4, 4), (3, 6)):
        cost = [[rng.random() for _ in range(m)] for _ in range(n)]
        best = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert abs(sum(cost[i][j] for i, j in enumerate(assign(cost))) - best) < 1e-9


def test_edit_scripts():
    relabel = lambda p, x: 0.2 if (p[-1], x[-1]) in {("a", "A"), ("s", "S")} else FORBIDDEN
    must = frozenset({("a",), ("s",), ("s", "x"), ("b",)})
    cost, edits = script({"a": None, "b": None, "s": {"x": None}}, {"A": None, "S": {"x": None, "y": None}}, relabel, mandatory=must)
    assert {(e.kind, e.path, e.seen) for e in edits} == {(RENAME, ("a",), ("A",)), (RENAME, ("s",), ("S",)), (DELETE, ("b",), ())}
    assert abs(cost - (0.2 + 0.2 + 0.5 + 0.5)) < 1e-9
    _, moved = script({"s": {"x": None}}, {"s": {"z": None}, "x": None}, relabel, mandatory=must, moves=True)
    assert (MOVE, ("s", "x"), ("x",)) in {(e.kind, e.path, e.seen) for e in moved} and any(e.kind == ADD for e in moved)
    assert script({}, {}, relabel, mandatory=must) == (0, [])


def test_drift_report_and_consistent_read(spark):
    good = '{"question_id": %d, "snapshot_at": 1770000000, "score": 1, "%s": %d, "answer_count": 0, "is_answered": true, "closed_date": null}'
    rows = [("question_snapshots", "f1", good % (i, "view_count", 100 + i)) for i in range(12)]
    rows += [("question_snapshots", "f2", good % (i, "viewCount", 100 + i)) for i in range(12)]
    rows += [("question_snapshots", "f2", x) for x in ("not json", "[1]", None, "", '{"question_id": NaN}')]
    rows += [("question_snapshots", "f3", '{"question_id": "7", "snapshot_at": 5.0, "score": 3000000000, "view_count": 1, "answer_count": 0, "is_answered": 1, "closed_date": null, "new": [1]}')]
    rows += [("nobody", "f4", "{}"), ("question_snapshots", None, "{}"), (None, "f5", "{}")]
    df = spark.createDataFrame(rows, "entity string, _source_file string, raw_record string").withColumn("lines", F.lit("clash"))
    changes = schema_changes(df).cache()
    got = {(r.source_file, r.change_kind, r.column_path, r.seen_path) for r in changes.collect()}
    assert ("f2", "renamed", "view_count", "viewCount") in got
    f3 = {(k, p) for f, k, p, _ in got if f == "f3"}
    assert f3 == {("added", "new"), ("type_changed", "question_id"), ("type_changed", "snapshot_at"), ("type_changed", "score"), ("type_changed", "is_answered")}
    assert not [x for x in got if x[0] == "f1"]
    table = read_consistent(df, changes, "question_snapshots")
    assert sorted(r.view_count for r in table.where("source_file = 'f2'").collect()) == list(range(100, 112))
    assert schema_changes(df.limit(0)).count() == 0
    assert strict_object('{"a": NaN}') is None and strict_object("5") is None and strict_object('{"a": 1}') == {"a": 1}
    assert name_distance("view_count", "viewCount") == 0 and name_distance("owner", "author") == 1


def test_renames_inside_owner_reach_the_table(spark):
    owner = '{"user_id": %d, "%s": "registered", "%s": "Nick %d", "reputation": 5}'
    line = '{"answer_id": %d, "question_id": 1, "body": "b", "%s": %s, "is_accepted": true, "score": 1, "creation_date": 5, "last_activity_date": 5, "content_license": "CC"}'
    names = {"f1": ("owner", "user_type", "display_name"), "f2": ("owner", "userType", "displayName"), "f3": ("ownerInfo", "userType", "display_name"), "f4": ("owner", "user_type", "display_name")}
    rows = [("answers", f, line % (i, o, owner % (i, t, d, i))) for f, (o, t, d) in names.items() for i in range(12)]
    rows += [("answers", "f2", line % (i, "owner", x)) for i, x in ((90, "null"), (91, '"text"'), (92, "[1]"), (93, '{"user_id": "x", "userType": null}'))]
    df = spark.createDataFrame(rows, "entity string, _source_file string, raw_record string")
    changes = schema_changes(df, inside=True).cache()
    report = {(r.source_file, r.change_kind, r.column_path, r.seen_path) for r in schema_changes(df).collect()}
    assert ("f2", "renamed", "owner.user_type", "owner.userType") in report and not any(f == "f3" and "." in p for f, _, p, _ in report)
    got = {(r.source_file, r.answer_id): r.owner for r in read_consistent(df, changes, "answers").collect()}
    assert len(got) == len(rows)
    assert all((o.user_type, o.display_name, o.user_id, o.reputation) == ("registered", f"Nick {i}", i, 5) for (_, i), o in got.items() if i < 12)
    assert [got["f2", i] for i in (90, 91, 92)] == [None] * 3 and got["f2", 93].user_id is None and got["f2", 93].user_type is None


def test_records_of_all_entities_in_one_table(spark):
    kinds = {f.name: {e: t[f.name] for e, t in RAW.items() if f.name in t} for e in RAW for f in spark.createDataFrame([], ddl_of(RAW[e])).schema}
    assert all(len({str(k) for k in by.values()}) == 1 for by in kinds.values())  # contracts agree on the type of a name
    rows = [("questions", "q", '{"question_id": 1, "title": "t", "owner": {"user_id": 2}, "detected_at": 9}'), ("answers", "a", '{"answer_id": 3, "title": "not in the contract", "score": 4}')]
    rows += [("deleted_questions", "d", '{"question_id": 5, "is_deleted": true, "detected_at": 6}'), ("question_snapshots", "s", '{"question_id": 7, "snapshot_at": 8}')]
    rows += [("answers", None, '{"answer_id": 4}'), ("answers", "a", "not json"), ("nobody", "n", "{}")]
    df = spark.createDataFrame(rows, "entity string, _source_file string, raw_record string")
    changes = schema_changes(df, inside=True).cache()
    table = read_records(df, changes).cache()
    assert table.columns == ["entity", "source_file", *kinds, "_rescued_data"]
    got = {(r.entity, r.source_file): r for r in table.collect()}
    assert set(got) == {("questions", "q"), ("answers", "a"), ("deleted_questions", "d"), ("question_snapshots", "s"), ("answers", None)}
    assert got["questions", "q"].owner.user_id == 2 and got["questions", "q"].detected_at is None
    assert (got["answers", "a"].answer_id, got["answers", "a"].title, got["answers", "a"].score) == (3, None, 4)
    assert json.loads(got["answers", "a"]._rescued_data) == {"title": "not in the contract"} and json.loads(got["questions", "q"]._rescued_data) == {"detected_at": "9"}
    assert got["deleted_questions", "d"].is_deleted is True and got["question_snapshots", "s"].snapshot_at == 8
    for e in RAW:
        assert table.where(F.col("entity") == e).select("source_file", *RAW[e], "_rescued_data").exceptAll(read_consistent(df, changes, e)).count() == 0


def test_nothing_of_a_drifted_file_is_lost(spark):
    line = '{"answer_id": %d, "question_id": 1, "body": "b", "owner": {"user_id": %d, "user_type": "registered", "name_shown": "Nick %d", "a.b": 1}, "is_accepted": true, "score": "%d pts", "creation_date": 5, "last_activity_date": 5, "content_license": "CC", "extra": {"x": [1]}, "owner.user_id": "top"}'
    usual = '{"answer_id": %d, "question_id": 1, "body": "b", "owner": {"user_id": 1, "user_type": "registered", "display_name": "Nick %d"}, "is_accepted": true, "score": 1, "creation_date": 5, "last_activity_date": 5, "content_license": "CC"}'
    rows = [("answers", "f", line % (i, i, i, i)) for i in range(12)] + [("answers", "g", usual % (i, i)) for i in range(12)]
    # what belongs into owner stands beside it
    rows += [("answers", "h", (usual % (i, i)).replace('"display_name": "Nick %d"' % i, '"link": "l"').replace('"is_accepted"', '"display_name": "Nick %d", "reputation": 7, "is_accepted"' % i)) for i in range(12)]
    df = spark.createDataFrame(rows, "entity string, _source_file string, raw_record string")
    changes = schema_changes(df, inside=True).cache()
    table = {(r.source_file, r.answer_id): r for r in read_consistent(df, changes, "answers").collect()}
    one = table["f", 3]
    assert one.owner.display_name == "Nick 3" and one.score is None
    assert json.loads(one._rescued_data) == {"score": "3 pts", "extra": '{"x":[1]}', "owner.a.b": "1", '["owner.user_id"]': "top"}
    assert table["g", 3]._rescued_data is None and table["g", 3].score == 1
    assert table["h", 3].owner.display_name == "Nick 3" and table["h", 3].owner.reputation == 7 and table["h", 3]._rescued_data is None
    moved = {(r.change_kind, r.column_path, r.seen_path) for r in changes.where("source_file = 'h'").collect()}
    assert {("moved", "owner.display_name", "display_name"), ("moved", "owner.reputation", "reputation")} <= moved
    report = {(r.change_kind, r.column_path) for r in schema_changes(df).where("source_file = 'h'").collect()}
    assert report == {("removed", "owner.display_name"), ("added", "display_name"), ("added", "reputation")}


def test_a_rename_in_few_of_the_lines_among_many_new_names(spark):
    base = {"question_id": 1, "snapshot_at": 1770000000, "score": 1, "answer_count": 0, "is_answered": True, "closed_date": None}
    rows = [("question_snapshots", "f", json.dumps(base | ({"viewCount": 100 + i} if i % 10 == 0 else {}) | {f"k{i}_{j}": "x" for j in range(20)})) for i in range(60)]
    rows += [("question_snapshots", "g", json.dumps(base | {"view_count": 100 + i})) for i in range(60)]
    df = spark.createDataFrame(rows, "entity string, _source_file string, raw_record string")
    changes = schema_changes(df).cache()
    assert {(r.source_file, r.column_path, r.seen_path, r.lines) for r in changes.where("change_kind = 'renamed'").collect()} == {("f", "view_count", "viewCount", 6)}
    assert changes.where("change_kind = 'added'").count() == 1200 and changes.count() == 1201


def test_select_operators(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, None, "c"), (2, 1, "d")], "k bigint, at bigint, v string")
    assert sorted(r.v for r in newest(df, ["k"], [F.desc_nulls_last("at")]).collect()) == ["b", "d"]
    flags = {r.v: r.first for r in mark_first(df, ["k"], ["at"], "first").collect()}
    assert flags == {"a": True, "b": False, "c": False, "d": True}
    good, bad = split_by_rules(df, {"at": F.col("at") > 0, "v": F.col("v") != "a"})
    assert sorted(r.v for r in good.collect()) == ["b", "d"] and {r.v: r._failed_rule for r in bad.collect()} == {"a": "v", "c": "at"}


def test_marts_on_nothing_and_many_items(spark):
    posts = spark.createDataFrame([], "u string, at timestamp")
    assert marts.cohort_retention(posts, "u", "at").count() == 0
    items = spark.createDataFrame([(1, f"i{j:03d}") for j in range(70)] + [(2, "i000"), (2, "i001"), (2, "i001")], "q bigint, item string")
    pairs = {(r.item_a, r.item_b): r.question_count for r in marts.item_pairs(items, "q", "item").collect()}
    assert len(pairs) == 70 * 69 // 2 and pairs["i000", "i001"] == 2
    days = marts.calendar(spark.createDataFrame([(None, None)], "lo date, hi date"), low=dt.date(2024, 2, 28), high=dt.date(2024, 3, 1), marker=dt.date(2024, 2, 29), flag="late")
    assert [(r.date_key, r.late) for r in days.orderBy("date_key").collect()] == [(20240228, False), (20240229, True), (20240301, True)]


def test_column_functions(spark):
    df = spark.createDataFrame([("  Needs details! or clarity ", "a &amp; &lt;b&gt;", None), (None, None, 1), ("__", "x", 2)], "r string, h string, id bigint")
    got = df.select(c.slug(F.col("r")).alias("s"), c.decoded(F.col("h")).alias("h"), c.pseudonym(F.col("id"), "salt").alias("p"), c.count_of(F.col("h"), "&").alias("n")).collect()
    assert [r.s for r in got] == ["needs_details_or_clarity", None, ""] and got[0].h == "a & <b>" and got[0].p is None and len(got[1].p) == 64
    assert [r.n for r in got] == [3, 0, 0]
    assert c.safe_column_name("X-Trace") == "x_trace" and c.safe_column_name("--") == "unnamed_column"
    secret = spark.createDataFrame([("mail a@b.co from 10.0.0.1 password=hunter22 jdbc:mysql://h/db end",)], "t string").select(c.masked(F.col("t"))).first()[0]
    assert secret == "mail [EMAIL] from [IP] password=[SECRET] jdbc:mysql://[CONNECTION] end"
