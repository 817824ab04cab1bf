"""The layers end to end over small landed batches."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sedimenta import ingest
from sedimenta.contracts import CONTRACTS
from sedimenta.functions.columns import fingerprint_part
from sedimenta.runs import Lakehouse
from sedimenta.sources.landing import chosen, discover, write_batch

T0 = 1_760_000_000


def owner(i):
    return {"account_id": i, "user_id": i, "user_type": "registered", "reputation": 10 * i, "display_name": f"name{i}"}


def question(i, *, score=1, tags=("pandas", "numpy"), at=T0, **more):
    base = {
        "question_id": i, "title": f"A &amp; B {i}", "body": "<p>mail me at a.b@example.com</p><pre>x</pre>", "tags": list(tags), "owner": owner(i), "is_answered": False,
        "view_count": 5, "answer_count": 1, "score": score, "creation_date": T0, "last_activity_date": at, "link": f"https://qa.example.org/{i}",
    }
    return base | more


def answer(i, q, *, at=T0 + 3600, accepted=False):
    return {"answer_id": i, "question_id": q, "body": "<code>y</code>", "owner": owner(i), "is_accepted": accepted, "score": 0, "creation_date": at, "last_activity_date": at, "content_license": "CC"}


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    t1, t2 = dt.datetime(2026, 1, 1, 8), dt.datetime(2026, 1, 2, 8)
    write_batch(f"{root}/full/full_a", "full", t1, {"questions": [question(1), question(2), question(3, title=" ")], "answers": [answer(11, 1), answer(12, 1), answer(13, 2, accepted=True)]})
    s2 = int(t2.timestamp())
    write_batch(
        f"{root}/incremental/incr_b", "incremental", t2,
        {
            "questions": [question(1, score=7, tags=["pandas"], ai_assisted=True, owner=owner(1) | {"badge_counts": {"gold": 1}}), question(4, score="five"), '{"question_id": 5, ', {"title": "no key"}],
            "deleted_questions": [{"question_id": 2, "is_deleted": True, "detected_at": s2}],
            "question_snapshots": [{"question_id": 1, "snapshot_at": s2 + 86400 * 400, "score": 9, "view_count": 50, "answer_count": 2, "is_answered": True, "closed_date": None}],
        },
    )
    (root / "incremental" / "incr_broken").mkdir()
    return str(root)


@pytest.fixture(scope="module")
def house(spark, landing, tmp_path_factory):
    h = Lakehouse(spark, str(tmp_path_factory.mktemp("house")), landing, salt="test-salt")
    assert h.raw_to_bronze(fail_on_error=False) == {"loaded": 2, "skipped": 0, "failed": 1}
    assert set(h.bronze_to_silver().values()) == {"SUCCESS"}
    assert set(h.silver_to_gold().values()) == {"SUCCESS"}
    return h


def prints(h, *names):
    out = {}
    for n in names:
        df = h.table(n, {}, ["x"]).read()
        out[n] = df.agg(F.sum(fingerprint_part(df.columns)), F.count(F.lit(1))).first()
    return out


def test_discovery_and_choice(spark, landing):
    found = discover(spark, landing)
    assert [b.batch_id for b in found] == ["full_a", "incr_broken", "incr_b"]
    assert found[1].error == "missing _manifest.json"
    got, missing = chosen(found, ["full_a", "nope"], start=dt.date(2026, 1, 1), end=dt.date(2026, 1, 1))
    assert [b.batch_id for b in got] == ["full_a"] and missing == ["nope"]


def test_bronze_rescues_evolves_and_quarantines(house):
    rows = {r.question_id: r for r in house.bronze("questions").read(parts=["incr_b"]).collect()}
    assert set(rows) == {1} and rows[1].ai_assisted == "true" and "badge_counts" in rows[1]._rescued_data
    reasons = sorted(r.reason for r in house.quarantine.read().collect())
    assert reasons == ["malformed_json", "missing_primary_key", "type_mismatch"]
    kinds = {(r.drift_type, r.column_path): r.action_taken for r in house.drift.read().collect()}
    assert kinds[("new_column", "ai_assisted")] == "evolved" and kinds[("new_column", "owner.badge_counts")] == "rescued" and kinds[("type_mismatch", "score")] == "quarantined"


def test_silver_state(house):
    q = {r.question_id: r for r in house.table("silver.questions", {}, ["question_id"]).read().collect()}
    assert set(q) == {1, 2}
    assert (q[1].title, q[1].score, q[1].view_count, q[1].is_deleted) == ("A & B 1", 9, 50, False)
    assert q[1].metrics_as_of > q[1].source_extracted_at and q[2].is_deleted
    assert len(q[1].owner_user_key) == 64 and "display_name" not in q[1].asDict()
    tags = sorted((r.question_id, r.tag) for r in house.table("silver.question_tags", {}, ["question_id", "tag"]).read().collect())
    assert (1, "pandas") in tags and (1, "numpy") not in tags
    assert [r.failed_rule for r in house.table("silver.dq_quarantine", {}, ["dq_id"]).read().collect()] == ["title_not_blank"]
    text = house.table("silver.post_text_masked", {}, ["post_type", "post_id"]).read().where("post_type = 'question' AND post_id = 1").first()
    assert "[EMAIL]" in text.body_masked and text.masked_token_count == 1


def test_gold_state(house):
    read = lambda n: house.table(f"gold.{n}", {}, ["x"]).read()
    assert [r.question_id for r in read("fact_question").collect()] == [1]
    firsts = {r.answer_id: r.is_first_answer for r in read("fact_answer").collect()}
    assert firsts == {11: True, 12: False}
    assert read("dim_date").count() == read("dim_date").select("date_key").distinct().count()
    cells = read("agg_user_cohort").where("months_since = 0").collect()
    assert all(c.share_still_active == 1 for c in cells)


def test_replays_change_nothing(house):
    names = ["silver.questions", "silver.answers", "silver.users", "silver.question_tags", "gold.fact_question", "gold.agg_tag_month"]
    before = prints(house, *names)
    assert house.raw_to_bronze(fail_on_error=False)["skipped"] == 2
    assert house.bronze_to_silver() == {}
    house.raw_to_bronze("backfill", batch_ids=["full_a"])
    assert set(house.bronze_to_silver().values()) == {"SUCCESS"}
    house.silver_to_gold(optimize=True)
    assert prints(house, *names) == before


def test_audit_and_guards(house):
    log = house.audit.read()
    assert log.where("status = 'FAILED'").select("message").first()[0] == "missing _manifest.json"
    assert log.where("start_time IS NULL OR status IS NULL OR run_id IS NULL").count() == 0
    for run in (house.raw_to_bronze, house.bronze_to_silver):
        with pytest.raises(ValueError):
            run("backfill")
        with pytest.raises(ValueError):
            run("sideways")
    with pytest.raises(RuntimeError):
        house.raw_to_bronze(batch_ids=["nope"])


def test_nothing_unexpected_is_cut_or_mixed_up():
    wanted = ingest.requirements(CONTRACTS["questions"].tree)
    long = "y" * 10_000
    record = question(9) | {"owner.x": 1, "note": long, "tags": ["a", 3, None]} | {"owner": owner(9) | {"x": {"deep": [1, 2]}, "user_id": "nine"}}
    is_object, outside, wrong = ingest.inspected(json.dumps(record), wanted)
    assert is_object and {u["path"]: json.loads(u["value"]) for u in outside} == {'["owner.x"]': 1, "note": long, "owner.x": {"deep": [1, 2]}}
    assert [(w["path"], w["expected"], w["found"]) for w in wrong] == [("owner.user_id", "bigint", '"nine"')]
    assert ingest.inspected("[1]", wanted) == ingest.inspected("{", wanted) == (False, [], [])
    assert ingest.inspected('{"question_id": 1.5, "tags": "a", "owner": 3, "is_answered": 1, "score": 3000000000}', wanted)[2] == [
        {"path": p, "expected": e, "found": f} for p, e, f in (("question_id", "bigint", "1.5"), ("tags", "array<string>", '"a"'), ("owner", "struct", "3"), ("is_answered", "boolean", "1"), ("score", "int", "3000000000"))
    ]


def test_columns_evolve_up_to_a_bound_and_the_rest_is_rescued(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "EVOLVED_COLUMNS", 3)
    rows = [question(i, **{f"new_{k}": k for k in range(i + 1)}) for i in range(1, 6)]
    write_batch(f"{tmp_path}/full/b", "full", dt.datetime(2026, 1, 1), {"questions": rows})
    batch = discover(spark, str(tmp_path))[0]
    out = ingest.load_files(spark, [batch], CONTRACTS["questions"], {}, now=dt.datetime(2026, 1, 1))
    assert out.counts == {"b": (5, 5)}
    assert sorted(out.new_columns) == ["new_0", "new_1", "new_2"]
    got = {r.question_id: r for r in out.good.collect()}
    assert json.loads(got[5]._rescued_data) == {"new_3": "3", "new_4": "4", "new_5": "5"} and got[5].new_2 == "2" and got[1]._rescued_data is None
    assert {r.column_path: (r.record_count, r.action_taken) for r in out.drift.collect()} == {f"new_{k}": (min(5, 6 - k), "evolved" if k < 3 else "rescued") for k in range(6)}


def test_many_batches_are_read_in_one_scan_and_a_broken_one_fails_alone(spark, tmp_path, monkeypatch):
    for i in range(4):
        write_batch(f"{tmp_path}/landing/full/b{i}", "full", dt.datetime(2026, 1, 1 + i), {"questions": [question(10 * i + k) for k in range(3)] + (["{"] if i == 2 else [])})
    (tmp_path / "landing" / "full" / "b1" / "questions.jsonl").unlink()
    scans = []
    real = ingest.lines
    monkeypatch.setattr(ingest, "lines", lambda spark, *paths: (scans.append(len(paths)), real(spark, *paths))[1])
    h = Lakehouse(spark, str(tmp_path / "house"), f"{tmp_path}/landing", salt="test-salt")
    assert h.setup() and not h.setup()
    assert h.raw_to_bronze(fail_on_error=False) == {"loaded": 3, "skipped": 0, "failed": 1} and scans == [3]
    rows = h.bronze("questions").read()
    assert {r._batch_id: r.n for r in rows.groupBy("_batch_id").agg(F.count("*").alias("n")).collect()} == {"b0": 3, "b2": 3, "b3": 3}
    assert rows.where("_batch_id = 'b3'").first()._extracted_at == dt.datetime(2026, 1, 4) and h.quarantine.read().count() == 1
    log = {r.batch_id: (r.rows_read, r.rows_inserted, r.rows_quarantined, r.status) for r in h.audit.read().where("entity = 'questions'").collect()}
    assert log == {"b0": (3, 3, 0, "SUCCESS"), "b2": (4, 3, 1, "SUCCESS"), "b3": (3, 3, 0, "SUCCESS")}
    # a scan that fails for one batch does not keep the others out
    monkeypatch.setattr(ingest, "lines", lambda spark, *paths: 1 / 0 if any("/b0/" in p for p in paths) else real(spark, *paths))
    assert h.raw_to_bronze("backfill", batch_ids=["b0", "b2", "b3"], fail_on_error=False) == {"loaded": 2, "skipped": 0, "failed": 1}
    assert h.bronze("questions").read().count() == 9
    assert sum(h.maintain(1).values()) >= 1 and h.bronze("questions").read().count() == 9
