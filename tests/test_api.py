"""The paged source against a small local server."""

import datetime as dt
import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from sedimenta.sources import extract
from sedimenta.sources.api import PagedApi, Pages, QuotaSpent, months, next_watermark, once
from sedimenta.sources.landing import discover


class Server(BaseHTTPRequestHandler):
    failures: dict = {}
    left = 1000
    store = False  # whether known ids are answered by their own records

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        where = (q.get("tagged"), q.get("page"))
        if where == ("b", "1") and not Server.failures.get(where):
            Server.failures[where] = True
            self.send_response(503)
            self.end_headers()
            return
        if q.get("tagged") == "bad":
            self.send_response(404)
            self.end_headers()
            self.wfile.write(b"no such tag")
            return
        page = int(q.get("page", 1))
        ids = [int(x) for x in urlparse(self.path).path.split("/")[2].split(";")] if urlparse(self.path).path.count("/") > 1 else None
        if ids and Server.store:
            alive = [i for i in ids if i % 7]
            answers = [{"answer_id": 1000 + i, "question_id": i, "body": "b"} for i in alive]
            rows = answers if self.path.split("?")[0].endswith("/answers") else [{"question_id": i, "score": i, "view_count": 2 * i, "answer_count": 1, "is_answered": True} for i in alive]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"items": rows, "has_more": False, "quota_remaining": Server.left}).encode())
            return
        rows = [{"question_id": 100 * page + i, "tag": q.get("tagged"), "last_activity_date": 10 * page + i, "answer_count": i} for i in range(3)]
        body = {"total": 7} if q.get("filter") == "total" else {"items": rows, "has_more": page < 2, "quota_remaining": Server.left}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(gzip.compress(json.dumps(body).encode()))

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_months():
    assert [m for _, _, m in months("2025-12-15", "2026-02-01")] == ["2025-12", "2026-01"]
    assert months("2026-01-01", "2026-01-01") == []


def test_pages_repeat_and_stop(url):
    pages = Pages(url, wait=0.0)
    assert len(list(pages.items("/questions", tagged="b"))) == 6
    assert pages.count("/questions") == 7 and len(list(pages.by_ids("/questions/{ids}", list(range(150))))) == 12
    with pytest.raises(RuntimeError, match="404"):
        pages.get("/questions", tagged="bad")
    pages.quota = 5
    with pytest.raises(QuotaSpent):
        pages.get("/questions")


def test_as_a_data_source(spark, url):
    spark.dataSource.register(PagedApi)
    df = spark.read.format("paged_api").options(base_url=url, tags="a,c", start="2026-01-01", end="2026-03-01", wait="0").load()
    assert df.count() == 2 * 2 * 6
    items = once(df)
    assert items.count() == 6 and items.first().tags == ["a", "c"] and next_watermark(items) == 22


def landed(spark, folder, entity):
    return sorted((json.loads(r.value) for r in spark.read.text(f"{folder}/{entity}.jsonl").collect()), key=lambda r: sorted(map(str, r.values())))


def test_full_and_incremental_loads_land_batches(spark, url, tmp_path):
    root = str(tmp_path)
    Server.store = True
    try:
        manifest = extract.full_load(spark, url, root, ["a", "c"], "2026-01-01", "2026-02-01", wait=0)
        assert manifest["files"] == {"questions.jsonl": {"records": 6}, "answers.jsonl": {"records": 4}} and manifest["stopped_early"] == 0
        with pytest.raises(ValueError, match="watermark"):
            extract.incremental_load(spark, url, root, ["a"], wait=0)
        known = spark.createDataFrame([(i,) for i in (5, 6, 7, 14)], "question_id bigint")
        at = dt.datetime(2026, 3, 1, 12)
        got = extract.incremental_load(spark, url, root, ["a"], since=11, known=known, now=at, wait=0)
        assert got["next_watermark"] == 22 == extract.watermark(spark, root)
        folder = f"{root}/incremental/incr_20260301T120000Z"
        epoch = int(at.replace(tzinfo=dt.UTC).timestamp())
        assert [(r["question_id"], r["is_deleted"], r["detected_at"]) for r in landed(spark, folder, "deleted_questions")] == [(14, True, epoch), (7, True, epoch)]
        shots = {r["question_id"]: r for r in landed(spark, folder, "question_snapshots")}
        assert set(shots) == {5, 6} and shots[5] == {"question_id": 5, "snapshot_at": epoch, "score": 5, "view_count": 10, "answer_count": 1, "is_answered": True, "closed_date": None}
        assert [b.batch_id for b in discover(spark, root)] == ["full_2026-01-01_2026-02-01", "incr_20260301T120000Z"] and not any(b.error for b in discover(spark, root))
        # a spent quota: what came is landed, the watermark stays, nothing counts as deleted
        Server.left = 5
        short = extract.incremental_load(spark, url, root, ["a"], known=known, now=dt.datetime(2026, 3, 2), wait=0, tasks=1)
        assert short["stopped_early"] >= 1 and short["next_watermark"] == 22 and short["since"] == 22
    finally:
        Server.store, Server.left = False, 1000
