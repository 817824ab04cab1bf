"""A paged web API as a Spark data source: one partition per (tag, month).

Each partition walks its own pages on an executor, waits when the server asks
for it, repeats what failed for the moment, and stops before a quota runs out.
Rows are the raw items as JSON text, ready to be landed or classified.

    spark.dataSource.register(PagedApi)
    spark.read.format("paged_api").options(base_url=..., tags="a,b", start="2026-01-01", end="2026-03-01").load()
"""

from __future__ import annotations

import datetime as dt
import gzip
import json
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "tag string, month string, item_id bigint, item string"
#: Attempts per request, items per page and ids per request.
ATTEMPTS, PAGE, IDS = 4, 100, 100
#: How far an incremental run reaches back behind its watermark, for items that changed while it ran.
OVERLAP_SECONDS = 3600


def months(start: str, end: str) -> list[tuple[int, int, str]]:
    """(from, to, yyyy-MM) in epoch seconds of the calendar months in [start, end)."""
    at, stop = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    out = []
    epoch = lambda d: int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.UTC).timestamp())
    while at < stop:
        following = min((at.replace(day=1) + dt.timedelta(days=32)).replace(day=1), stop)
        out.append((epoch(at), epoch(following), f"{at:%Y-%m}"))
        at = following
    return out


def inflate(raw: bytes) -> bytes:
    """The body as text bytes, however it was packed."""
    if raw[:2] == b"\x1f\x8b":
        return gzip.decompress(raw)
    try:
        return zlib.decompress(raw)
    except zlib.error:
        return raw


class QuotaSpent(RuntimeError):
    """The server's quota is down to the reserve."""


class Pages:
    """Items of an API that answers {items, has_more, backoff, quota_remaining}."""

    def __init__(self, base_url: str, *, reserve: int = 20, wait: float = 5.0, **fixed: str) -> None:
        self.base_url, self.reserve, self.wait, self.fixed = base_url.rstrip("/"), reserve, wait, fixed
        self.quota: int | None = None
        self.not_before = 0.0

    def get(self, path: str, **params: object) -> dict:
        if self.quota is not None and self.quota <= self.reserve:
            raise QuotaSpent(f"{self.quota} requests left")
        url = f"{self.base_url}{path}?{urllib.parse.urlencode(self.fixed | params)}"
        request = urllib.request.Request(url, headers={"Accept-Encoding": "gzip, deflate"})
        for attempt in range(1, ATTEMPTS + 1):
            time.sleep(max(0.0, self.not_before - time.time()))
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    envelope = json.loads(inflate(answer.read()))
            except urllib.error.HTTPError as e:
                said = inflate(e.read())
                if e.code < 500 and b"throttle" not in said.lower():
                    raise RuntimeError(f"HTTP {e.code} for {url}: {said[:300]!r}") from e
                self.not_before = time.time() + self.wait * attempt
                continue
            self.quota = envelope.get("quota_remaining", self.quota)
            self.not_before = time.time() + float(envelope.get("backoff", 0))
            return envelope
        raise RuntimeError(f"no answer after {ATTEMPTS} attempts: {url}")

    def items(self, path: str, **params: object) -> Iterator[dict]:
        page = 1
        while True:
            envelope = self.get(path, page=page, pagesize=PAGE, **params)
            yield from envelope.get("items", [])
            if not envelope.get("has_more"):
                return
            page += 1

    def by_ids(self, path: str, ids: Sequence[int], **params: object) -> Iterator[dict]:
        """Items of known ids; ``path`` has a place for them, as in ``/questions/{ids}``."""
        for k in range(0, len(ids), IDS):
            yield from self.items(path.format(ids=";".join(map(str, ids[k : k + IDS]))), **params)

    def count(self, path: str, **params: object) -> int:
        return int(self.get(path, filter="total", **params)["total"])


@dataclass
class Window(InputPartition):
    tag: str
    since: int
    until: int
    month: str


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Window]:
        o = self.options
        spans = months(o["start"], o["end"]) if "start" in o else [(int(o["since"]) - OVERLAP_SECONDS, int(o.get("until", 2**31)), "")]
        return [Window(tag, a, b, label) for tag in o["tags"].split(",") for a, b, label in spans]

    def read(self, partition: Window) -> Iterator[tuple]:
        o = self.options
        pages = Pages(o["base_url"], reserve=int(o.get("reserve", 20)), wait=float(o.get("wait", 5)), **({"site": o["site"]} if "site" in o else {}))
        bounds = {"fromdate": partition.since, "todate": partition.until - 1} if "start" in o else {"min": partition.since, "sort": "activity"}
        key = o.get("key", "question_id")
        try:
            for item in pages.items(o.get("path", "/questions"), tagged=partition.tag, **bounds):
                yield partition.tag, partition.month, item.get(key), json.dumps(item)
        except QuotaSpent:
            if o.get("on_quota", "fail") != "stop":
                raise
            yield partition.tag, partition.month, None, '{"stopped": true}'


class PagedApi(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> PagedReader:
        return PagedReader(self.options)


def once(items: DataFrame) -> DataFrame:
    """Each item once, though several tags or overlapping windows bring it."""
    return items.groupBy("item_id").agg(F.min("item").alias("item"), F.sort_array(F.collect_set("tag")).alias("tags"))


def next_watermark(items: DataFrame, column: str = "last_activity_date") -> int | None:
    """Latest activity of a run: where the next one starts, less the overlap."""
    return items.agg(F.max(F.get_json_object("item", f"$.{column}").cast("bigint"))).first()[0]
