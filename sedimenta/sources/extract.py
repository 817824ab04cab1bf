"""From the paged API to landed batches: a full load by months, increments behind a stored watermark.

Pages are fetched on the executors; what they bring is cut once, so the service
is asked once however many files are made of it.  A batch is written by Spark
as folders of JSON lines, its manifest last.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.session import cut
from sedimenta.sources.api import IDS, PagedApi, Pages, QuotaSpent, next_watermark, once
from sedimenta.sources.landing import MANIFEST, STAMP, reconcile
from sedimenta.store import Files

STATE = "_state/watermark.json"
ITEM = "item_id bigint, item string"
#: Marks the place where a quota ran out: what came before it stays.
STOPPED = '{"stopped": true}'


def _field(name: str, kind: str = "bigint") -> Column:
    return F.get_json_object("item", f"$.{name}").cast(kind)


def pages(spark: SparkSession, base_url: str, **options: object) -> DataFrame:
    """Items of the API, once for each tag and window that brings them; a spent quota ends a partition with a marked row."""
    spark.dataSource.register(PagedApi)
    return spark.read.format("paged_api").options(base_url=base_url, on_quota="stop", **{k: str(v) for k, v in options.items()}).load()


def by_ids(ids: DataFrame, column: str, base_url: str, path: str, key: str, *, tasks: int = 8, **options: object) -> DataFrame:
    """(item_id, item) that the API has for known ids, IDS of them per request; ``path`` has a place for them."""
    fixed = {"site": str(options["site"])} if "site" in options else {}
    reserve, wait = int(options.get("reserve", 20)), float(options.get("wait", 5))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        api, waiting = Pages(base_url, reserve=reserve, wait=wait, **fixed), []

        def ask(some: list[int]) -> pd.DataFrame:
            found = [(x.get(key), json.dumps(x)) for x in api.by_ids(path, some)]
            return pd.DataFrame(found, columns=["item_id", "item"])

        try:
            for b in batches:
                waiting += [int(x) for x in b[column]]
                while len(waiting) >= IDS:
                    yield ask(waiting[:IDS])
                    waiting = waiting[IDS:]
            if waiting:
                yield ask(waiting)
        except QuotaSpent:
            yield pd.DataFrame([(None, STOPPED)], columns=["item_id", "item"])

    return ids.where(F.col(column).isNotNull()).select(column).distinct().repartition(tasks).mapInPandas(fetch, ITEM)


def land(spark: SparkSession, folder: str, load_type: str, at: dt.datetime, records: Mapping[str, DataFrame], facts: Mapping[str, object]) -> dict:
    """Write a batch of (item) texts per entity and return its manifest."""
    files = {}
    for entity, rows in records.items():
        kept = cut(rows.select(F.col("item").alias("value")))
        kept.write.text(f"{folder}/{entity}.jsonl")
        files[f"{entity}.jsonl"] = {"records": kept.count()}
    manifest = {"load_type": load_type, "extracted_at_utc": at.strftime(STAMP), "files": files, **facts}
    Files(spark, folder).create(f"{folder}/{MANIFEST}", json.dumps(manifest))
    return manifest


def _answers(questions: DataFrame, base_url: str, **options: object) -> DataFrame:
    answered = questions.where(F.coalesce(_field("answer_count"), F.lit(0)) > 0).select("item_id")
    return by_ids(answered, "item_id", base_url, "/questions/{ids}/answers", "answer_id", **options)


def _whole(items: DataFrame) -> DataFrame:
    return items.where("item_id IS NOT NULL").dropDuplicates(["item_id"])


def _stops(*items: DataFrame) -> int:
    return sum(x.where("item_id IS NULL").count() for x in items)


def full_load(spark: SparkSession, base_url: str, landing: str, tags: Sequence[str], start: str, end: str, *, answers: bool = True, now: dt.datetime | None = None, **options: object) -> dict:
    """Land the questions created in [start, end) that carry any of the tags, each once, and the answers to them."""
    raw = cut(pages(spark, base_url, tags=",".join(tags), start=start, end=end, **options))
    questions = once(raw.where("item_id IS NOT NULL"))
    replies = cut(_answers(questions, base_url, **options)) if answers else raw.limit(0).select("item_id", "item")
    facts = {"window_start": start, "window_end_exclusive": end, "tags": list(tags), "stopped_early": _stops(raw, replies)}
    at = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    return land(spark, f"{landing}/full/full_{start}_{end}", "full", at, {"questions": questions, "answers": _whole(replies)}, facts)


def watermark(spark: SparkSession, landing: str) -> int | None:
    """Latest activity that any increment has seen."""
    files = Files(spark, landing)
    return json.loads(files.read(f"{landing}/{STATE}"))["last_activity"] if "watermark.json" in files.names(f"{landing}/_state") else None


def keep_watermark(spark: SparkSession, landing: str, value: int) -> None:
    files = Files(spark, landing)
    files.remove(f"{landing}/{STATE}")
    files.create(f"{landing}/{STATE}", json.dumps({"last_activity": value}))


def incremental_load(
    spark: SparkSession, base_url: str, landing: str, tags: Sequence[str], *, since: int | None = None, known: DataFrame | None = None, now: dt.datetime | None = None, **options: object
) -> dict:
    """Land what was active since the watermark (less the overlap), and advance it.

    ``known`` ids are looked up again: those that are no more become tombstones,
    the others snapshots of their measures.  If the quota ran out the watermark
    stays, for what was missed is only found from there, and no id is taken for
    deleted.
    """
    since = watermark(spark, landing) if since is None else since
    if since is None:
        raise ValueError("no watermark is stored; give the time to start from")
    at = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    epoch = int(at.replace(tzinfo=dt.UTC).timestamp())
    raw = cut(pages(spark, base_url, tags=",".join(tags), since=since, **options))
    changed = once(raw.where("item_id IS NOT NULL"))
    replies = cut(_answers(changed, base_url, **options))
    records = {"questions": changed, "answers": _whole(replies)}
    stopped = _stops(raw, replies)
    if known is not None:
        alive = cut(by_ids(known.withColumnRenamed(known.columns[0], "question_id"), "question_id", base_url, "/questions/{ids}", "question_id", **options))
        lost = _stops(alive)
        stopped += lost
        seen = _whole(alive)
        shot = F.to_json(
            F.struct(
                F.col("item_id").alias("question_id"), F.lit(epoch).alias("snapshot_at"), *[_field(c).alias(c) for c in ("score", "view_count", "answer_count")],
                _field("is_answered", "boolean").alias("is_answered"), _field("closed_date").alias("closed_date"),
            ),
            {"ignoreNullFields": "false"},
        )
        gone = reconcile(known.withColumnRenamed(known.columns[0], "question_id"), seen.select(F.col("item_id").alias("question_id")), "question_id", epoch)
        records |= {"question_snapshots": seen.select(shot.alias("item")), "deleted_questions": (gone.limit(0) if lost else gone).select(F.to_json(F.struct(*gone.columns)).alias("item"))}
    following = next_watermark(changed)
    facts = {"since": since, "tags": list(tags), "stopped_early": stopped, "next_watermark": since if stopped or following is None else max(since, following)}
    manifest = land(spark, f"{landing}/incremental/incr_{at:%Y%m%dT%H%M%SZ}", "incremental", at, records, facts)
    keep_watermark(spark, landing, facts["next_watermark"])
    return manifest
