"""Landing folders: batches of JSON-lines files with a manifest."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.store import Files

MANIFEST = "_manifest.json"
KINDS = ("full", "incremental")
#: Batch ids name folders and parts of tables, so only plain characters.
SAFE_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.\-]*")
STAMP = "%Y-%m-%dT%H:%M:%SZ"


@dataclass(frozen=True)
class Batch:
    batch_id: str
    load_type: str
    path: str
    extracted_at: dt.datetime | None = None
    manifest: dict = field(default_factory=dict, hash=False)
    error: str = ""

    @property
    def batch_date(self) -> dt.date | None:
        return self.extracted_at.date() if self.extracted_at else None


def open_batch(files: Files, path: str, load_type: str) -> Batch:
    """A batch as its manifest describes it; what is wrong with it goes to ``error``."""
    name = path.rstrip("/").rpartition("/")[2]
    if not SAFE_ID.fullmatch(name):
        return Batch(name, load_type, path, error="unsafe batch id")
    if MANIFEST not in files.names(path):
        return Batch(name, load_type, path, error=f"missing {MANIFEST}")
    try:
        manifest = json.loads(files.read(f"{path}/{MANIFEST}"))
        at = dt.datetime.strptime(manifest["extracted_at_utc"], STAMP)
    except (ValueError, KeyError, TypeError) as e:
        return Batch(name, load_type, path, error=f"unreadable {MANIFEST}: {type(e).__name__} {e}")
    return Batch(name, manifest.get("load_type", load_type), path, at, manifest)


def discover(spark: SparkSession, root: str, load_type: str | None = None) -> list[Batch]:
    """All batches, full ones first, then by time and name; broken ones lead their kind."""
    files = Files(spark, root)
    found = []
    for kind in KINDS:
        if load_type in (None, kind):
            found += [open_batch(files, f"{root}/{kind}/{n}", kind) for n in files.names(f"{root}/{kind}") if not n.startswith((".", "_")) and files.is_folder(f"{root}/{kind}/{n}")]
    return sorted(found, key=lambda b: (KINDS.index(b.load_type) if b.load_type in KINDS else len(KINDS), b.extracted_at or dt.datetime.min, b.batch_id))


def chosen(batches: Iterable[Batch], ids: Sequence[str] | None = None, start: dt.date | None = None, end: dt.date | None = None) -> tuple[list[Batch], list[str]]:
    """(batches of the ids within the dates, ids that do not exist); dates are inclusive."""
    batches = list(batches)
    missing = sorted(set(ids or ()) - {b.batch_id for b in batches})
    out = [b for b in batches if ids is None or b.batch_id in ids]
    if start or end:
        out = [b for b in out if b.batch_date and (start is None or b.batch_date >= start) and (end is None or b.batch_date <= end)]
    return out, missing


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(value, file_path) of every line that is not blank; blanks other than spaces count as content."""
    return spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file_path")).where(F.length(F.trim("value")) > 0)


def write_batch(folder: str, load_type: str, extracted_at: dt.datetime, records: dict[str, list[dict | str]], files: Files | None = None) -> None:
    """A batch: one file per entity and the manifest; strings are written as they are.

    With ``files`` it goes to any file system that Spark writes, else to a local
    disk.  The manifest comes last, so a batch that has one is whole.
    """
    from pathlib import Path

    def create(name: str, text: str) -> None:
        if files:
            files.create(f"{folder}/{name}", text)
        else:
            Path(folder).mkdir(parents=True, exist_ok=True)
            (Path(folder) / name).write_text(text)

    sizes = {}
    for entity, rows in records.items():
        text = "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)
        create(f"{entity}.jsonl", text)
        sizes[f"{entity}.jsonl"] = {"records": len(rows), "bytes": len(text.encode())}
    create(MANIFEST, json.dumps({"load_type": load_type, "extracted_at_utc": extracted_at.strftime(STAMP), "files": sizes}))


def reconcile(known: DataFrame, seen: DataFrame, key: str, detected_at: int) -> DataFrame:
    """Tombstones of the known keys that a full look found no more."""
    return known.select(key).distinct().join(seen.select(key), key, "left_anti").select(key, F.lit(True).alias("is_deleted"), F.lit(detected_at).cast("bigint").alias("detected_at"))


def key_presence(lines_: DataFrame, column: str = "value") -> DataFrame:
    """Share of the records in which each top-level key occurs."""
    objs = lines_.where(F.json_object_keys(column).isNotNull())
    keys = objs.select(F.explode(F.array_distinct(F.json_object_keys(column))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("records"))
    total = objs.agg(F.count(F.lit(1))).scalar()
    return keys.select("key", "records", (F.col("records") / total).alias("share"))
