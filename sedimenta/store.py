"""Versioned tables on plain Parquet: copy on write by parts, with a commit log.

A table is a set of parts (hash buckets of its key, or values of a column).  A
version is a log entry that tells which parts got new folders since the one
before; writing touches only the parts that change and then adds the next entry,
which fails if another writer was first.  Every so many entries a snapshot names
all parts, so that neither an entry nor reading a version grows with the history.
Old entries give time travel.
"""

from __future__ import annotations

import datetime as dt
import json
import urllib.parse
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.contracts import ddl_of
from sedimenta.operators.merge import ACTION, MergeSpec, merge
from sedimenta.session import cut

PART = "__part"
EMPTY = "__none__"
#: Entries between two snapshots of the log; bytes that a bucket should hold at most; tasks that may write one part.
SNAPSHOT_EVERY, PART_BYTES, SPREAD = 32, 1 << 30, 64


class Files:
    """The few file operations a table needs, on any file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path(root).getFileSystem(self.conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def is_folder(self, path: str) -> bool:
        return self.fs.exists(self._path(path)) and self.fs.getFileStatus(self._path(path)).isDirectory()

    def read(self, path: str) -> str:
        stream = self.fs.open(self._path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> None:
        """Write a new file; an existing one is an error."""
        stream = self.fs.create(self._path(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def size(self, path: str) -> int:
        return self.fs.getContentSummary(self._path(path)).getLength()

    def remove(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


@dataclass(frozen=True)
class Version:
    number: int
    operation: str
    columns: Mapping[str, str]
    parts: Mapping[str, str]
    metrics: Mapping[str, int]
    at: str
    buckets: int


class VersionedTable:
    """A keyed table at ``path``; ``part_by`` names the column whose values are the parts, else ``buckets`` of the key are."""

    def __init__(self, spark: SparkSession, path: str, columns: Mapping[str, str], keys: Sequence[str], *, part_by: Sequence[str] = (), buckets: int = 16) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.part_by, self.buckets = list(part_by), buckets
        self.files = Files(spark, self.path)
        self._declared = {k: f"struct<{ddl_of(v, True)}>" if isinstance(v, dict) else v for k, v in columns.items()}

    # --- log
    def _log(self) -> tuple[list[int], list[int]]:
        """(numbers of all entries, numbers of those with a snapshot)."""
        names = [n.split(".") for n in self.files.names(f"{self.path}/_log") if n.endswith(".json") and not n.startswith((".", "_"))]
        return sorted({int(n[0]) for n in names}), sorted(int(n[0]) for n in names if n[1] == "snapshot")

    def versions(self) -> list[int]:
        return self._log()[0]

    def version(self, number: int | None = None) -> Version:
        known, snapshots = self._log()
        if not known:
            return Version(0, "none", self._declared, {}, {}, "", self.buckets)
        number = known[-1] if number is None else number
        start = max([n for n in snapshots if n <= number], default=None)
        parts: dict[str, str] = {}
        entry: dict = {}
        if start is not None:
            entry = json.loads(self.files.read(f"{self.path}/_log/{start:08d}.snapshot.json"))
            parts = entry.pop("parts")
        for n in [n for n in known if n <= number and (start is None or n > start)]:
            entry = json.loads(self.files.read(f"{self.path}/_log/{n:08d}.json"))
            for gone in entry.pop("removed"):
                parts.pop(gone, None)
            parts |= entry.pop("added")
        if entry.get("number") != number:
            raise ValueError(f"no version {number}")
        return Version(parts=parts, **entry)

    def history(self) -> list[Version]:
        return [self.version(n) for n in self.versions()]

    def _commit(self, operation: str, base: Version, parts: Mapping[str, str], metrics: Mapping[str, int], columns: Mapping[str, str], buckets: int | None = None) -> Version:
        new = Version(base.number + 1, operation, dict(columns), dict(parts), dict(metrics), dt.datetime.now(dt.UTC).isoformat(), buckets or base.buckets)
        entry = {k: v for k, v in new.__dict__.items() if k != "parts"}
        entry |= {"added": {k: v for k, v in parts.items() if base.parts.get(k) != v}, "removed": sorted(set(base.parts) - set(parts))}
        self.files.create(f"{self.path}/_log/{new.number:08d}.json", json.dumps(entry))
        if new.number % SNAPSHOT_EVERY == 0:
            self._snapshot(new)
        return new

    def _snapshot(self, version: Version) -> None:
        name = f"{version.number:08d}.snapshot.json"
        if name not in self.files.names(f"{self.path}/_log"):
            self.files.create(f"{self.path}/_log/{name}", json.dumps(version.__dict__))

    def create(self) -> Version:
        """An empty first version, if the table has none."""
        base = self.version()
        return base if base.number else self._commit("create", base, {}, {}, base.columns)

    # --- data
    def part(self, buckets: int) -> Column:
        if self.part_by:
            return F.concat_ws("~", *[F.coalesce(F.col(c).cast("string"), F.lit(EMPTY)) for c in self.part_by])
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("string")

    def read(self, number: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """A version, or some of its parts; columns that a file lacks are null."""
        at = self.version(number)
        ddl = ddl_of(dict(at.columns))
        folders = [f"{self.path}/{p}" for k, p in at.parts.items() if parts is None or k in parts]
        if not folders:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*folders)

    def _write(self, df: DataFrame, buckets: int, by: Sequence[str] = ()) -> dict[str, str]:
        """Write rows by part into a new folder: part -> folder.

        A part of any size is written by up to SPREAD tasks, or in ranges of
        ``by``; adaptive execution joins those of small parts.
        """
        folder = f"data/{uuid.uuid4().hex}"
        rows = df.withColumn(PART, self.part(buckets))
        if by:
            rows = rows.repartitionByRange(PART, *by).sortWithinPartitions(PART, *by)
        else:
            rows = rows.repartition(PART, F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(SPREAD))).sortWithinPartitions(PART, *self.keys)
        rows.write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        names = [n for n in self.files.names(f"{self.path}/{folder}") if n.startswith(f"{PART}=")]
        return {urllib.parse.unquote(n.partition("=")[2]): f"{folder}/{n}" for n in names}

    def overwrite(self, df: DataFrame, operation: str = "overwrite") -> Version:
        base = self.version()
        return self._commit(operation, base, self._write(df.select(*base.columns), base.buckets), {}, base.columns)

    def replace_parts(self, df: DataFrame, parts: Sequence[str], *, new_columns: Mapping[str, str] | None = None, operation: str = "replace") -> Version:
        """Replace the given parts by ``df``, also by nothing; ``new_columns`` join the schema."""
        base = self.version()
        columns = dict(base.columns) | dict(new_columns or {})
        filled = df.select(*[F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])
        written = self._write(filled, base.buckets)
        if outside := set(written) - set(parts):
            raise ValueError(f"rows outside the replaced parts: {sorted(outside)[:5]}")
        kept = {k: v for k, v in base.parts.items() if k not in set(parts)}
        return self._commit(operation, base, kept | written, {}, columns)

    def merge(self, source: DataFrame, spec: MergeSpec, *, operation: str = "merge", unique: bool = True, settled: bool = False) -> dict[str, int]:
        """Merge and commit if anything changed; rows inserted, updated and deleted.

        The source is computed once (``settled``: it is cut already).  The join
        first tells which parts hold a changed row; only those are joined again
        and written, so a replay writes nothing, and a sync of a large table
        rewrites what differs.  A merge by the table's key reads only parts that
        hold a key of the source, unless it deletes unmatched rows.
        """
        source = source if settled else cut(source)
        base = self.version()
        by_key = list(spec.keys) == self.keys and not self.part_by and all(k.isdigit() for k in base.parts)
        part = self.part(base.buckets)
        touched = None
        if unique or by_key:
            keyed = source.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("__n")).withColumn("__p", part if by_key else F.lit(""))
            of_source = keyed.agg(F.max("__n").alias("most"), F.collect_set("__p").alias("parts")).first()  # at most one entry per bucket
            if unique and (of_source["most"] or 0) > 1:
                raise ValueError(f"the source has several rows for one key {list(spec.keys)}")
            if by_key and not spec.delete_unmatched:
                touched = of_source["parts"]
        if touched is not None and not touched:
            return {"inserted": 0, "updated": 0, "deleted": 0}
        merged = merge(self.read(parts=touched).select(*base.columns), source, spec)
        counts = [F.count_if(F.col(ACTION) == a).alias(name) for a, name in (("I", "inserted"), ("U", "updated"), ("D", "deleted"))]
        changed = merged.where(F.col(ACTION) != "K").groupBy(part.alias("__p")).agg(*counts).collect()  # at most one row per part
        metrics = {name: sum(r[name] for r in changed) for name in ("inserted", "updated", "deleted")}
        if not changed:
            return metrics
        parts = [r["__p"] for r in changed]
        if by_key:  # rows meet within a part
            merged = merge(self.read(parts=parts).select(*base.columns), source.where(part.isin(parts)), spec)
        elif not spec.insert and not spec.delete_unmatched:
            merged = merge(self.read(parts=parts).select(*base.columns), source, spec)
        else:  # a source row may have its match in another part
            merged = merged.where(part.isin(parts))
        written = self._write(merged.where(F.col(ACTION) != "D").drop(ACTION), base.buckets)
        kept = {k: v for k, v in base.parts.items() if k not in set(parts)}
        self._commit(operation, base, kept | written, metrics, base.columns)
        return metrics

    def append(self, df: DataFrame, name: str | None = None) -> Version:
        """Add rows as a part of their own."""
        base = self.version()
        folder = f"data/{uuid.uuid4().hex}"
        df.select(*[F.col(c).cast(t).alias(c) for c, t in base.columns.items()]).write.parquet(f"{self.path}/{folder}")
        return self._commit("append", base, dict(base.parts) | {name or folder: folder}, {}, base.columns)

    def size(self) -> int:
        """Bytes of the current version."""
        return sum(self.files.size(f"{self.path}/{p}") for p in self.version().parts.values())

    def compact(self, by: Sequence[str]) -> Version:
        """Rewrite clustered by ``by`` within the parts: ranges of it per file, sorted, so that scans skip files and row groups.

        Buckets stay buckets, so later merges touch as few as before; a table
        that has outgrown PART_BYTES per bucket gets twice as many until it fits.
        """
        base = self.version()
        buckets = base.buckets
        if not self.part_by:
            bytes_ = self.size()
            while bytes_ > buckets * PART_BYTES:
                buckets *= 2
        written = self._write(self.read(), buckets, by)
        return self._commit(f"compact by {', '.join(by)}", base, written, {}, base.columns, buckets)

    def gather(self, most: int = 64) -> bool:
        """Put appended parts together once there are more than ``most``."""
        base = self.version()
        if len(base.parts) <= most:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        self.read().repartition(F.pmod(F.xxhash64(*self.keys), F.lit(SPREAD))).write.parquet(f"{self.path}/{folder}")
        self._commit("gather", base, {folder: folder}, {}, base.columns)
        return True

    def vacuum(self, keep: int = 2) -> int:
        """Remove folders that only versions before the last ``keep`` name; their log entries go too."""
        numbers = self.versions()
        old, live = numbers[:-keep], numbers[-keep:]
        if not old:
            return 0
        used = {p for n in live for p in self.version(n).parts.values()}
        gone = {p for n in old for p in self.version(n).parts.values()} - used
        self._snapshot(self.version(live[0]))  # what follows builds on it
        for p in gone:
            self.files.remove(f"{self.path}/{p}")
        for n in old:
            for name in (f"{n:08d}.json", f"{n:08d}.snapshot.json"):
                self.files.remove(f"{self.path}/_log/{name}")
        return len(gone)

    def key_faults(self) -> int:
        """Keys that are null or occur more than once."""
        bad = F.lit(False)
        for k in self.keys:
            bad = bad | F.col(k).isNull()
        return self.read().groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).where(bad | (F.col("n") > 1)).count()
