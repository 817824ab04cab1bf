"""Runs of the three layers: which batches, in what order, with what outcome."""

from __future__ import annotations

import contextlib
import datetime as dt
import json
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.contracts import CONTRACTS, LINEAGE, QUARANTINE, tree_of
from sedimenta.functions.columns import row_hash
from sedimenta.ingest import load_files
from sedimenta.operators import merge as m
from sedimenta.operators.merge import s, t
from sedimenta.operators.select import dead_letters, split_by_rules
from sedimenta.plans import gold, silver
from sedimenta.plans.settings import SALT, TAG_CATEGORIES, TRACKED
from sedimenta.session import cut
from sedimenta.sources.landing import Batch, chosen, discover
from sedimenta.store import Files, VersionedTable

REGISTRY = tree_of(
    "batch_id string, load_type string, batch_date date, extracted_at timestamp, landing_path string, manifest_json string, bronze_status string, "
    "bronze_loaded_at timestamp, silver_status string, silver_processed_at timestamp, load_timestamp timestamp"
)
AUDIT = tree_of(
    "log_id string, run_id string, pipeline_name string, layer string, run_mode string, load_type string, entity string, batch_id string, source_parameter string, target_table string, "
    "start_time timestamp, end_time timestamp, duration_seconds double, status string, rows_read bigint, rows_inserted bigint, rows_updated bigint, rows_deleted bigint, "
    "rows_quarantined bigint, message string, load_timestamp timestamp"
)
DRIFT = tree_of("event_id string, run_id string, _batch_id string, entity string, drift_type string, column_path string, record_count bigint, example_value string, action_taken string, load_timestamp timestamp")
DEAD = tree_of("dq_id string, entity string, record_key string, failed_rule string, source_batch_id string, record_json string, load_timestamp timestamp")
STAMPS = tree_of("first_loaded_at timestamp, load_timestamp timestamp")
MODES = ("incremental", "backfill")


@dataclass
class Step:
    """One entry of the audit log."""

    pipeline: str
    layer: str
    entity: str
    target: str = ""
    batch_id: str | None = None
    source: str = ""
    mode: str = "incremental"
    load_type: str = "mixed"
    status: str = "SUCCESS"
    rows_read: int = 0
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    quarantined: int = 0
    message: str = ""
    started: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))

    def take(self, metrics: dict[str, int]) -> None:
        self.inserted, self.updated, self.deleted = metrics["inserted"], metrics["updated"], metrics["deleted"]


class Lakehouse:
    """All tables under one folder, and the runs over them."""

    def __init__(self, spark: SparkSession, root: str, landing: str, *, salt: str | None = None, tracked: Sequence[str] = TRACKED, evolve: bool = True) -> None:
        self.spark, self.root, self.landing = spark, root, landing
        self.salt = salt or os.environ.get("SEDIMENTA_SALT", SALT)
        self.tracked, self.evolve = tuple(tracked), evolve
        self.run_id = uuid.uuid4().hex

    # --- tables
    def table(self, name: str, columns: dict, keys: Sequence[str], **kw) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name.replace('.', '/')}", columns, keys, **kw)

    def bronze(self, entity: str) -> VersionedTable:
        c = CONTRACTS[entity]
        return self.table(f"bronze.{entity}", c.tree | LINEAGE, [*c.keys, "_batch_id"], part_by=["_batch_id"])

    @cached_property
    def quarantine(self) -> VersionedTable:
        return self.table("bronze.quarantine_records", QUARANTINE, ["quarantine_id"], part_by=["entity", "_batch_id"])

    @cached_property
    def registry(self) -> VersionedTable:
        return self.table("ops.batch_registry", REGISTRY, ["batch_id"], buckets=1)

    @cached_property
    def audit(self) -> VersionedTable:
        return self.table("ops.pipeline_execution_logs", AUDIT, ["log_id"])

    @cached_property
    def drift(self) -> VersionedTable:
        return self.table("ops.schema_drift_events", DRIFT, ["event_id"], buckets=1)

    def setup(self) -> list[str]:
        """Create the declared tables that are not there yet; the refined ones come with their first rows."""
        tables = {f"bronze.{e}": self.bronze(e) for e in CONTRACTS} | {
            "bronze.quarantine_records": self.quarantine, "ops.batch_registry": self.registry, "ops.pipeline_execution_logs": self.audit, "ops.schema_drift_events": self.drift,
        }
        made = [name for name, t_ in tables.items() if not t_.versions()]
        for name in made:
            tables[name].create()
        return made

    def maintain(self, keep: int = 2) -> dict[str, int]:
        """Gather the appended log and remove the folders that only old versions of any table name: table -> folders removed."""
        self.audit.gather()
        files = Files(self.spark, self.root)
        out = {}
        for layer in files.names(self.root):
            for name in files.names(f"{self.root}/{layer}") if files.is_folder(f"{self.root}/{layer}") else []:
                out[f"{layer}.{name}"] = self.table(f"{layer}.{name}", {}, []).vacuum(keep)
        return out

    # --- audit
    @contextlib.contextmanager
    def step(self, record: Step, *, strict: bool = False) -> Iterator[Step]:
        """Log what happens inside, also if it fails; a failure ends the step, not the run, unless ``strict``."""
        try:
            yield record
        except Exception as e:  # noqa: BLE001 - the log keeps the reason
            record.status, record.message = "FAILED", f"{type(e).__name__}: {e}"[:2000]
            if strict:
                raise
        finally:
            self._log(record)

    def _log(self, *records: Step) -> None:
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        rows = [
            (
                uuid.uuid4().hex, self.run_id, r.pipeline, r.layer, r.mode, r.load_type, r.entity, r.batch_id, r.source, r.target, r.started, now, (now - r.started).total_seconds(),
                r.status, r.rows_read, r.inserted, r.updated, r.deleted, r.quarantined, r.message, now,
            )
            for r in records
        ]
        with contextlib.suppress(Exception):  # a log that cannot be written never hides the outcome
            if rows:
                self.audit.append(self.spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in AUDIT.items())))

    @staticmethod
    def _mode(mode: str, ids: object, start: object, end: object) -> None:
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if mode == "backfill" and not (ids or start or end):
            raise ValueError("a backfill needs batch ids or dates")

    # --- raw to bronze
    def raw_to_bronze(self, mode: str = "incremental", *, load_type: str | None = None, batch_ids: Sequence[str] | None = None, start: dt.date | None = None, end: dt.date | None = None, fail_on_error: bool = True) -> dict[str, int]:
        self._mode(mode, batch_ids, start, end)
        batches, missing = chosen(discover(self.spark, self.landing, load_type), batch_ids, start, end)
        failed = 0
        for x in missing:
            self._log(Step("raw_to_bronze", "Raw-to-Bronze", "batch", batch_id=x, mode=mode, status="FAILED", message="no such batch"))
            failed += 1
        done = {r["batch_id"] for r in self.registry.read().where("bronze_status = 'SUCCESS'").select("batch_id").collect()}  # a row per batch
        todo, notes = [], []
        for b in batches:
            if b.error or (mode == "incremental" and b.batch_id in done):
                status, message = ("FAILED", b.error) if b.error else ("SKIPPED", "loaded before")
                notes.append(Step("raw_to_bronze", "Raw-to-Bronze", "batch", batch_id=b.batch_id, source=b.path, mode=mode, status=status, message=message))
            else:
                todo.append(b)
        self._log(*notes)
        skipped = sum(n.status == "SKIPPED" for n in notes)
        good = self._load_batches(todo, mode) if todo else {}
        loaded = sum(good.values())
        failed += len(notes) - skipped + len(good) - loaded
        if failed and fail_on_error:
            raise RuntimeError(f"{failed} batches failed")
        return {"loaded": loaded, "skipped": skipped, "failed": failed}

    def _load_batches(self, batches: Sequence[Batch], mode: str) -> dict[str, bool]:
        """Load all batches, one entity after another, and enter them into the registry; batch -> whether all of it came in."""
        files = Files(self.spark, self.landing)
        present = {b.batch_id: set(files.names(b.path)) for b in batches}
        good = {i: bool(names & {f"{e}.jsonl" for e in CONTRACTS}) for i, names in present.items()}
        for entity in CONTRACTS:
            having = [b for b in batches if f"{entity}.jsonl" in present[b.batch_id]]
            for record in self._load_entity(having, entity, mode) if having else []:
                good[record.batch_id] &= record.status == "SUCCESS"
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        rows = [(b.batch_id, b.load_type, b.batch_date, b.extracted_at, b.path, json.dumps(b.manifest), "SUCCESS" if good[b.batch_id] else "FAILED", now, None, None, now) for b in batches]
        source = self.spark.createDataFrame(rows, ", ".join(f"{k} {v}" for k, v in REGISTRY.items()))
        kept = ("batch_id", "silver_status", "silver_processed_at")
        self.registry.merge(source, m.MergeSpec(["batch_id"], {c: s(c) for c in REGISTRY if c not in kept}))
        return good

    def _load_entity(self, batches: Sequence[Batch], entity: str, mode: str) -> list[Step]:
        """The files of one entity in one scan; if that fails, batch by batch, so that a broken one fails alone."""
        records = [Step("raw_to_bronze", "Raw-to-Bronze", entity, f"bronze.{entity}", b.batch_id, f"{b.path}/{entity}.jsonl", mode, b.load_type) for b in batches]
        try:
            self._write_entity(batches, entity, records)
        except Exception as e:  # noqa: BLE001 - the log keeps the reason
            if len(batches) > 1:
                return [r for b in batches for r in self._load_entity([b], entity, mode)]
            records[0].status, records[0].message = "FAILED", f"{type(e).__name__}: {e}"[:2000]
        self._log(*records)
        return records

    def _write_entity(self, batches: Sequence[Batch], entity: str, records: Sequence[Step]) -> None:
        table, ids, now = self.bronze(entity), [b.batch_id for b in batches], records[0].started
        out = load_files(self.spark, batches, CONTRACTS[entity], dict(table.version().columns), evolve=self.evolve, now=now)
        table.replace_parts(out.good, ids, new_columns=out.new_columns)
        parts = [f"{entity}~{i}" for i in ids]
        if out.rejected_lines or set(parts) & set(self.quarantine.version().parts):
            self.quarantine.replace_parts(out.rejected, parts)
        stamped = out.drift.withColumns({"run_id": F.lit(self.run_id), "entity": F.lit(entity), "load_timestamp": F.lit(now).cast("timestamp")})
        events = stamped.withColumn("event_id", F.sha2(F.concat_ws("|", "_batch_id", "entity", "drift_type", "column_path"), 256)).select(*DRIFT)
        self.drift.merge(events, m.upsert_always(list(DRIFT), ["event_id"]))
        for r in records:
            r.rows_read, r.inserted = out.counts[r.batch_id]
            r.quarantined = r.rows_read - r.inserted

    # --- bronze to silver
    def pending(self, mode: str, ids: Sequence[str] | None, start: dt.date | None, end: dt.date | None) -> list[str]:
        """Batches to refine, in order of extraction."""
        ready = self.registry.read().where("bronze_status = 'SUCCESS'")
        if mode == "incremental":
            ready = ready.where("silver_processed_at IS NULL OR silver_processed_at < bronze_loaded_at OR coalesce(silver_status, '') <> 'SUCCESS'")
        if ids:
            ready = ready.where(F.col("batch_id").isin(list(ids)))
        if start:
            ready = ready.where(F.col("batch_date") >= F.lit(start))
        if end:
            ready = ready.where(F.col("batch_date") <= F.lit(end))
        return [r["batch_id"] for r in ready.orderBy("extracted_at").select("batch_id").collect()]  # a row per batch

    def _raw(self, entity: str, ids: Sequence[str]) -> DataFrame:
        return self.bronze(entity).read(parts=ids)

    def silver_table(self, name: str, keys: Sequence[str], shape: DataFrame) -> VersionedTable:
        return self.table(f"silver.{name}", dict(shape.dtypes), keys)

    def _stamped(self, df: DataFrame, now: dt.datetime, *, first: bool = True) -> DataFrame:
        stamps = {"load_timestamp": F.lit(now).cast("timestamp")}
        return df.withColumns(({"first_loaded_at": F.lit(now).cast("timestamp")} if first else {}) | stamps)

    def _clean(self, df: DataFrame, rules: dict, entity: str, key: str, r: Step) -> DataFrame:
        """Rows that hold the rules; the others go to the dead letters."""
        good, bad = split_by_rules(df, rules)
        letters = self._stamped(dead_letters(bad, entity, key, "source_batch_id"), r.started, first=False).select(*DEAD)
        table = self.table("silver.dq_quarantine", DEAD, ["dq_id"])
        r.quarantined = table.merge(letters, m.insert_only(["dq_id"]))["inserted"]
        return good

    def _questions(self, ids: Sequence[str], r: Step) -> None:
        raw = self._raw("questions", ids)
        r.rows_read = raw.count()
        df = self._stamped(cut(self._clean(silver.questions(raw, self.salt, self.tracked), silver.rules("questions"), "questions", "question_id", r)), r.started)
        guarded = ["score", "view_count", "answer_count", "is_answered_api", "has_any_answer"]
        spec = m.newer_with_guard(df.columns, ["question_id"], "source_extracted_at", "record_hash", guarded=guarded, as_of="metrics_as_of", deleted="is_deleted", deleted_at="deleted_detected_at", keep=["first_loaded_at"])
        r.take(self.silver_table("questions", ["question_id"], df).merge(df, spec, settled=True))

    def _tags(self, ids: Sequence[str], r: Step) -> None:
        raw = self._raw("questions", ids)
        r.rows_read = raw.count()
        # a batch speaks for a question only if it supplied the version that stands
        standing = self.table("silver.questions", {}, ["question_id"]).read().select("question_id", F.col("source_batch_id").alias("b"), F.col("source_extracted_at").alias("e"))
        winners = raw.join(standing, (raw["question_id"] == standing["question_id"]) & (raw["_batch_id"] == standing["b"]) & (raw["_extracted_at"] == standing["e"]), "left_semi")
        wanted = self._stamped(silver.question_tags(winners, self.tracked), r.started, first=False)
        table = self.table("silver.question_tags", dict(wanted.dtypes), ["question_id", "tag"])
        changes = m.bridge_changes(table.read(), wanted, winners, "question_id", ["question_id", "tag"])
        r.take(table.merge(changes, m.bridge_sync(["question_id", "tag"], "is_tracked_tag", carry=["source_batch_id", "load_timestamp"])))

    def _answers(self, ids: Sequence[str], r: Step) -> None:
        raw = self._raw("answers", ids)
        r.rows_read = raw.count()
        df = self._stamped(cut(self._clean(silver.answers(raw, self.salt), silver.rules("answers"), "answers", "answer_id", r)), r.started)
        spec = m.newer_and_different(df.columns, ["answer_id"], "source_extracted_at", "record_hash", ["first_loaded_at", "is_deleted", "deleted_detected_at"])
        r.take(self.silver_table("answers", ["answer_id"], df).merge(df, spec, settled=True))

    def _users(self, ids: Sequence[str], r: Step) -> None:
        df = self._stamped(silver.users(self._raw("questions", ids), self._raw("answers", ids), self.salt), r.started)
        spec = m.span_and_profile(["user_key"], "source_extracted_at", profile=["user_type", "reputation", "accept_rate"], first="first_seen_at", last="last_seen_at", stamp="load_timestamp")
        r.take(self.silver_table("users", ["user_key"], df).merge(df, spec))

    def _snapshots(self, ids: Sequence[str], r: Step) -> None:
        raw = self._raw("question_snapshots", ids)
        r.rows_read = raw.count()
        df = self._stamped(silver.snapshots(raw), r.started, first=False)
        r.take(self.silver_table("question_snapshots", ["question_id", "snapshot_at"], df).merge(df, m.insert_only(["question_id", "snapshot_at"])))

    def _apply_snapshots(self, ids: Sequence[str], r: Step) -> None:
        shots = self.table("silver.question_snapshots", {}, ["question_id", "snapshot_at"]).read().where(F.col("source_batch_id").isin(list(ids)))
        cols = ["score", "view_count", "answer_count", "is_answered_api"]
        last = shots.groupBy("question_id").agg(F.max(F.struct("snapshot_at", *cols)).alias("x")).select("question_id", "x.*")
        updates = {c: s(c) for c in cols} | {"has_any_answer": F.coalesce(s("answer_count"), F.lit(0)) > 0, "metrics_as_of": s("snapshot_at"), "load_timestamp": F.lit(r.started).cast("timestamp")}
        r.take(self.table("silver.questions", {}, ["question_id"]).merge(last, m.update_only(["question_id"], updates, s("snapshot_at") > t("metrics_as_of"))))

    def _deletions(self, target: str, key: str) -> Callable[[Sequence[str], Step], None]:
        def run(ids: Sequence[str], r: Step) -> None:
            raw = self._raw("deleted_questions", ids)
            r.rows_read = raw.count()
            late = ~t("is_deleted") & (t("source_extracted_at") < s("deleted_detected_at"))
            updates = {"is_deleted": F.lit(True), "deleted_detected_at": s("deleted_detected_at"), "load_timestamp": F.lit(r.started).cast("timestamp")}
            r.take(self.table(f"silver.{target}", {}, [key]).merge(silver.tombstones(raw), m.update_only(["question_id"], updates, late)))

        return run

    def _post_text(self, ids: Sequence[str], r: Step) -> None:
        df = self._stamped(silver.post_text(self._raw("questions", ids), self._raw("answers", ids)), r.started, first=False)
        spec = m.newer_and_different(df.columns, ["post_type", "post_id"], "source_extracted_at", "record_hash")
        r.take(self.silver_table("post_text_masked", ["post_type", "post_id"], df).merge(df, spec))

    def bronze_to_silver(self, mode: str = "incremental", *, batch_ids: Sequence[str] | None = None, start: dt.date | None = None, end: dt.date | None = None) -> dict[str, str]:
        """The silver steps in order; a failed one is logged and the rest still run."""
        self._mode(mode, batch_ids, start, end)
        ids = self.pending(mode, batch_ids, start, end)
        if not ids:
            self._log(Step("bronze_to_silver", "Bronze-to-Silver", "all", mode=mode, status="SKIPPED", message="nothing to refine"))
            return {}
        steps = {
            "questions": self._questions, "question_tags": self._tags, "answers": self._answers, "users": self._users, "question_snapshots": self._snapshots, "apply_snapshots": self._apply_snapshots,
            "delete_questions": self._deletions("questions", "question_id"), "delete_answers": self._deletions("answers", "answer_id"), "post_text_masked": self._post_text,
        }
        outcome = {}
        for name, run in steps.items():
            record = Step("bronze_to_silver", "Bronze-to-Silver", name, f"silver.{name}", source=",".join(ids), mode=mode)
            with self.step(record):
                run(ids, record)
            outcome[name] = record.status
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        status = "SUCCESS" if set(outcome.values()) == {"SUCCESS"} else "FAILED"
        marks = self.spark.createDataFrame([(x, status, now) for x in ids], "batch_id string, silver_status string, silver_processed_at timestamp")
        self.registry.merge(marks, m.update_only(["batch_id"], {"silver_status": s("silver_status"), "silver_processed_at": s("silver_processed_at")}, F.lit(True)))
        return outcome

    # --- silver to gold
    def silver_to_gold(self, *, optimize: bool = False) -> dict[str, str]:
        """Recompute the star schema and sync each table; rows that did not change keep their stamp."""
        read = lambda name, *keys: self.table(f"silver.{name}", {}, keys).read()
        q, a, tags = gold.alive(read("questions", "question_id"), read("answers", "answer_id"), read("question_tags", "question_id", "tag"))
        base = cut(gold.base(q, a))  # feeds two tables
        products: dict[str, tuple[Sequence[str], Callable[[], DataFrame]]] = {
            "dim_date": (["date_key"], lambda: gold.dim_date(q, a)),
            "dim_tag": (["tag"], lambda: gold.dim_tag(tags, self.tracked, TAG_CATEGORIES)),
            "dim_user": (["user_key"], lambda: gold.dim_user(read("users", "user_key"), q, a)),
            "fact_question": (["question_id"], lambda: gold.fact_question(base)),
            "fact_answer": (["answer_id"], lambda: gold.fact_answer(q, a)),
            "bridge_question_tag": (["question_id", "tag"], lambda: gold.bridge(tags, self.tracked)),
            "agg_tag_month": (["tag", "month_start"], lambda: gold.agg_tag_month(base, a, tags, self.tracked, TAG_CATEGORIES)),
            "agg_tag_pairs": (["tag_a", "tag_b"], lambda: gold.agg_tag_pairs(tags, self.tracked, TAG_CATEGORIES)),
            "agg_user_cohort": (["cohort_month", "months_since"], lambda: gold.agg_user_cohort(q, a)),
        }
        outcome = {}
        for name, (keys, make) in products.items():
            record = Step("silver_to_gold", "Silver-to-Gold", name, f"gold.{name}")
            with self.step(record):
                df = make()
                df = df.withColumn("record_hash", row_hash(df.columns)).withColumn("load_timestamp", F.lit(record.started).cast("timestamp"))
                table = self.table(f"gold.{name}", dict(df.dtypes), keys)
                record.take(table.merge(df, m.full_sync(df.columns, list(keys), "record_hash"), operation="sync"))
            outcome[name] = record.status
        if optimize:
            for name, by in {"fact_question": "created_date_key", "fact_answer": "created_date_key", "bridge_question_tag": "tag", "agg_tag_month": "month_start"}.items():
                record = Step("silver_to_gold", "Silver-to-Gold", "optimize", f"gold.{name}", message=f"clustered by {by}")
                with self.step(record):
                    self.table(f"gold.{name}", {}, products[name][0]).compact([by])
        return outcome
