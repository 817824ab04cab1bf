"""Keyed upserts as joins: a declarative specification and the plan it means.

The result of a merge is a DataFrame; nothing is updated in place.  Each row
tells in ``_action`` what happened to it: K kept, U updated, I inserted, D
deleted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTION = "_action"


def t(name: str) -> Column:
    """A column of the target row."""
    return F.col(f"__t_{name}")


def s(name: str) -> Column:
    """A column of the source row."""
    return F.col(f"__s_{name}")


@dataclass(frozen=True)
class MergeSpec:
    """What a merge does.

    ``updates`` maps target columns to expressions of ``t`` and ``s``; columns
    it leaves out keep their value.  ``when`` is the condition for an update of
    a matched row (unknown counts as false), ``delete_when`` for its removal.
    ``insert`` tells whether unmatched source rows come in, ``insert_when``
    which of them, ``delete_unmatched`` whether target rows without source go.
    """

    keys: Sequence[str]
    updates: Mapping[str, Column] = field(default_factory=dict)
    when: Column | None = None
    delete_when: Column | None = None
    insert: bool = True
    insert_when: Column | None = None
    delete_unmatched: bool = False
    inserts: Mapping[str, Column] = field(default_factory=dict)


def merge(target: DataFrame, source: DataFrame, spec: MergeSpec) -> DataFrame:
    """The merged table with ``_action``; drop rows with D for the new state.

    Keys match by equality, so null keys match nothing.  ``source`` must have
    one row per key; target rows may share a key and are updated alike.
    """
    cols, keys = target.columns, list(spec.keys)
    left = target.select(*[F.col(c).alias(f"__t_{c}") for c in cols], F.lit(True).alias("__in_t"))
    right = source.select(*[F.col(c).alias(f"__s_{c}") for c in source.columns], F.lit(True).alias("__in_s"))
    on = [t(k) == s(k) for k in keys]
    # update-only merges never bring in a source row, sync merges need both sides
    both = left.join(right, on, "full" if spec.insert else "left")
    matched = F.col("__in_t").isNotNull() & F.col("__in_s").isNotNull()
    update = F.coalesce(spec.when, F.lit(False)) if spec.when is not None else F.lit(bool(spec.updates))
    delete = F.coalesce(spec.delete_when, F.lit(False)) if spec.delete_when is not None else F.lit(False)
    new = F.coalesce(spec.insert_when, F.lit(False)) if spec.insert_when is not None else F.lit(True)
    action = (
        F.when(matched & delete, "D").when(matched & update, "U").when(matched, "K")
        .when(F.col("__in_t").isNotNull(), "D" if spec.delete_unmatched else "K")
        .when(new, "I")
    )
    acted = both.withColumn(ACTION, action).where(F.col(ACTION).isNotNull())

    def value(c: str) -> Column:
        inserted = spec.inserts.get(c, s(c) if c in source.columns else F.lit(None))
        updated = spec.updates.get(c, t(c))
        return F.when(F.col(ACTION) == "I", inserted).when(F.col(ACTION) == "U", updated).otherwise(t(c)).alias(c)

    return acted.select(*[value(c) for c in cols], ACTION)


def applied(merged: DataFrame) -> DataFrame:
    return merged.where(F.col(ACTION) != "D").drop(ACTION)


def _from_source(columns: Sequence[str], keep: Sequence[str]) -> dict[str, Column]:
    return {c: s(c) for c in columns if c not in keep}


def newer_and_different(columns: Sequence[str], keys: Sequence[str], version: str, fingerprint: str, keep: Sequence[str] = ()) -> MergeSpec:
    """Last writer wins, but only if it changes something."""
    return MergeSpec(keys, _from_source(columns, [*keys, *keep]), (s(version) > t(version)) & (s(fingerprint) != t(fingerprint)))


def newer_with_guard(columns: Sequence[str], keys: Sequence[str], version: str, fingerprint: str, *, guarded: Sequence[str], as_of: str, deleted: str, deleted_at: str, keep: Sequence[str] = ()) -> MergeSpec:
    """As ``newer_and_different``; ``guarded`` columns only move forward with ``as_of``, and a newer record revives a deleted one."""
    base = newer_and_different(columns, keys, version, fingerprint, [*keep, deleted, deleted_at, as_of, *guarded])
    fresh = s(version) >= t(as_of)
    revived = F.coalesce(t(deleted) & (s(version) > t(deleted_at)), F.lit(False))
    more = {c: F.when(fresh, s(c)).otherwise(t(c)) for c in guarded} | {
        as_of: F.greatest(s(version), t(as_of)),
        deleted: t(deleted) & ~revived,
        deleted_at: F.when(~revived, t(deleted_at)),
    }
    return MergeSpec(keys, dict(base.updates) | more, base.when)


def span_and_profile(keys: Sequence[str], version: str, *, profile: Sequence[str], first: str, last: str, stamp: str | None = None) -> MergeSpec:
    """Profile columns of the newest row, and the widest span of two times."""
    newer = s(version) > t(version)
    changed = F.lit(False)
    for c in profile:
        changed = changed | ~t(c).eqNullSafe(s(c))
    updates = {c: F.when(newer, s(c)).otherwise(t(c)) for c in profile} | {
        version: F.greatest(s(version), t(version)), first: F.least(s(first), t(first)), last: F.greatest(s(last), t(last)),
    }
    if stamp:
        updates[stamp] = s(stamp)
    fires = (newer & changed) | F.coalesce(s(first) < t(first), F.lit(False)) | F.coalesce(s(last) > t(last), F.lit(False))
    return MergeSpec(keys, updates, fires)


def insert_only(keys: Sequence[str]) -> MergeSpec:
    return MergeSpec(keys)


def update_only(keys: Sequence[str], updates: Mapping[str, Column], when: Column) -> MergeSpec:
    return MergeSpec(keys, updates, when, insert=False)


def full_sync(columns: Sequence[str], keys: Sequence[str], fingerprint: str) -> MergeSpec:
    """Make the target equal to the source, touching only rows that differ."""
    return MergeSpec(keys, _from_source(columns, keys), ~s(fingerprint).eqNullSafe(t(fingerprint)), delete_unmatched=True)


def upsert_always(columns: Sequence[str], keys: Sequence[str]) -> MergeSpec:
    return MergeSpec(keys, _from_source(columns, keys))


def bridge_sync(keys: Sequence[str], flag: str, marker: str = "_change", carry: Sequence[str] = ()) -> MergeSpec:
    """Source rows say 'upsert' or 'delete' in ``marker``; an upsert changes a row only if its flag differs."""
    upsert = s(marker) == "upsert"
    return MergeSpec(keys, {c: s(c) for c in (flag, *carry)}, upsert & ~s(flag).eqNullSafe(t(flag)), s(marker) == "delete", insert_when=upsert)


def bridge_changes(existing: DataFrame, wanted: DataFrame, owners: DataFrame, owner: str, keys: Sequence[str]) -> DataFrame:
    """Source of a bridge sync: the wanted pairs, and those of the same owners that are wanted no more."""
    gone = existing.join(owners.select(owner).distinct(), owner, "left_semi").join(wanted, list(keys), "left_anti").select(*keys)
    return wanted.withColumn("_change", F.lit("upsert")).unionByName(gone.withColumn("_change", F.lit("delete")), allowMissingColumns=True)
