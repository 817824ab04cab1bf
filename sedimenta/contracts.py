"""Declared schemas: raw contracts, lineage columns and table specifications.

Nothing in this package infers a schema.  A contract is a tree of column names
and type names plus the key and the mandatory fields.
"""

from __future__ import annotations

from dataclasses import dataclass

Tree = dict[str, "str | Tree"]


def tree_of(text: str, **nested: Tree) -> Tree:
    """``"a bigint, b string, c *"`` as a dict; a ``*`` takes the tree given by name."""
    pairs = (part.split() for part in text.split(","))
    return {name: nested[name] if kind == "*" else kind for name, kind in pairs}


def ddl_of(tree: Tree, nested: bool = False) -> str:
    sep = ":" if nested else " "
    return ", ".join(f"{k}{sep}struct<{ddl_of(v, True)}>" if isinstance(v, dict) else f"{k}{sep}{v}" for k, v in tree.items())


# Column names and types of the raw records.
OWNER = tree_of("account_id bigint, user_id bigint, user_type string, reputation int, accept_rate int, display_name string, profile_image string, link string")
MIGRATED_FROM = tree_of("question_id bigint, on_date bigint, other_site string")
RAW = {
    "questions": tree_of(
        "question_id bigint, title string, body string, tags array<string>, owner *, is_answered boolean, view_count int, answer_count int, "
        "score int, accepted_answer_id bigint, creation_date bigint, last_activity_date bigint, last_edit_date bigint, closed_date bigint, "
        "closed_reason string, protected_date bigint, locked_date bigint, community_owned_date bigint, bounty_amount int, "
        "bounty_closes_date bigint, content_license string, link string, migrated_from *, posted_by_collectives string",
        owner=OWNER, migrated_from=MIGRATED_FROM,
    ),
    "answers": tree_of(
        "answer_id bigint, question_id bigint, body string, owner *, is_accepted boolean, score int, creation_date bigint, "
        "last_activity_date bigint, last_edit_date bigint, locked_date bigint, community_owned_date bigint, content_license string, "
        "posted_by_collectives string, recommendations string",
        owner=OWNER,
    ),
    "deleted_questions": tree_of("question_id bigint, is_deleted boolean, detected_at bigint"),
    "question_snapshots": tree_of("question_id bigint, snapshot_at bigint, score int, view_count int, answer_count int, is_answered boolean, closed_date bigint"),
}
LINEAGE = tree_of("_batch_id string, _load_type string, _batch_date date, _extracted_at timestamp, _source_file string, _record_hash string, _rescued_data string, load_timestamp timestamp")
QUARANTINE = tree_of("quarantine_id string, entity string, _batch_id string, _source_file string, reason string, error_detail string, raw_record string, load_timestamp timestamp")

_MANDATORY = {
    "questions": "question_id title body tags owner is_answered view_count answer_count score creation_date last_activity_date link owner.user_type owner.display_name",
    "answers": "answer_id question_id body owner is_accepted score creation_date last_activity_date content_license owner.user_type owner.display_name",
    "deleted_questions": "question_id is_deleted detected_at",
    "question_snapshots": "question_id snapshot_at score view_count answer_count is_answered closed_date",
}
_KEYS = {"questions": ("question_id",), "answers": ("answer_id",), "deleted_questions": ("question_id",), "question_snapshots": ("question_id", "snapshot_at")}


@dataclass(frozen=True)
class Contract:
    """What a raw file of an entity must look like."""

    entity: str
    tree: Tree
    keys: tuple[str, ...]
    mandatory: frozenset[str]

    @property
    def ddl(self) -> str:
        return ddl_of(self.tree)


CONTRACTS = {e: Contract(e, tree, _KEYS[e], frozenset(_MANDATORY[e].split())) for e, tree in RAW.items()}
